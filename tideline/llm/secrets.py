"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression follows a Boolean query over trigrams of the lower-cased text that every match
must satisfy. The index holds for each trigram that some rule asks for the list of the documents that have it, by
shards of about SHARD documents: a list never outgrows its shard, so a trigram that a third of all documents share is no
larger task than another. Lists are intersected and united shard by shard as a rule's query says; what is left are its
candidates, and only those are searched for the rule. Rules from which no trigram follows scan every document.

Candidates are joined to the documents by a 64-bit hash of the id: broadcast while there are at most BROADCAST of them,
which is counted, and shuffled beyond. Another document of equal hash is searched too, no more.

Edge cases: null text counts as empty; documents of equal id share postings, and each row is verified by itself; a null
id is a value like any other; an empty table gives an empty result; a column named like a result column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialise
from tideline.llm.spans import SPAN, matches, replaced


@dataclass(frozen=True)
class SecretRule:
    """pattern is valid for Python and Java; value names the group that must have at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    value: int = 0


#: Rules of the contract (fixed values); the last may name its least length in the pattern, as its matches are whole runs.
BASE_RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    SecretRule("access", r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", r"[0-9a-f]{16,}"),
)
#: Further well-known shapes of credentials.
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    SecretRule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
#: Alternatives beyond which a run of literals is cut and its trigrams so far are kept.
EXACT = 64
#: Documents of a shard of the index, candidates that are broadcast.
SHARD, BROADCAST = 1 << 14, 1 << 18

Query = bool | str | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    """and / or of queries; True is what anything satisfies."""
    parts = list(dict.fromkeys(parts))
    if kind == "or" and True in parts:
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _strings(strings: set[str]) -> Query:
    """One of the strings is there; an alternative that asks for more than another adds nothing."""
    sets = [tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)]
    least = [a for a in sets if not any(set(b) < set(a) for b in sets)]
    return _both("or", [_both("and", list(a)) for a in least])


def _walk(parsed: object) -> tuple[set[str] | None, Query]:
    """The strings that the expression matches, if they are few, and what else every match must satisfy."""
    run: set[str] = {""}
    needs: list[Query] = []
    whole = True

    def cut() -> None:
        nonlocal run, whole
        needs.append(_strings(run))
        run, whole = {""}, False

    for op, arg in parsed:
        name, exact, need = str(op), None, True
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 8:
            exact = {chr(v).lower() for _, v in arg}
        elif name == "SUBPATTERN":
            exact, need = _walk(arg[-1])
        elif name == "BRANCH":
            found = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in found):
                exact = set().union(*(e for e, _ in found))
            else:
                need = _both("or", [_strings(e) if e is not None else n for e, n in found])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            inner_exact, inner_need = _walk(inner)
            if inner_exact is not None and (least, most) in ((0, 1), (1, 1)):
                exact = inner_exact | ({""} if least == 0 else set())
            elif least:
                need = _strings(inner_exact) if inner_exact is not None else inner_need
        elif name == "AT":
            exact = {""}
        if exact is not None and len(run) * len(exact) <= EXACT:
            run = {a + b for a in run for b in exact}
            continue
        cut()
        if exact is not None:
            run = exact
        elif need is not True:
            needs.append(need)
    if whole:
        return run, True
    needs.append(_strings(run))
    return None, _both("and", needs)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text around any match must hold; True where nothing follows."""
    exact, need = _walk(re._parser.parse(pattern))
    return need if exact is None else _strings(exact)


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def postings(docs: DataFrame, grams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, doc) for the wanted trigrams; doc is the hash of the id."""
    lowered = docs.select(F.xxhash64(doc_id).alias("doc"), lowered_text(F.col(text)).alias("t"))
    present = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in grams)))
    return lowered.select(F.explode(present).alias("trigram"), "doc")


def inverted(posted: DataFrame, shards: int) -> DataFrame:
    """(shard, trigram, docs): the postings list of each trigram in each shard."""
    return posted.groupBy(F.pmod("doc", F.lit(shards)).alias("shard"), "trigram").agg(F.collect_set("doc").alias("docs"))


def found_by(query: Query, lists: Column) -> Column:
    """The documents of a shard that satisfy the query, from the map of its postings lists."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, [found_by(q, lists) for q in query[1:]])


def lowered_text(c: Column) -> Column:
    """Lower case for the index only: a letter outside ASCII is in no rule, so its case does not matter."""
    return F.lower(F.coalesce(c, F.lit("")))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc, rules): the rules whose Boolean query the index answers with the document."""
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    each = F.array(*(F.struct(F.lit(kind).alias("rule"), found_by(q, F.col("lists")).alias("docs")) for kind, q in queries.items()))
    rules = lists.select(F.explode(each).alias("x")).select("x.rule", F.explode("x.docs").alias("doc"))
    return rules.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The documents with secret_spans, sorted by start and then by the rules' order."""
    docs = docs.drop("secret_spans")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    grams = sorted(set().union(*map(trigrams, indexed.values()))) if indexed else []
    body = F.coalesce(F.col("text"), F.lit(""))
    if grams:
        shards = docs.select("doc_id").count() // SHARD + 1
        found = candidates(inverted(postings(docs, grams), shards), indexed)
        found = materialise(found.select(F.col("doc").alias("__doc"), F.col("rules").alias("__rules")))
        near = found.count() <= BROADCAST
        docs = docs.withColumn("__doc", F.xxhash64("doc_id")).join(F.broadcast(found) if near else found, "__doc", "left").drop("__doc")
    else:
        docs = docs.withColumn("__rules", F.array().cast("array<string>"))
    arrays = []
    for rank, r in enumerate(rules):
        keep = None
        if r.least:
            keep = lambda m, r=r: F.length(F.regexp_extract(m, r.pattern, r.value)) >= r.least
        spans = matches(body, r.pattern, r.kind, rank, keep)
        arrays.append(spans if queries[r.kind] is True else F.when(F.array_contains("__rules", r.kind), spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return docs.withColumn("secret_spans", F.array_sort(F.concat(*arrays))).drop("__rules")


def redact(scanned: DataFrame) -> DataFrame:
    """Replaces text: every span, overlapping ones as one, by the mark of the kind that starts first."""
    mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    text = F.when(F.size("secret_spans") > 0, replaced(F.col("text"), F.col("secret_spans"), mark)).otherwise(F.col("text"))
    return scanned.withColumn("text", text)
