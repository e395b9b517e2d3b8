"""Personal data: base patterns, then information-theoretic sanitisation, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers; their values are the protected entities.
A term (a word outside all base spans of a document that holds an entity) reveals the entity as far as their
co-occurrence in the corpus says so: with document counts n(t), n(e), n(t, e) of N documents, the pointwise mutual information
log(n(t, e) N / (n(t) n(e))) is compared with the entity's information content log(N / n(e)). A term whose share of it
reaches ``generalise`` is replaced by a general mark wherever it stands in a document that holds that entity, and one
that reaches ``remove`` is removed. Terms seen with an entity in fewer than ``support`` documents say nothing.

All counts are over all documents and whole texts. Counts of terms and of pairs are partly summed before each shuffle.
Pairs are formed only of entities and terms that can reach ``support`` and ``generalise``: n(t, e) is at most n(e), so
n(t) must not exceed N (n(e) / N) ^ generalise.

Edge cases: null text counts as empty; repeated rows count as documents of their own, with term spans of their own even
if they share a doc_id; a null doc_id is a value like any other; an empty table gives an
empty result; a column named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialise
from tideline.llm.spans import cut, let, matches, outside, parts, placed, replaced

KINDS = ("email", "ip", "card", "phone", "term", "removed")
#: Patterns of the contract, each with a guard that starts a search only where a match could begin (after a failed
#: run or the last match), and possessive repeats; both leave the matches as they are and the search linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
#: A card's match is a whole run of digits, so runs of other lengths need not be found.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{N}]*+"
WORD = rf"(?<=[^\p{{L}}\p{{N}}]){TERM}(?=[^\p{{L}}\p{{N}}])"

_LOW_IP = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$"


def _luhn(digits: Column) -> Column:
    """Digits of the reversed number, every second one doubled, sum to a multiple of ten."""
    n = F.length(digits)
    place = F.sequence(F.lit(1), n)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + d

    return F.aggregate(place, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Sorted array of the four base kinds' spans."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    email = matches(text, EMAIL, "email", 0)
    ip = matches(text, IP, "ip", 1, lambda m: m.rlike(_LOW_IP))
    card = matches(text, CARD, "card", 2, lambda m: _luhn(digits(m)))
    phone = matches(text, PHONE, "phone", 3, lambda m: F.length(digits(m)).between(10, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _gaps(text: Column, base: Column) -> Column:
    """Array of struct<at, piece>: what lies outside all spans, with a character (or space) more on either side; at is
    where the piece would begin in the text."""

    def piece(g: Column, pieces: Column, size: Column) -> Column:
        taken = cut(pieces, F.greatest(g["begin"] - 1, F.lit(0).cast("bigint")), F.least(g["end"] + 1, size))
        return F.concat(F.when(g["begin"] == 0, F.lit(" ")).otherwise(F.lit("")), taken, F.when(g["end"] == size, F.lit(" ")).otherwise(F.lit("")))

    told = lambda size: lambda pieces: F.transform(outside(text, base), lambda g: F.struct((g["begin"] - 1).alias("at"), piece(g, pieces, size).alias("piece")))
    return let(F.length(text).cast("bigint"), lambda size: let(parts(text), told(size)))


def _marks(gaps: Column, kinds: Column) -> Column:
    """Spans of all words that the map kinds has."""

    def of_gap(g: Column) -> Column:
        def span(start: Column, end: Column, hit: Column) -> Column:
            kind = F.try_element_at(kinds, F.lower(hit))
            told = F.struct((g["at"] + start).alias("start"), F.when(kind == "removed", F.lit(5)).otherwise(F.lit(4)).alias("rank"), (g["at"] + end).alias("end"), kind.alias("kind"), F.lower(hit).alias("match"))
            return F.when(kind.isNotNull(), told)

        return placed(F.split(g["piece"], WORD, -1), F.regexp_extract_all(g["piece"], F.lit(WORD), F.lit(0)), span)

    return F.flatten(F.transform(gaps, of_gap))


def mentions(docs: DataFrame) -> DataFrame:
    """__row, doc_id, base spans and, where there are any, the text."""
    row = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    found = docs.select(row.alias("__row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    return found.withColumn("text", F.when(F.size("base") > 0, F.col("text")))


def together(docs: DataFrame, found: DataFrame, generalise: float, support: int) -> DataFrame:
    """(__row, entity, term, n_e, n_t, n) of each entity and term of a document that may reach the thresholds."""
    names = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["match"]))))
    held = found.where(F.size("base") > 0).select("__row", F.explode(names).alias("entity"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support).crossJoin(F.broadcast(total)).where(F.col("n") > F.col("n_e"))
    most = F.col("n") * F.pow(F.col("n_e") / F.col("n"), F.lit(generalise)) * (1 + 1e-9)
    held = materialise(held.join(entities.withColumn("most", most), "entity"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(rf"(?<![\p{{L}}\p{{N}}]){TERM}"), F.lit(0)))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") >= support)
    terms = terms.crossJoin(F.broadcast(held.agg(F.max("most").alias("limit")))).where(F.col("n_t") <= F.col("limit")).drop("limit")
    own = F.array_distinct(F.flatten(F.transform(_gaps(F.col("text"), F.col("base")), lambda g: F.transform(F.regexp_extract_all(g["piece"], F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))))
    each = found.join(held.select("__row").distinct(), "__row", "left_semi").select("__row", F.explode(own).alias("term"))
    return each.join(terms, "term").join(held, "__row").where(F.col("n_t") <= F.col("most")).drop("most")


def revealing(pairs: DataFrame, generalise: float, remove: float, support: int) -> DataFrame:
    """(entity, term, kind) of the pairs whose share of the entity's information reaches a threshold."""
    joint = pairs.groupBy("entity", "term", "n_e", "n_t", "n").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    share = F.log(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e"))) / F.log(F.col("n") / F.col("n_e"))
    joint = joint.withColumn("share", share).where(F.col("share") >= generalise)
    return joint.select("entity", "term", F.when(F.col("share") >= remove, F.lit("removed")).otherwise(F.lit("term")).alias("kind"))


def find_personal_data(docs: DataFrame, generalise: float = 0.9, remove: float = 0.999, support: int = 3) -> DataFrame:
    """(__row, doc_id, base, spans) for every row: base spans, and those with the revealing terms, sorted."""
    found = materialise(mentions(docs))
    pairs = materialise(together(docs, found, generalise, support))
    hits = pairs.select("__row", "entity", "term").join(revealing(pairs, generalise, remove, support), ["entity", "term"])
    # A term that one entity generalises and another removes is removed, the smaller of both words.
    hits = hits.groupBy("__row", "term").agg(F.min("kind").alias("kind")).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    whole = found.join(hits, "__row", "left")
    marks = _marks(_gaps(F.col("text"), F.col("base")), F.col("kinds"))
    return whole.select("__row", "doc_id", "base", F.when(F.col("kinds").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", marks))).alias("spans"))


def sanitise(docs: DataFrame, **thresholds: float) -> DataFrame:
    """The documents with text sanitised: base spans and generalised terms become marks, removed terms go."""
    docs = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = find_personal_data(docs, **thresholds).select("__row", F.col("spans").alias("__spans")).where(F.size("__spans") > 0)
    mark = lambda s: F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("__spans"), mark))
    return docs.join(found, "__row", "left").withColumn("text", text).drop("__row", "__spans")
