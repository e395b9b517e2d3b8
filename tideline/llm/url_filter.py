"""URL filters: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, of the URLs that rules accept and of those that rules reject, give a
log-likelihood difference per character; a threshold calibrated on the ruled URLs decides the rest. It is calibrated on
scores that each ruled URL gets from the models of the URLs of the other fold (two folds by the URL's hash, so that copies
of a URL share one): what a model says of its own training URLs would be too sure.

Counts cover every ruled URL and are exact: the ORDERS bytes that end at a position fill part of a 64-bit number, a
gram, whose low bytes are the shorter contexts. What a byte adds to the score depends on its gram alone, so it is worked
out once for each distinct gram, by joins with the counts of its shorter parts (at most 256 x 256 grams share a key of
those that are shuffled). The HOT grams most frequent are broadcast and added up where the URLs are; only the rarer ones,
of which none is frequent, are joined.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and has no characters to score
(null URL) or is scored whole; repeated rows are judged alike and each kept; with no ruled URLs of one class the
models say nothing and the verdict is ``allow``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, materialise

#: Context lengths 0 to ORDERS - 1, weight of the next shorter context, folds of the calibration and bins of its histogram.
ORDERS, WEIGHT, FOLDS, BINS = 5, 2.0, 2, 4000
#: Grams whose part of the score is broadcast (32 bytes each).
HOT = 1 << 19
#: Counts of grams by verdict and fold, and what the whole models and those without a fold make of a gram.
COUNTS = tuple(f"{c}{f}" for c in ("allow", "block") for f in range(FOLDS))
VALUES = ("value", *(f"cross{f}" for f in range(FOLDS)))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def with_rules(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and ruled (the rule's verdict); the longest fitting rule wins."""
    host, path = url_parts(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, ruled = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(ruled)
    return df.withColumns({"rule": rule, "ruled": ruled})


def _whole_grams(urls: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """URL index of each byte, bytes per URL, and the gram that ends at each byte."""
    raw = [u.lower().encode("utf-8", "surrogatepass") for u in urls.fillna("")]
    pad = ORDERS - 1
    flat = np.frombuffer(b"".join(b"\0" * pad + r for r in raw), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(int(sizes.sum())) + pad * (owner + 1)
    gram = np.zeros(len(at), dtype=np.int64)
    for order in range(ORDERS):
        gram |= flat[at - order] << (8 * order)
    return owner, sizes, gram


def _counted_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        owner, _, gram = _whole_grams(batch["url"])
        value, which = np.unique(gram, return_inverse=True)
        ruled, fold = (batch[c].to_numpy()[owner] if len(gram) else np.zeros(0, dtype=object) for c in ("ruled", "fold"))
        count = lambda mask: np.bincount(which[mask], minlength=len(value)).astype(np.int64)  # noqa: B023, E731
        seen = {c: count((ruled == c[:-1]) & (fold == int(c[-1]))) for c in COUNTS}
        yield pd.DataFrame({"gram": value, "n": count(np.ones(len(gram), dtype=bool)), **seen})


def with_folds(ruled: DataFrame) -> DataFrame:
    """The fold of each URL: whether the first digit of its digest is odd."""
    return ruled.withColumn("fold", F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin(*"13579bdf").cast("int"))


def train(ruled: DataFrame) -> DataFrame:
    """(gram, n, VALUES) of every distinct gram of the URLs: how often it stands there, and what it adds to the scores."""
    sums = [F.sum(c).alias(c) for c in ("n", *COUNTS)]
    kind = ", ".join(f"{c} long" for c in ("gram", "n", *COUNTS))
    grams = materialise(with_folds(ruled.select("url", "ruled")).mapInPandas(_counted_grams, kind).groupBy("gram").agg(*sums))
    known = grams.where(" + ".join(COUNTS) + " > 0")
    found = grams.crossJoin(F.broadcast(grams.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_c0") for c in COUNTS))))
    low = lambda size: F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))
    context = lambda size: F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * size) - 1))
    for order in range(ORDERS):
        for kind, key, size in (("p", low(order + 1), order + 1), ("c", context(order), order)):
            if size in (0, ORDERS):
                continue
            counts = known.groupBy(key.alias(f"k_{kind}{order}")).agg(*(F.sum(c).alias(f"{c}_{kind}{order}") for c in COUNTS))
            found = found.withColumn(f"k_{kind}{order}", key).join(F.broadcast(counts) if size <= 2 else counts, f"k_{kind}{order}", "left")

    def likelihood(verdict: str, folds: list[int]) -> Column:
        total = lambda end: sum((F.coalesce(f"{verdict}{f}{end}", F.lit(0)) for f in folds[1:]), F.coalesce(f"{verdict}{folds[0]}{end}", F.lit(0)))
        p = F.lit(1 / 256)
        for order in range(ORDERS):
            p = (total("" if order == ORDERS - 1 else f"_p{order}") + WEIGHT * p) / (total(f"_c{order}") + WEIGHT)
        return F.log(p)

    ways = [list(range(FOLDS)), *([g for g in range(FOLDS) if g != f] for f in range(FOLDS))]
    return materialise(found.select("gram", "n", *((likelihood("allow", w) - likelihood("block", w)).alias(v) for v, w in zip(VALUES, ways, strict=True))))


def score(df: DataFrame, values: DataFrame) -> DataFrame:
    """Adds lm_score, the length-normalised log-likelihood difference (positive: like accepted URLs), and cross_score, the
    same by the models without the URL's fold."""
    # Broadcast the grams from the least power of two on from which there are at most HOT; a rarer one has under 2 / HOT of the bytes.
    power = F.floor(F.log2("n")).cast("int")
    sizes, least, kept = {r["power"]: r["count"] for r in values.groupBy(power.alias("power")).count().collect()}, 63, 0
    while least and kept + sizes.get(least - 1, 0) <= HOT:
        least -= 1
        kept += sizes.get(least, 0)
    common = values.where(power >= least).select("gram", *VALUES).toPandas().sort_values("gram")
    all_common = least == 0
    shared = df.sparkSession.sparkContext.broadcast((common["gram"].to_numpy(dtype=np.int64), common[list(VALUES)].to_numpy(dtype=np.float64)))

    @F.pandas_udf("total double, crossed double, size long, rare array<long>")
    def parts(urls: pd.Series, folds: pd.Series) -> pd.DataFrame:
        grams, value = shared.value
        owner, sizes, gram = _whole_grams(urls)
        at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
        hit = grams[at] == gram if len(grams) else np.zeros(len(gram), dtype=bool)
        own, place = owner[hit], at[hit]
        total = np.bincount(own, value[place, 0], minlength=len(sizes))
        crossed = np.bincount(own, value[place, 1 + folds.to_numpy()[own]], minlength=len(sizes))
        rare, ends = gram[~hit], np.cumsum(np.bincount(owner[~hit], minlength=len(sizes)))
        return pd.DataFrame({"total": total, "crossed": crossed, "size": sizes, "rare": [r.tolist() for r in np.split(rare, ends[:-1])]})

    length = F.greatest(F.col("__parts.size"), F.lit(1))
    scored = with_folds(df).withColumn("__parts", parts(F.col("url"), F.col("fold")))
    if all_common:
        return scored.withColumns({"lm_score": F.col("__parts.total") / length, "cross_score": F.col("__parts.crossed") / length}).drop("__parts", "fold")
    scored = materialise(scored.withColumn("__row", F.monotonically_increasing_id()))
    each = scored.select("__row", "fold", F.explode("__parts.rare").alias("gram")).join(values.select("gram", *VALUES).hint("merge"), "gram")
    crossed = F.get(F.array(*VALUES[1:]), F.col("fold"))
    rest = each.groupBy("__row").agg(F.sum("value").alias("__rest"), F.sum(crossed).alias("__rest_crossed"))
    both = {"lm_score": F.col("__parts.total") + F.coalesce("__rest", F.lit(0.0)), "cross_score": F.col("__parts.crossed") + F.coalesce("__rest_crossed", F.lit(0.0))}
    return scored.join(rest, "__row", "left").withColumns({k: v / length for k, v in both.items()}).drop("__parts", "__row", "__rest", "__rest_crossed", "fold")


def calibrate(scored: DataFrame) -> float:
    """The cross_score that best parts accepted from rejected URLs (balanced error over all of them)."""
    ruled = scored.where(F.col("ruled").isNotNull())
    low, high = ruled.agg(F.min("cross_score"), F.max("cross_score")).first()
    if low is None:
        return -np.inf
    width = (high - low) / BINS or 1.0
    cell = F.least(F.lit(BINS - 1), F.floor((F.col("cross_score") - low) / width))
    seen = {"allow": np.zeros(BINS), "block": np.zeros(BINS)}
    for r in ruled.groupBy("ruled", cell.cast("int").alias("cell")).count().collect():
        seen[r["ruled"]][r["cell"]] += r["count"]
    if not seen["allow"].sum() or not seen["block"].sum():
        return -np.inf
    below = lambda x: np.concatenate(([0], np.cumsum(x))) / x.sum()
    gain = below(seen["block"]) - below(seen["allow"])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(low + best[len(best) // 2] * width)


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The pages' columns with host, path, rule, lm_score, cross_score and verdict (the rule's, else the models')."""
    clash = [c for c in ("host", "path", "rule", "ruled", "fold", "lm_score", "cross_score", "verdict") if c in pages.columns]
    ruled = with_rules(pages.drop(*clash), rules)
    scored = materialise(score(ruled, train(ruled)))
    least = calibrate(scored)
    own = F.when(F.col("lm_score") >= F.lit(least), "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("ruled", own)).drop("ruled")
