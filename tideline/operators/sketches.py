"""Sketch-valued columns: distributions that are built once, kept, merged to coarser groups and asked later.

Both ways in are the same two aggregations: equal bins of a group are counted, which leaves each group as many rows as it
has bins, whatever its size, and these are gathered to one struct. ``tideline.functions.sketches`` has what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import bins, sketches
from tideline.functions.series import bucket_start
from tideline.operators import resolve
from tideline.operators.read import between

GROUP = ["series", "t"]
_ROW = ("sign", "key", "n", "s", "mn", "mx")


def _gathered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """A sketch for each group from partial rows (sign, key, n, s, mn, mx); a row without a sign has no bin."""
    equal = rows.groupBy(*by, "sign", "key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    held = F.collect_list(F.when(F.col("sign").isNotNull(), F.struct("sign", "key", "n")))
    one = equal.groupBy(*by).agg(F.sum(F.when(F.col("sign").isNotNull(), F.col("n"))).alias("count"), F.sum("s").alias("sum"), F.min("mn").alias("min"), F.max("mx").alias("max"), held.alias("held"))
    return one.select(*by, F.struct("count", "sum", "min", "max", sketches.collapsed(F.col("held")).alias("bins")).alias(name))


def _of_values(values: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return values.where(v.isNotNull()).select(*by, bins.sign(v).alias("sign"), bins.key(v).alias("key"), F.lit(1).cast("bigint").alias("n"), v.alias("s"), v.alias("mn"), v.alias("mx"))


def _of_sketches(held: DataFrame, by: list[str], c: Column) -> DataFrame:
    """A row for each bin, in any order, and one for the totals."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda *of: F.struct(*(x.alias(a) for a, x in zip(_ROW, of, strict=True)))
    each = F.transform(c["bins"], lambda b: row(b["sign"], b["key"], b["n"], none("double"), none("double"), none("double")))
    totals = F.array(row(none("int"), none("int"), none("bigint"), c["sum"], c["min"], c["max"]))
    return held.where(c["count"] > 0).select(*by, F.explode(F.concat(totals, each)).alias("r")).select(*by, "r.*")


def sketched(values: DataFrame, by: list[str], value: str = "value", name: str = "sketch") -> DataFrame:
    """(by..., sketch) of the finite values of each group; nulls are left out."""
    return _gathered(_of_values(values, by, value), by, name)


def combined(held: DataFrame, by: list[str], sketch: str = "sketch", values: DataFrame | None = None) -> DataFrame:
    """(by..., sketch): the sketches of each group as one, with the observations (by..., value) if there are any."""
    rows = _of_sketches(held, by, F.col(sketch))
    return _gathered(rows if values is None else rows.unionByName(_of_values(values, by, "value")), by, sketch)


def checked(buckets: DataFrame, most: int = bins.MAX_BINS) -> DataFrame:
    """The stored buckets; reading one fails whose count is not the sum of its bins, that has an empty bin or too many."""
    side = lambda c: F.coalesce(F.map_values(c), F.array().cast("array<bigint>"))
    held = F.concat(side(F.col("neg")), side(F.col("pos")))
    total = F.aggregate(held, F.coalesce(F.col("zero"), F.lit(0)).cast("bigint"), lambda a, n: a + n)
    sound = (total == F.col("count")) & (F.size(held) <= most) & ~F.exists(held, lambda n: n <= 0)
    wrong = F.concat(F.lit("a damaged bucket of "), F.col("series"), F.lit(" at "), F.col("t").cast("string"))
    return buckets.where(F.assert_true(F.coalesce(sound, F.lit(False)), wrong).isNull())


def combined_buckets(buckets: DataFrame, span: int = 0, values: DataFrame | None = None) -> DataFrame:
    """(series, t, sketch): stored buckets, which are checked, by spans, with the observations (series, t, value) if there are
    any."""
    placed = checked(buckets).select("series", bucket_start(F.col("t"), span).alias("t"), F.struct("count", "sum", "min", "max", sketches.bucket_bins().alias("bins")).alias("sketch"))
    return combined(placed, GROUP, values=values)


def of_buckets(buckets: DataFrame) -> DataFrame:
    """(series, t, sketch) of stored buckets, which are checked."""
    return checked(buckets).select(*GROUP, sketches.of_bucket().alias("sketch"))


def sketch_range(ops: DataFrame, span: int, buckets: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(series, t, sketch) per bucket of span seconds, from operations and compacted buckets together."""
    t = bucket_start(F.col("t"), span).alias("t")
    observed = resolve.sketches(between(ops, start, end)).select("series", t, "value")
    if buckets is None:
        return sketched(observed, GROUP)
    return combined_buckets(between(buckets, start, end), span, observed)
