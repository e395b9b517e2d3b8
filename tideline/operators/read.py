"""Values and bucketed ranges of samples and counters, for every series at once.

Bounds are whole seconds and inclusive at both ends; they hold for an operation's own time and for a bucket's start,
and are applied to the bare column t, so that Parquet prunes by its statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.series import Agg, bucket_start, fold
from tideline.operators import resolve


def between(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("t") >= int(start))
    return df.where(F.col("t") <= int(end)) if end is not None else df


def _sample_rows(ops: DataFrame, buckets: DataFrame | None, start: int | None, end: int | None) -> DataFrame:
    """Partial rows (n, s, mn, mx, f, l, ord): a bucket stands before an operation of the same second."""
    value = F.col("value")
    rows = resolve.samples(between(ops, start, end)).select("series", "t", F.lit(1).cast("bigint").alias("n"), *(value.alias(c) for c in ("s", "mn", "mx", "f", "l")), (F.col("t") * 2 + 1).alias("ord"))
    if buckets is None:
        return rows
    old = between(buckets, start, end).select("series", "t", F.col("count").alias("n"), F.col("sum").alias("s"), F.col("min").alias("mn"), F.col("max").alias("mx"), F.col("first").alias("f"), F.col("last").alias("l"), (F.col("t") * 2).alias("ord"))
    return rows.unionByName(old)


def sample_values(ops: DataFrame, buckets: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(series, t, value): points, and buckets as their means."""
    return _sample_rows(ops, buckets, start, end).select("series", "t", (F.col("s") / F.col("n")).alias("value"))


def sample_range(ops: DataFrame, span: int, agg: Agg, buckets: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(series, t, value) per bucket of span seconds; a span of 0 gives the values."""
    if span < 1:
        return sample_values(ops, buckets, start, end)
    rows = _sample_rows(ops, buckets, start, end)
    return rows.groupBy("series", bucket_start(F.col("t"), span).alias("t")).agg(fold(agg).alias("value"))


def _counter_rows(ops: DataFrame, buckets: DataFrame | None, start: int | None, end: int | None) -> DataFrame:
    """One row per distinct operation and per bucket. Equal seconds are in the order bucket, clock, replica, value."""
    value = F.col("value")
    order = lambda bucket, clock, replica, value: F.struct(F.col("t").alias("t"), bucket.alias("raw"), clock.alias("clock"), replica.alias("replica"), value.alias("v")).alias("ord")
    rows = resolve.counters(between(ops, start, end)).select("series", "t", F.lit(1).cast("bigint").alias("n"), *(value.alias(c) for c in ("s", "mn", "mx", "f", "l")), order(F.lit(1), F.col("clock"), F.col("replica"), value))
    if buckets is None:
        return rows
    total = F.col("sum")
    old = between(buckets, start, end).select("series", "t", F.lit(1).cast("bigint").alias("n"), *(total.alias(c) for c in ("s", "mn", "mx", "f", "l")), order(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("decimal(20,0)"), total))
    return rows.unionByName(old)


def counter_values(ops: DataFrame, buckets: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(series, t, value): deltas and buckets of each second, summed as integers."""
    return _counter_rows(ops, buckets, start, end).groupBy("series", "t").agg(F.sum("s").cast("double").alias("value"))


def counter_range(ops: DataFrame, span: int, agg: Agg, buckets: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """As sample_range; every operation, and every bucket, counts as one value."""
    if span < 1:
        return counter_values(ops, buckets, start, end)
    rows = _counter_rows(ops, buckets, start, end)
    return rows.groupBy("series", bucket_start(F.col("t"), span).alias("t")).agg(fold(agg).alias("value"))
