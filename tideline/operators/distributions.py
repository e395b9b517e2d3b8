"""Distributions: counts, sums, extremes and nearest-rank quantiles per bucket.

A group without compacted buckets is exact. A group with one is approximate as a whole: its own observations are binned
like the buckets', so that a late observation never hides what was compacted. Exact ranks run over the distinct values
of a group, in one task or, for groups that are counted as large, in many.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import bins, sketches
from tideline.functions.series import bucket_start
from tideline.operators import resolve
from tideline.operators.read import between
from tideline.operators.sketches import GROUP, checked, combined_buckets
from tideline.sources.scratch import written

#: Operations of a group that one task ranks, and groups beyond that whose names are broadcast.
MOST, BROADCAST = 1 << 20, 1 << 16


def _observed(ops: DataFrame, span: int, start: int | None, end: int | None) -> DataFrame:
    return resolve.sketches(between(ops, start, end)).select("series", bucket_start(F.col("t"), span).alias("t"), "value")


def stats(ops: DataFrame, span: int, buckets: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(series, t, count, sum, min, max, mean)."""
    rows = _observed(ops, span, start, end).select(*GROUP, F.lit(1).cast("bigint").alias("n"), F.col("value").alias("s"), F.col("value").alias("mn"), F.col("value").alias("mx"))
    if buckets is not None:
        rows = rows.unionByName(checked(between(buckets, start, end)).select("series", bucket_start(F.col("t"), span).alias("t"), F.col("count").alias("n"), F.col("sum").alias("s"), F.col("min").alias("mn"), F.col("max").alias("mx")))
    told = rows.groupBy(*GROUP).agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.min("mn").alias("min"), F.max("mx").alias("max"))
    return told.withColumn("mean", F.col("sum") / F.col("count"))


def binned(values: DataFrame) -> DataFrame:
    """(series, t, sign, key, n) of observations."""
    v = F.col("value")
    return values.groupBy(*GROUP, bins.sign(v).alias("sign"), bins.key(v).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def bucket_bins(buckets: DataFrame) -> DataFrame:
    """(series, t, sign, key, n) of stored buckets, which are checked."""
    buckets = checked(buckets)
    entries = lambda c, s: F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<int,bigint>"))), lambda e: F.struct(F.lit(s).alias("sign"), e["key"].alias("key"), e["value"].alias("n")))
    zero = F.when(F.col("zero") > 0, F.array(F.struct(F.lit(0).alias("sign"), F.lit(0).alias("key"), F.col("zero").alias("n")))).otherwise(F.array().cast("array<struct<sign:int,key:int,n:bigint>>"))
    return buckets.select(*GROUP, F.explode(F.concat(entries(F.col("neg"), -1), zero, entries(F.col("pos"), 1))).alias("b")).select(*GROUP, "b.sign", "b.key", "b.n")


def collapsed(rows: DataFrame, most: int = bins.MAX_BINS) -> DataFrame:
    """Sums equal bins; of each group the bins of smallest key beyond ``most``, negative ones first, join the zero bin."""
    summed = rows.groupBy(*GROUP, "sign", "key").agg(F.sum("n").alias("n"))
    placed = summed.withColumn("stays", _stays(F.col("sign"), most))
    return placed.groupBy(*GROUP, F.when(F.col("stays"), F.col("sign")).otherwise(0).alias("sign"), F.when(F.col("stays"), F.col("key")).otherwise(0).alias("key")).agg(F.sum("n").alias("n"))


def _stays(sign: Column, most: int) -> Column:
    """Whether a bin is among the ``most`` of its group that do not join the zero bin."""
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.when(sign == 0, 0).otherwise(1), F.desc("key"), F.desc("sign")))
    has_zero = F.max(F.when(sign == 0, 1).otherwise(0)).over(Window.partitionBy(*GROUP))
    return (sign != 0) & (rank - has_zero <= most)


def _met(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
    """A join by group, the series without a name being one of its own."""
    by = [*GROUP, *more]
    other = right.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in right.columns if c not in by))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return left.join(other, same, how).drop(*(f"_{c}" for c in by))


def crowded(ops: DataFrame, span: int, most: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """The groups (series, t) with more than ``most`` operations, counted before the shuffle and from two columns only."""
    counted = between(ops, start, end).groupBy("series", bucket_start(F.col("t"), span).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > most).select("series", F.col("b").alias("t"))


def quantiles(ops: DataFrame, span: int, wanted: dict[str, float], buckets: DataFrame | None = None, start: int | None = None, end: int | None = None, most: int = MOST) -> DataFrame:
    """(series, t, one column per wanted quantile). Quantiles outside 0 to 1 are NaN.

    Groups are counted first. One of at most ``most`` operations is ranked in one task. The distinct values of larger ones
    are dealt by ranges, so that each task has its share of a group however large it is, and only the ranges that hold a
    wanted rank are ranked further. A group with a bucket is asked by its sketch.
    """
    large = written(crowded(ops, span, most, start, end))
    n_large = large.count()
    large = None if not n_large else large.hint("broadcast") if n_large <= BROADCAST else large
    observed = _observed(ops, span, start, end)
    if buckets is None:
        return _exact(observed, wanted, large)
    old = between(buckets, start, end)
    groups = old.select("series", bucket_start(F.col("t"), span).alias("t")).distinct()
    flagged = _met(observed, groups.withColumn("mixed", F.lit(True)), "left")
    own = flagged.where("mixed").select(*GROUP, "value")
    asked = combined_buckets(old, span, own).select(*GROUP, *(sketches.quantile(F.col("sketch"), q).alias(c) for c, q in wanted.items()))
    return asked.unionByName(_exact(flagged.where("mixed is null"), wanted, large))


def _exact(observed: DataFrame, wanted: dict[str, float], large: DataFrame | None) -> DataFrame:
    counted = observed.groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("n"))
    if large is None:
        return _picked(counted, wanted)
    return _picked(_met(counted, large, "left_anti"), wanted).unionByName(_picked_by_ranges(_met(counted, large, "left_semi"), wanted))


def _rank(q: float, total: Column) -> Column:
    return F.greatest(F.ceil(F.lit(q) * total), F.lit(1)).cast("bigint")


def _known(q: float) -> bool:
    return not math.isnan(q) and 0 <= q <= 1


def _picked(rows: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles of rows (series, t, value, n): the first value whose running count reaches ceil(q n)."""
    group = Window.partitionBy(*GROUP)
    running = rows.withColumn("cum", F.sum("n").over(group.orderBy("value"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("cum") >= _rank(q, F.col("total")), F.col("value"))) if _known(q) else F.lit(float("nan"))
    return running.groupBy(*GROUP).agg(*(at(q).alias(c) for c, q in wanted.items()))


def _picked_by_ranges(rows: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """As _picked. Ranges are written with their rows, so that all reads agree on them; a group has at most as many of them
    as there are partitions, and a range is no larger than a partition."""
    ranged = written(rows.repartitionByRange(*GROUP, "value").withColumn("range", F.spark_partition_id()))
    parts = ranged.groupBy(*GROUP, "range").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*GROUP)
    parts = parts.withColumn("cum", F.sum("n").over(group.orderBy("range"))).withColumn("total", F.sum("n").over(group))
    ranks = F.array(*(F.struct(F.lit(c).alias("q"), _rank(q, F.col("total")).alias("rank")) for c, q in wanted.items() if _known(q)), F.struct(F.lit("").alias("q"), F.lit(1).cast("bigint").alias("rank")))
    holds = lambda rank: (F.col("cum") >= rank) & (F.col("cum") - F.col("n") < rank)
    targets = parts.select("*", F.explode(ranks).alias("r")).where(holds(F.col("r.rank")))
    targets = targets.select(*GROUP, "range", F.col("r.q").alias("q"), (F.col("r.rank") - F.col("cum") + F.col("n")).alias("rest"))
    within = _met(ranged, targets, "inner", "range").withColumn("cum", F.sum("n").over(Window.partitionBy(*GROUP, "range", "q").orderBy("value")))
    found = within.where(holds(F.col("rest"))).select(*GROUP, "q", "value")
    at = lambda c, q: F.max(F.when(F.col("q") == c, F.col("value"))) if _known(q) else F.lit(float("nan"))
    return found.groupBy(*GROUP).agg(*(at(c, q).alias(c) for c, q in wanted.items()))
