"""Compaction: points before a cutoff become epoch-aligned buckets. Each returns (operations left, buckets).

Both come from the merged operations; a caller that writes them one after the other merges once before and says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import sketches
from tideline.functions.series import bucket_start
from tideline.operators import resolve
from tideline.operators.sketches import GROUP, combined_buckets, sketched


def compact_samples(ops: DataFrame, buckets: DataFrame | None, cutoff: int, span: int, merged: bool = False) -> tuple[DataFrame, DataFrame | None]:
    if span < 1:
        return ops, buckets
    points = ops if merged else resolve.samples(ops)
    value = F.col("value")
    new = points.where(F.col("t") < int(cutoff)).groupBy("series", bucket_start(F.col("t"), span).alias("b")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.min_by(value, "t").alias("first"), F.max_by(value, "t").alias("last"),
    ).withColumnRenamed("b", "t")
    return points.where(F.col("t") >= int(cutoff)), new if buckets is None else resolve.sample_buckets(buckets, new)


def compact_counters(ops: DataFrame, buckets: DataFrame | None, cutoff: int, span: int, merged: bool = False) -> tuple[DataFrame, DataFrame | None]:
    if span < 1:
        return ops, buckets
    distinct = ops if merged else resolve.counters(ops)
    new = distinct.where(F.col("t") < int(cutoff)).groupBy("series", bucket_start(F.col("t"), span).alias("b")).agg(F.sum("value").alias("sum")).withColumnRenamed("b", "t")
    return distinct.where(F.col("t") >= int(cutoff)), new if buckets is None else resolve.counter_buckets(buckets, new)


def compact_sketches(ops: DataFrame, buckets: DataFrame | None, cutoff: int, span: int, merged: bool = False) -> tuple[DataFrame, DataFrame | None]:
    if span < 1:
        return ops, buckets
    resolved = ops if merged else resolve.sketches(ops)
    old = resolved.where(F.col("t") < int(cutoff)).select("series", bucket_start(F.col("t"), span).alias("t"), "value")
    made = sketched(old, GROUP) if buckets is None else combined_buckets(buckets, values=old)
    return resolved.where(F.col("t") >= int(cutoff)), _as_buckets(made)


def _as_buckets(held: DataFrame) -> DataFrame:
    return held.select(*GROUP, *sketches.as_bucket(F.col("sketch")))


def sketch_buckets(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Additive merge of buckets: counts, sums and bins add up, and at most MAX_BINS bins stay."""
    return _as_buckets(combined_buckets(older.unionByName(newer)))


State = dict[str, tuple[DataFrame, DataFrame]]
_BUCKETS = {"samples": resolve.sample_buckets, "counters": resolve.counter_buckets, "sketches": sketch_buckets}


def merged_states(older: State, newer: State) -> State:
    """Two states, each (operations, buckets) by kind, as one; a kind that one of them lacks is the other's."""
    one = {kind: older.get(kind) or newer[kind] for kind in {**older, **newer}}
    for kind in older.keys() & newer.keys():
        (ops, buckets), (more, later) = older[kind], newer[kind]
        one[kind] = resolve.MERGES[kind](ops.unionByName(more)), _BUCKETS[kind](buckets, later)
    return one
