"""Conflict-free merges of operations and of buckets. Each is one partial-then-final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def samples(ops: DataFrame) -> DataFrame:
    """Last write wins: per (series, t) the value of the greatest (clock, replica); an exact tie keeps the larger value."""
    return ops.groupBy("series", "t").agg(F.max(F.struct("clock", "replica", "value")).alias("w")).select("series", "t", "w.value", "w.clock", "w.replica")


def counters(ops: DataFrame) -> DataFrame:
    """Set of operations (series, t, replica, clock, value)."""
    return ops.select("series", "t", "replica", "clock", "value").distinct()


def sketches(ops: DataFrame) -> DataFrame:
    """One operation per (series, t, replica, clock): the value of the greatest bit pattern, so negative values outrank
    positive ones and the larger magnitude wins among equals of sign."""
    rank = F.struct((F.col("value") < 0).alias("negative"), F.abs("value").alias("size"), "value")
    return ops.groupBy("series", "t", "clock", "replica").agg(F.max(rank).alias("w")).select("series", "t", "w.value", "clock", "replica")


def sample_buckets(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Additive merge of buckets; the older side is first, the newer last. Empty buckets count for nothing."""
    both = older.withColumn("gen", F.lit(0)).unionByName(newer.withColumn("gen", F.lit(1))).where("count > 0")
    return both.groupBy("series", "t").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min_by("first", "gen").alias("first"), F.max_by("last", "gen").alias("last"),
    )


def counter_buckets(older: DataFrame, newer: DataFrame) -> DataFrame:
    return older.unionByName(newer).groupBy("series", "t").agg(F.sum("sum").alias("sum"))


MERGES = {"samples": samples, "counters": counters, "sketches": sketches}
