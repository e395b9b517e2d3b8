"""Schemas of the six tables, and how rows of other tables become operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = "series string, t bigint, value double, clock bigint, replica decimal(20,0)"
SAMPLE_OPS = SKETCH_OPS = OPS
SAMPLE_BUCKETS = "series string, t bigint, count bigint, sum double, min double, max double, first double, last double"
COUNTER_OPS = "series string, t bigint, replica decimal(20,0), clock bigint, value bigint"
COUNTER_BUCKETS = "series string, t bigint, sum bigint"
SKETCH_BUCKETS = "series string, t bigint, count bigint, sum double, min double, max double, zero bigint, neg map<int,bigint>, pos map<int,bigint>"
KINDS = {
    "samples": (SAMPLE_OPS, SAMPLE_BUCKETS),
    "counters": (COUNTER_OPS, COUNTER_BUCKETS),
    "sketches": (SKETCH_OPS, SKETCH_BUCKETS),
}


def seconds(ts: Column) -> Column:
    """Whole Unix seconds, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def ops(df: DataFrame, kind: str, series: Column, t: Column, value: Column, clock: Column, replica: Column) -> DataFrame:
    """Any table as operations of a kind. Counter deltas must not be negative, sketch values must be finite."""
    number = value.cast("bigint" if kind == "counters" else "double")
    named = df.select(series.cast("string").alias("series"), t.cast("bigint").alias("t"), number.alias("value"), clock.cast("bigint").alias("clock"), replica.cast("decimal(20,0)").alias("replica"))
    # The checks stand in a projection of their own, so that a costly value (out of JSON, say) is worked out once a row.
    number = F.col("value")
    if kind == "counters":
        number = F.when(F.assert_true(F.coalesce(number >= 0, F.lit(True)), F.lit("a counter only grows")).isNull(), number)
    if kind == "sketches":
        finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
        number = F.when(F.assert_true(F.coalesce(finite, F.lit(True)), F.lit("an observation must be finite")).isNull(), number)
    return named.select(*(number.alias(c) if c == "value" else c for c in (c.split()[0] for c in KINDS[kind][0].split(", "))))
