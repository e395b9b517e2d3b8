"""Streaming ingest: micro-batches of operations to a store's log, and live last-write-wins state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions.series import bucket_start
from tideline.operators.sketches import combined, sketched


def _triggered(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(act)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest(stream: DataFrame, store, kind: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends each micro-batch once: the store skips a batch number that it has applied. Late data is always accepted
    and merged on read. Without ``every`` it takes what is there and ends."""
    return _triggered(stream, lambda batch, number: store.append(kind, batch, checkpoint, number), checkpoint, "append", every)


def live_samples(ops: DataFrame) -> DataFrame:
    """Last write wins as streaming state: (series, t, value), for update or complete mode."""
    return ops.groupBy("series", "t").agg(F.max(F.struct("clock", "replica", "value")).alias("w")).select("series", "t", "w.value")


def keep_latest(ops: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Changed (series, t, value) rows of each micro-batch, as Parquet with the batch's number; a rerun overwrites its own."""
    return put_latest(live_samples(ops), path, checkpoint, every)


def put_latest(changed: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """What a stream in update mode changes, by batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _triggered(changed, put, checkpoint, "update", every)


#: What tells operations apart, by kind; samples are not additive.
IDENTITY = {"counters": ["series", "t", "replica", "clock", "value"], "sketches": ["series", "t", "replica", "clock"]}


def rollup(ops: DataFrame, kind: str, span: int, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Adds up each micro-batch's own operations by bucket, as Parquet with the batch's number; rolled() folds them.

    Built-in operators only: state keeps out operations that came before, so what batches add is disjoint, no batch reads
    what earlier ones have written, and a late operation adds a row to its bucket. Of sketch operations of one identity
    and different values the first counts; live_range() has the greatest.
    """
    fresh = ops.dropDuplicates(IDENTITY[kind])
    by = ["series", "t"]

    def add(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("t", bucket_start(F.col("t"), span))
        if kind == "sketches":
            made = sketched(placed, by)
        else:
            v = F.col("value")
            made = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
        made.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _triggered(fresh, add, checkpoint, "append", every)


def rolled(parts: DataFrame, kind: str) -> DataFrame:
    """Each bucket of what rollup() has written: (series, t, count, sum, min, max) or (series, t, sketch)."""
    if kind == "sketches":
        return combined(parts, ["series", "t"])
    return parts.groupBy("series", "t").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
