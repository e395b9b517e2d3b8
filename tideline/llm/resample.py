"""Importance resampling of documents towards a target distribution.

Features of a text are its runs of up to RUNS words, hashed to BUCKETS buckets. One pass counts the buckets of all
documents and of all target texts; the gain of a bucket, the scaled log ratio of its smoothed shares, goes to an array of
fixed size, and a second pass scores each document by the mean of its features' gains. Adding Gumbel noise that a hash of
the id gives makes the highest scores a draw without replacement in proportion to the weights.

The k-th highest score is found exactly and without a sort: rows are counted by the digits of the composite key (score,
doc_id, row), the digit that holds the k-th row narrows the rows that the next count looks at, and only counts of one
digit come to the driver. Rows up to that key, and only they, are then sorted by ranges; a row's rank is its place within
its range behind the counts of the ranges before it.

Edge cases: a null text counts as empty; a text without words has no features and weight 0; a null doc_id is drawn from
the hash of the bare seed and loses every tie; rows that repeat an id are weighed and drawn each by itself, and of wholly
equal rows the first read wins; an empty table gives an empty result, empty target texts count nothing; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tideline.llm.common import materialise

#: Words of the longest run, buckets, scale of gains and scores.
RUNS, BUCKETS, SCALE = 2, 10_000, 1000
#: Bits of the digits that keys are counted by.
DIGIT = 16
#: A-Z become a-z; whatever is neither an ASCII letter or digit nor beyond ASCII parts words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bits of monotonically_increasing_id that count within a partition.
_WITHIN = (1 << 33) - 1


def feature_hashes(text: str | None) -> tuple[int, list[int]]:
    """Number of words, and the CRC-32 of each run of words joined by spaces: single words first, then pairs, and so on."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()
    spaced = [b" " + w for w in words]
    run = list(map(crc32, words))
    found = list(run)
    for k in range(1, RUNS):
        # The hash of a run goes on from that of the run without its last word.
        run = list(map(crc32, spaced[k:], run))
        found += run
    return len(words), found


def _buckets(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, dtype=np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all texts; each task sends one row a bucket that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                _, hashes = feature_hashes(text.as_py())
                total += np.bincount(_buckets(hashes), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of each bucket's smoothed share in the target to that in the source, rounded down."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log(float(t + 1) * float(s_all + BUCKETS) / (float(s + 1) * float(t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            words, features, weights = [], [], []
            for text in b.column(1):
                n, hashes = feature_hashes(text.as_py())
                words.append(n)
                features.append(len(hashes))
                weights.append(int(held[_buckets(hashes)].sum()) // len(hashes) if hashes else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, type=pa.int64()) for x in (words, features, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Scaled Gumbel noise, rounded down, from the first 32 bits of a hash of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def kth(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The k-th smallest composite key of the rows, from 1; keys are long columns without nulls.

    Of one key after the other, rows are counted by the highest DIGIT bits in which those left still differ, and the digit
    that holds the k-th row stays.
    """
    found: list[int] = []
    for key in keys:
        c = F.col(key)
        while True:
            ends = rows.agg(F.min(c).alias("low"), F.max(c).alias("high")).first()
            low, high = ends["low"], ends["high"]
            if low == high:
                break
            # A difference that does not fit a long is first told by sign.
            digit = (c >= 0).cast("long") if high - low >= 1 << 63 else F.shiftright(c - F.lit(low), max((high - low).bit_length() - DIGIT, 0))
            counted: list[Row] = sorted(rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect())
            for d, n in counted:
                if k <= n:
                    rows = rows.where(digit == F.lit(d))
                    break
                k -= n
        found.append(low)
    return found


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with their rank by keys, from 1: sorted in ranges, each range's ranks starting behind those before it."""
    place = (F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))).alias("place")
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("range"), place))
    # One row a range: as many as there are partitions.
    sizes, before, starts = sorted(placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()), 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = placed.sparkSession.createDataFrame(starts, "range int, before long")
    return placed.join(F.broadcast(starts), "range").withColumn("rank", F.col("before") + F.col("place") + 1).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs, all long.

    Of the documents of least_words words or more, percent of a hundred (rounded down) with the highest scores are drawn;
    the rank of the others is null.
    """
    scored = weighed(docs, gains(bucket_counts(docs), bucket_counts(target)))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Keys in ascending order of choice. They are written, so that row holds for every later read.
    rows = materialise(scored.select("*", (-F.col("score")).alias("__low"), F.col("doc_id").isNull().cast("long").alias("__none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.monotonically_increasing_id().alias("__row")))
    keys, eligible = ["__low", "__none", "__id", "__row"], F.col("n_words") >= least_words
    told = ["doc_id", "n_features", "weight", "score"]
    wanted = percent * rows.where(eligible).count() // 100
    if not wanted:
        return rows.select(*told, F.lit(None).cast("long").alias("rank"))
    last = kth(rows.where(eligible).select(keys), keys, wanted)
    drawn = eligible & (F.struct(*keys) <= F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(keys, last, strict=True))))
    chosen = ranked(rows.where(drawn).select(*told, *keys), keys).select(*told, "rank")
    return chosen.unionByName(rows.where(~drawn).select(*told, F.lit(None).cast("long").alias("rank")))
