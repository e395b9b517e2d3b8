"""Exact deduplication of batches against immutable snapshots.

A snapshot is the finished index of a batch: one row for each different text that no earlier snapshot holds (digest, how
often it occurs, the row of it that stays), with a static binary-fuse filter of each bucket of digests. Nothing in it
ever changes; what a later batch brings makes a snapshot of its own. A batch goes through these steps:

* New-batch duplicates are grouped by digest within the batch, whichever snapshot may hold them, too.
* The batch's different digests meet the filters of each snapshot, bucket by bucket. One that a filter rejects is new
  for sure; those that pass, about 1 in 256 of the new ones among them, join the snapshot's exact bucket.
* Texts whose digest occurs more than once, within a batch or in several, are compared byte for byte: they are grouped by
  digest and text. Where texts of one digest differ, the text itself tells them apart from then on.

Only digests are shuffled, and the texts whose digest occurs more than once; while these digests are few they are
broadcast to find the texts, beyond that all texts are grouped. Copies are counted before each shuffle, so that a text
with very many of them costs a row a task, and rows find the totals of such a text, of which there are few, by broadcast.

Edge cases: a null text counts as empty, and is then equal to an empty one; a null doc_id is smaller than any other; of
rows that repeat doc_id and text one stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialise
from tideline.llm.hashing import U, mix

#: Digests of a bucket, and of a batch that meet a bucket's filter in one group.
BUCKET_KEYS = 2048
#: Repeated digests that are broadcast to find their texts, about 100 bytes each.
BROADCAST = 1 << 18
#: Of texts with more than a HOT-th of all rows there are fewer than HOT.
HOT = 1000
#: Seeds that are tried for a filter; one in some tens of thousands of keys' layouts fails.
_SEEDS = 100
#: What tells texts apart.
KEY = ["digest", "odd"]


@dataclass
class FuseFilter:
    """A static filter of 64-bit keys with a byte a slot: a key may be there if its three slots, which lie in
    three neighbouring segments, xor to its fingerprint."""

    seed: int
    segment: int
    segments: int
    slots: np.ndarray

    @staticmethod
    def _hashed(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of each key, a row for each of the three, and fingerprints."""
        h = mix(keys + mix(np.array([seed], dtype=np.uint64)))
        first = ((h >> U(32)) * U(segment * segments)) >> U(32)
        mask = U(segment - 1)
        second, third = (first + U(segment)) ^ ((h >> U(18)) & mask), (first + U(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> U(32))) & U(255)).astype(np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray) -> FuseFilter:
        """The filter of distinct keys. Keys that alone have a slot are taken off, round by round, until none is left, and
        slots are then set in the opposite order; should keys be left over, another seed is tried."""
        n = max(len(keys), 2)
        segment = 1 << min(max(int(np.log(n) / np.log(3.33) + 2.25), 2), 18)
        wanted = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))
        segments = max(-(-wanted // segment) - 2, 1)
        size = segment * (segments + 2)
        for seed in range(1, _SEEDS):
            at, prints = cls._hashed(keys, seed, segment, segments)
            count = np.bincount(at.ravel(), minlength=size)
            held = np.zeros(size, dtype=np.int64)
            numbers = np.arange(len(keys))
            for row in at:
                np.bitwise_xor.at(held, row, numbers)
            taken: list[tuple[np.ndarray, np.ndarray]] = []
            done = 0
            single = np.flatnonzero(count == 1)
            while len(single):
                # A key alone in several slots is taken off by one of them.
                key, where = np.unique(held[single], return_index=True)
                slot = single[where]
                taken.append((key, slot))
                done += len(key)
                for row in at[:, key]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(held, row, key)
                near = np.unique(at[:, key])
                single = near[count[near] == 1]
            if done == len(keys):
                out = np.zeros(size, dtype=np.uint8)
                for key, slot in reversed(taken):
                    # The slot itself is still 0, so it drops out of its own key's sum.
                    out[slot] = prints[key] ^ out[at[0, key]] ^ out[at[1, key]] ^ out[at[2, key]]
                return cls(seed, segment, segments, out)
        raise ValueError("no seed lets these keys be laid out; are they distinct?")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._hashed(keys, self.seed, self.segment, self.segments)
        return (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]) == prints


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Snapshot:
    """index (bucket, digest, odd, n, last) has a row for each different text, filters one for each bucket."""

    index: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def of(cls, index: DataFrame) -> Snapshot:
        """Freezes an index (digest, odd, n, last): both tables are written once."""
        index = materialise(index.withColumn("key", F.xxhash64("digest")))
        buckets = max(1, -(-index.count() // BUCKET_KEYS))
        index = index.withColumn("bucket", F.pmod("key", F.lit(buckets)))

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            f = FuseFilter.of(np.unique(_keys(rows)))
            return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "seed": f.seed, "segment": f.segment, "segments": f.segments, "slots": f.slots.tobytes()})

        filters = index.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket long, seed long, segment long, segments long, slots binary")
        return cls(index.drop("key"), materialise(filters), buckets)


def _keys(rows: pd.DataFrame) -> np.ndarray:
    return rows["key"].to_numpy(dtype=np.int64).view(np.uint64)


def screened(digests: DataFrame, held: Snapshot) -> DataFrame:
    """(bucket, digest) of those of the distinct digests that may be in the snapshot.

    A bucket may meet many more digests than it holds; its filter is then sent to several groups.
    """
    groups = max(1, -(-digests.count() // (held.buckets * BUCKET_KEYS)))
    keyed = digests.select("digest", F.xxhash64("digest").alias("key")).withColumn("bucket", F.pmod("key", F.lit(held.buckets)))
    keyed = keyed.withColumn("part", F.pmod(F.hash("key"), F.lit(groups)))
    filters = held.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters) or not len(rows):
            return rows[["bucket", "digest"]].iloc[:0]
        seed, segment, segments, slots = filters.iloc[0][["seed", "segment", "segments", "slots"]]
        f = FuseFilter(int(seed), int(segment), int(segments), np.frombuffer(slots, dtype=np.uint8))
        return rows.loc[f.may_hold(_keys(rows)), ["bucket", "digest"]]

    return keyed.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInPandas(meet, "bucket long, digest binary")


def repeated(batches: list[DataFrame]) -> DataFrame:
    """(digest, odd, n, last) of the texts that occur more than once in the batches of rows (digest, odd, doc_id, batch, row),
    in which odd is empty unless texts of one digest differ; last is the row that stays."""
    snapshots: list[Snapshot] = []
    again: list[DataFrame] = []
    for k, rows in enumerate(batches):
        own = materialise(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "batch", "row")).alias("last")))
        for held in snapshots:
            found = screened(own.select("digest").distinct(), held).join(held.index.select("bucket", *KEY), ["bucket", "digest"]).select(*KEY)
            found = materialise(found)
            again.append(own.join(found, KEY, "left_semi"))
            own = own.join(found, KEY, "left_anti")
        # The last batch meets nobody any more.
        snapshots.append(Snapshot.of(own) if k < len(batches) - 1 else Snapshot(own, own, 0))
    told = ["digest", "odd", "n", "last"]
    index = reduce(DataFrame.unionByName, (s.index.select(told) for s in snapshots))
    if not again:
        return materialise(index.where("n > 1"))
    more = materialise(reduce(DataFrame.unionByName, again).select(told))
    met = index.join(more.select(KEY).distinct(), KEY, "left_semi").unionByName(more).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return materialise(met.unionByName(index.where("n > 1").join(more.select(KEY), KEY, "left_anti")))


def differing(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """The digests (digest) among the distinct ones given of which texts (digest, text) differ, by their bytes."""
    if digests.count() <= BROADCAST:
        texts = texts.join(F.broadcast(digests), "digest", "left_semi")
    each = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def deduplicate(batches: list[DataFrame], digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row of the batches (doc_id, text), which came in this order.

    Of equal texts the row with the largest doc_id stays.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = [b.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.lit(k).alias("batch"), F.monotonically_increasing_id().alias("row")) for k, b in enumerate(batches)]
    columns = ["doc_id", "batch", "row", *KEY]
    rows = [materialise(r.withColumn("odd", F.lit("")).select(columns)) for r in read]
    groups = repeated(rows)
    texts = reduce(DataFrame.unionByName, (r.select("digest", "text") for r in read))
    odd = materialise(differing(texts, groups.select("digest")))
    if odd.limit(1).count():
        mark = odd.withColumn("mark", F.lit("="))
        rows = [materialise(r.join(mark, "digest", "left").withColumn("odd", F.coalesce(F.concat("mark", "text"), F.lit(""))).select(columns)) for r in read]
        groups = repeated(rows)
    rows = reduce(DataFrame.unionByName, rows)
    hot = F.col("n") > rows.count() / HOT
    few, others = F.broadcast(groups.where(hot)), groups.where(~hot)
    joined = rows.join(few, KEY).unionByName(rows.join(few, KEY, "left_anti").join(others, KEY, "left"), allowMissingColumns=True)
    stays = (F.col("last.batch") == F.col("batch")) & (F.col("last.row") == F.col("row"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id"))
    return joined.select("doc_id", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(stays, F.lit(True)).alias("kept"))
