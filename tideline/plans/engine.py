"""Handles on series: buffered writes, reads of one or all series, compaction."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Iterable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.identity import default_replica, fnv1a_64
from tideline.functions.series import Agg
from tideline.operators import compact, distributions, read, resolve
from tideline.operators.sketches import sketch_range
from tideline.schema import KINDS
from tideline.sources import database  # noqa: F401  registers its scheme
from tideline.sources.store import ConflictError, open_store

_COMPACT = {"samples": compact.compact_samples, "counters": compact.compact_counters, "sketches": compact.compact_sketches}


class Engine:
    """An engine over a store. Single writes go to a buffer and are committed by flush(), on close, every flush_every seconds,
    or when most_buffered of a kind are there; whole tables go to the store's append().

    With ``compact_every`` the series that handles were asked for (all of a kind, by a handle on all) are compacted in the
    background, each time after that many seconds and up to ``jitter`` more. What fails in the background is tried again the
    next time; ``failed`` tells what it was.
    """

    def __init__(self, spark: SparkSession, store, replica: str | None = None, flush_every: float | None = None, compact_after: int = 86_400, compact_span: int = 3_600, compact_every: float | None = None, jitter: float = 0, most_buffered: int = 100_000) -> None:
        if any(x is not None and x <= 0 for x in (flush_every, compact_every)) or jitter < 0:
            store.close()
            raise ValueError("intervals must be positive")
        self.spark, self.store = spark, store
        self.replica = fnv1a_64(replica) if replica is not None else default_replica()
        self.compact_after, self.compact_span = compact_after, compact_span
        self._lock, self._buffer, self._clock = threading.RLock(), {k: [] for k in KINDS}, {}
        self._stop = threading.Event()
        self._seen: dict[str, set[str | None]] = {}
        # Flushes are numbered, so that one whose outcome is not known can be sent again.
        self._writer, self._flushed, self._sent = uuid.uuid4().hex, dict.fromkeys(KINDS, 0), {}
        self._writes = 0
        #: What the last act in the background ran into, if it did.
        self.failed: Exception | None = None
        self.most_buffered = most_buffered
        if flush_every:
            threading.Thread(target=self._loop, args=(flush_every, 0, self.flush), daemon=True).start()
        if compact_every:
            threading.Thread(target=self._loop, args=(compact_every, jitter, self._compact_seen), daemon=True).start()

    @classmethod
    def open(cls, spark: SparkSession, uri: str, **options) -> Engine:
        return cls(spark, open_store(spark, uri), **options)

    def samples(self, series: str | None = None) -> Samples:
        self._seen.setdefault("samples", set()).add(series)
        return Samples(self, "samples", series)

    def counters(self, series: str | None = None) -> Counters:
        self._seen.setdefault("counters", set()).add(series)
        return Counters(self, "counters", series)

    def sketches(self, series: str | None = None) -> Sketches:
        self._seen.setdefault("sketches", set()).add(series)
        return Sketches(self, "sketches", series)

    def write(self, kind: str, series: str, at: float, value: float | int) -> None:
        with self._lock:
            # A logical clock above every committed one: the store's version, then the write's number.
            version = self._clock.setdefault(kind, self.store.version(kind))
            rows = self._buffer[kind]
            row = {"series": series, "t": int(at // 1), "value": value, "clock": (version + 1 << 32) + self._writes, "replica": self.replica}
            rows.append(tuple(row[c.split()[0]] for c in KINDS[kind][0].split(", ")))
            self._writes += 1
            if len(rows) >= self.most_buffered:
                self.flush()

    def pending(self, kind: str, first: int | None = None) -> DataFrame:
        """The operations of the buffer, or the first so many."""
        from decimal import Decimal

        with self._lock:
            at = [c.split()[0] for c in KINDS[kind][0].split(", ")].index("replica")
            rows = [(*r[:at], Decimal(r[at]), *r[at + 1 :]) for r in self._buffer[kind][:first]]
        return self.spark.createDataFrame(rows, KINDS[kind][0])

    def state(self, kind: str, version: int | None = None, series: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Operations and buckets of one committed state, and the operations of the buffer; without it of an older version.
        With a series, at least those of it."""
        asked = {k: v for k, v in (("version", version), ("only", None if series is None else [series])) if v is not None}
        with self._lock:
            _, ops, buckets = self.store.state(kind, **asked)
            return (ops.unionByName(self.pending(kind)) if self._buffer[kind] and version is None else ops), buckets

    def ops(self, kind: str) -> DataFrame:
        """Committed operations and those of the buffer."""
        return self.state(kind)[0]

    def flush(self) -> None:
        """Commits what is buffered. What fails stays buffered, and a later flush sends it under the same number."""
        with self._lock:
            for kind, rows in self._buffer.items():
                while rows:
                    # A number stands for the same rows whenever it is sent.
                    n = self._sent.setdefault(kind, len(rows))
                    self.store.append(kind, self.pending(kind, n), self._writer, self._flushed[kind])
                    self._flushed[kind] += 1
                    del rows[: self._sent.pop(kind)]
                self._clock.pop(kind, None)

    def compact(self, kind: str | None = None, cutoff: int | None = None, span: int | None = None, series: str | Iterable[str] | None = None) -> bool:
        """Compacts one kind or all, one series, some or all; the cutoff is now less compact_after unless given.

        A kind that someone else is compacting is left to them; says whether all were free.
        """
        cutoff, span = int(time.time()) - self.compact_after if cutoff is None else cutoff, self.compact_span if span is None else span
        if self.compact_after <= 0 or span < 1:
            return True
        self.flush()
        free, names = True, [series] if isinstance(series, str) else None if series is None else list(series)
        for k in [kind] if kind else KINDS:

            def update(ops: DataFrame, buckets: DataFrame, k: str = k) -> tuple[DataFrame, DataFrame]:
                if names is None:
                    return _COMPACT[k](ops, buckets, cutoff, span, merged=True)
                mine = F.coalesce(F.col("series").isin(*names), F.lit(False))
                other = ~mine
                left, made = _COMPACT[k](ops.where(mine), buckets.where(mine), cutoff, span, merged=True)
                return left.unionByName(ops.where(other)), made.unionByName(buckets.where(other))

            # A store without leases is compacted as it is.
            with self.store.lease(k) if hasattr(self.store, "lease") else nullcontext(True) as got:
                free &= got
                if got:
                    self.store.replace(k, update, resolve.MERGES[k], only=names, rebase=True)
        return free

    def _compact_seen(self) -> None:
        for k, seen in sorted(self._seen.items()):
            try:
                self.compact(k, series=None if None in seen else sorted(seen))
                if hasattr(self.store, "vacuum"):
                    self.store.vacuum(k)
            except ConflictError:
                pass  # a write came first; the next round compacts what it wrote, too

    def _loop(self, every: float, jitter: float, act) -> None:
        while not self._stop.wait(every + random.uniform(0, jitter)):
            try:
                act()
                self.failed = None
            except Exception as e:  # noqa: BLE001  the next round tries again
                self.failed = e

    def close(self) -> None:
        self._stop.set()
        self.flush()
        self.store.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class _Handle:
    version: int | None = None

    def __init__(self, engine: Engine, kind: str, series: str | None) -> None:
        self.engine, self.kind, self.series = engine, kind, series

    def at(self, version: int) -> _Handle:
        """The same series as of an older version of a store that keeps them."""
        other = type(self)(self.engine, self.kind, self.series)
        other.version = version
        return other

    def _mine(self, df: DataFrame) -> DataFrame:
        return df if self.series is None else df.where(F.col("series") == self.series)

    def _state(self) -> tuple[DataFrame, DataFrame]:
        ops, buckets = self.engine.state(self.kind, self.version, self.series)
        return self._mine(ops), self._mine(buckets)

    def _write(self, at: float, value: float | int) -> None:
        if self.series is None:
            raise ValueError("a write needs a series")
        self.engine.write(self.kind, self.series, at, value)

    def compact(self, cutoff: int | None = None, span: int | None = None) -> None:
        self.engine.compact(self.kind, cutoff, span, self.series)

    def delete(self) -> None:
        self.engine.flush()
        self.engine.store.delete(self.kind, self.series)


class Samples(_Handle):
    def set(self, at: float, value: float) -> None:
        self._write(at, float(value))

    def values(self, start: int | None = None, end: int | None = None) -> DataFrame:
        ops, buckets = self._state()
        return read.sample_values(ops, buckets, start, end).orderBy("series", "t")

    def range(self, start: int | None, end: int | None, span: int, agg: Agg) -> DataFrame:
        ops, buckets = self._state()
        return read.sample_range(ops, span, agg, buckets, start, end).orderBy("series", "t")


class Counters(_Handle):
    def add(self, at: float, delta: int) -> None:
        if delta < 0:
            raise ValueError("a counter only grows")
        self._write(at, int(delta))

    def values(self, start: int | None = None, end: int | None = None) -> DataFrame:
        ops, buckets = self._state()
        return read.counter_values(ops, buckets, start, end).orderBy("series", "t")

    def range(self, start: int | None, end: int | None, span: int, agg: Agg) -> DataFrame:
        ops, buckets = self._state()
        return read.counter_range(ops, span, agg, buckets, start, end).orderBy("series", "t")


class Sketches(_Handle):
    def add(self, at: float, value: float) -> None:
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("an observation must be finite")
        self._write(at, float(value))

    def values(self, start: int | None = None, end: int | None = None, quantiles: dict[str, float] | None = None) -> DataFrame:
        return self.range(start, end, 0, quantiles)

    def range(self, start: int | None, end: int | None, span: int, quantiles: dict[str, float] | None = None) -> DataFrame:
        """Count, sum, min, max, mean and the wanted quantiles of each bucket."""
        ops, buckets = self._state()
        told = distributions.stats(ops, span, buckets, start, end)
        if quantiles:
            told = told.join(distributions.quantiles(ops, span, quantiles, buckets, start, end), ["series", "t"])
        return told.orderBy("series", "t")

    def sketches(self, start: int | None, end: int | None, span: int) -> DataFrame:
        """(series, t, sketch) of each bucket: a value to keep, to merge further and to ask (tideline.functions.sketches)."""
        ops, buckets = self._state()
        return sketch_range(ops, span, buckets, start, end)

    def merged(self) -> DataFrame:
        return resolve.sketches(self._state()[0])
