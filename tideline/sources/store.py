"""Stores of series: an append-only log of operations and compacted snapshots, both Parquet, tied by manifests.

A manifest names the log batches and the snapshot that make up one state of a kind. state() gives the operations and
buckets of one manifest, so a reader never sees half of what another has committed; older states can be read until
vacuum() takes them. Committing creates the next manifest, which must not exist yet: file systems that create a file
exclusively, such as HDFS or object stores with conditional writes, let one of two writers succeed. An append commutes
with whatever came first and commits on top of it; a snapshot does not and raises ConflictError, but for compactions, which
commit on top of appends. A batch that is sent again is applied once. A lease keeps two compactions from doing the same
work.

Series are dealt to parts by a hash, and a snapshot has a folder for each. Compacting or deleting some series reads and
writes their parts only, and the manifest tells of each batch of the log which parts of it are in a snapshot by now.
"""

from __future__ import annotations

import json
import os
import random
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext
from functools import reduce
from typing import NamedTuple
from urllib.parse import parse_qs, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.schema import KINDS
from tideline.sources.scratch import scratch, shared_folder  # noqa: F401

#: Seconds after which a lease that nobody renewed counts as left behind, and the least between two renewals.
LEASE, RENEWED = 30, 0.5
#: Times and seconds of waiting for a manifest that is just being written; after that its writer counts as lost.
TORN = (10, 0.1)
#: Commits that an append tries on top of others', and the longest wait between two, in seconds.
ATTEMPTS, PAUSE = 100, 0.2
#: Parts that series are dealt to by default. A store keeps the number that it began with.
PARTS = 16


def of_schema(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema in its order; raises ValueError if one is missing or of another type."""
    wanted, held = dict(c.split(" ", 1) for c in schema.split(", ")), dict(df.dtypes)
    wrong = {c: held.get(c) for c, kind in wanted.items() if held.get(c) != kind}
    if wrong:
        raise ValueError(f"columns that do not fit {schema}: {wrong}")
    return df.select(*wanted)


def named(series: str | None) -> Column:
    """Whether a row is of the series; of the one without a name, if that is meant."""
    return F.col("series").eqNullSafe(F.lit(series))


def part_of(series: str | None, parts: int) -> int:
    """The part that a series is in; the one without a name is in that of an empty name."""
    return zlib.crc32((series or "").encode()) % parts


def part(series: Column, parts: int) -> Column:
    """The same of a column."""
    return F.pmod(F.crc32(F.coalesce(series, F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def folders(entries: list[dict], parts: set[int] | None = None) -> Iterator[tuple[str, int]]:
    """Folders of a snapshot's parts, and when they were written."""
    for e in entries:
        yield from ((f"{e['path']}/part={p}", e["at"]) for p in e["parts"] if parts is None or p in parts)


@contextmanager
def renewed(ttl: float, renew: Callable[[], bool]) -> Iterator[None]:
    """Calls renew well within every ttl seconds while the block runs, until it says that there is nothing to renew."""
    done = threading.Event()

    def beat() -> None:
        while not done.wait(max(ttl / 3, RENEWED)) and renew():
            pass

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


class ConflictError(RuntimeError):
    """Another writer has committed first."""


class State(NamedTuple):
    """One state of a kind."""

    version: int
    ops: DataFrame
    buckets: DataFrame


class ParquetStore:
    """With ttl, a series is forgotten so many seconds after it was last written to."""

    def __init__(self, spark: SparkSession, root: str, ttl: int | None = None, parts: int = PARTS) -> None:
        if parts < 1:
            raise ValueError("a store has at least one part")
        self.spark, self.root, self.ttl, self.parts = spark, root.rstrip("/"), ttl, parts

    # Files -----------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self, kind: str) -> str:
        return f"{self.root}/{kind}/manifest"

    def version(self, kind: str) -> int:
        fs, p = self._fs(self._manifests(kind))
        return max(self._numbers(fs, p), default=0)

    @staticmethod
    def _numbers(fs, p) -> list[int]:
        """The files of a folder that are named by a number."""
        return [int(n) for s in (fs.listStatus(p) if fs.exists(p) else ()) if (n := s.getPath().getName()).isdigit()]

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _written(self, kind: str, version: int) -> dict | None:
        try:
            return json.loads(self._text(f"{self._manifests(kind)}/{version}"))
        except ValueError:
            return None
        except Py4JJavaError as e:
            raise ValueError(f"version {version} of {kind} is gone") from e

    def manifest(self, kind: str, version: int | None = None) -> dict:
        """The newest manifest, or the one of a version; one whose writer was lost stands for the one before."""
        newest = self.version(kind)
        version = newest if version is None else version
        if not 0 <= version <= newest:
            raise ValueError(f"{kind} has no version {version}")
        state = {"log": [], "ops": [], "buckets": [], "parts": self.parts, "applied": {}}
        for back in range(version, 0, -1):
            found = self._written(kind, back)
            for _ in range(TORN[0]):
                if found is not None or back < newest:
                    break
                time.sleep(TORN[1])
                found = self._written(kind, back)
            if found is not None:
                state = found
                break
        return state | {"version": version}

    def _create(self, path: str, text: str) -> bool:
        """Writes a file unless it is there."""
        fs, p = self._fs(path)
        if fs.getScheme() == "file":
            # Hadoop looks first and creates then; a link appears at once and whole, or not at all.
            name = p.toUri().getPath()
            own = f"{name}-{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(name), exist_ok=True)
            with open(own, "w") as f:
                f.write(text)
            try:
                os.link(own, name)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        try:
            self._write(fs.create(p, False), text)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        return True

    @staticmethod
    def _write(out, text: str) -> None:
        out.write(bytearray(text.encode()))
        out.close()

    def _commit(self, kind: str, state: dict) -> None:
        if not self._create(f"{self._manifests(kind)}/{state['version']}", json.dumps(state)):
            raise ConflictError(f"version {state['version']} of {kind} is there already")

    @contextmanager
    def lease(self, kind: str, ttl: float = LEASE) -> Iterator[bool]:
        """Whether this holder has the only lease of the kind. It is renewed while the block runs and ends with it; a lease
        that nobody has renewed for ttl seconds was left behind and may be taken.

        Leases are numbered files, of which the last counts. Whoever takes one over creates the next number, so of several
        that find the same one left behind a single one succeeds.
        """
        fs, folder = self._fs(f"{self.root}/{kind}/lease")
        file = lambda n: self._fs(f"{self.root}/{kind}/lease/{n}")[1]
        last = max(self._numbers(fs, folder), default=0)
        left = not last or fs.getFileStatus(file(last)).getModificationTime() < (time.time() - ttl) * 1000
        got = left and self._create(f"{self.root}/{kind}/lease/{last + 1}", "")
        if got and last:
            fs.delete(file(last), False)
        mine = lambda: max(self._numbers(fs, folder), default=0) == last + 1

        def renew() -> bool:
            if mine():
                fs.setTimes(file(last + 1), int(time.time() * 1000), -1)
                return True
            return False

        try:
            with renewed(ttl, renew) if got else nullcontext():
                yield got
        finally:
            if got and mine():
                fs.delete(file(last + 1), False)

    def vacuum(self, kind: str, keep: int = 2, grace: float = 3600) -> int:
        """Deletes what none of the newest ``keep`` manifests names and nobody has written to for ``grace`` seconds, older
        manifests included."""
        version, gone, old = self.version(kind), 0, (time.time() - grace) * 1000
        states = [s for v in range(version, max(version - keep, 0), -1) if (s := self._written(kind, v))]
        if not states:
            return 0
        used = {e["path"] for s in states for name in ("log", "ops", "buckets") for e in s[name]}
        parts = {path for s in states for name in ("ops", "buckets") for path, _ in folders(s[name])}
        for part in ("log", "ops", "buckets", "merged", "manifest"):
            fs, folder = self._fs(f"{self.root}/{kind}/{part}")
            for status in fs.listStatus(folder) if fs.exists(folder) else ():
                name = status.getPath().getName()
                stays = int(name) > version - keep if name.isdigit() else f"{self.root}/{kind}/{part}/{name}" in used
                if not stays and status.getModificationTime() < old:
                    gone += fs.delete(status.getPath(), True)
        # Of snapshots in use, the parts that later ones have replaced.
        for path in {path.rpartition("/")[0] for path in parts}:
            fs, folder = self._fs(path)
            for status in fs.listStatus(folder):
                stays = not status.isDirectory() or f"{path}/{status.getPath().getName()}" in parts
                if not stays and status.getModificationTime() < old:
                    gone += fs.delete(status.getPath(), True)
        return gone

    # State -----------------------------------------------------------------

    def append(self, kind: str, ops: DataFrame, writer: str = "", batch: int | None = None) -> None:
        """Adds operations. A batch number of a writer that is not above its last one has been applied already.

        Operations are written once; committing them is tried again on top of whatever others have committed meanwhile.
        """
        seen = lambda state: batch is not None and batch <= state["applied"].get(writer, -1)
        state = self.manifest(kind)
        if seen(state):
            return
        path, ops = f"{self.root}/{kind}/log/{uuid.uuid4().hex}", of_schema(ops, KINDS[kind][0])
        ops.withColumn("part", part(F.col("series"), state["parts"])).sortWithinPartitions("series", "t").write.parquet(path)
        for _ in range(ATTEMPTS):
            applied = state["applied"] | ({writer: batch} if batch is not None else {})
            entry = {"path": path, "at": int(time.time()), "gone": []}
            try:
                return self._commit(kind, state | {"version": state["version"] + 1, "log": [*state["log"], entry], "applied": applied})
            except ConflictError:
                time.sleep(random.uniform(0, PAUSE))
                state = self.manifest(kind)
                if seen(state):
                    return None
        raise ConflictError(f"{ATTEMPTS} others were first to commit {kind}")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _logged(self, kind: str, state: dict, parts: set[int] | None) -> Iterator[tuple[DataFrame, int]]:
        """Operations of the log that are in no snapshot, as few tables, and when they were written if that counts."""
        alike: dict[tuple, list[str]] = {}
        for b in state["log"]:
            alike.setdefault((tuple(b["gone"]), b["at"] if self.ttl else 0), []).append(b["path"])
        for (gone, at), paths in alike.items():
            if parts is None and not gone:
                yield self._read(paths, KINDS[kind][0]), at
            elif parts is None or parts - set(gone):
                left = ~F.col("part").isin(*gone) if parts is None else F.col("part").isin(*sorted(parts - set(gone)))
                yield self._read(paths, f"{KINDS[kind][0]}, part int").where(left).drop("part"), at

    def _of(self, kind: str, state: dict, parts: set[int] | None = None) -> State:
        """A manifest's rows, or those of some parts."""
        batches = list(self._logged(kind, state, parts))
        if not self.ttl:
            kept = {name: [p for p, _ in folders(state[name], parts)] for name in ("ops", "buckets")}
            tables = [df for df, _ in batches]
            if kept["ops"] or not tables:
                tables.insert(0, self._read(kept["ops"], KINDS[kind][0]))
            return State(state["version"], reduce(DataFrame.unionByName, tables), self._read(kept["buckets"], KINDS[kind][1]))
        # Each batch and each part with the time it was written; a series lives as long as its last batch.
        timed: dict[str, list[tuple[DataFrame, int]]] = {}
        for name, schema in zip(("ops", "buckets"), KINDS[kind], strict=True):
            alike: dict[int, list[str]] = {}
            for path, at in folders(state[name], parts):
                alike.setdefault(at, []).append(path)
            timed[name] = [(self._read([], schema), 0), *((self._read(paths, schema), at) for at, paths in alike.items())]
        timed["ops"] += batches
        times = reduce(DataFrame.unionByName, (df.select("series", F.lit(at).alias("at")) for df, at in timed["ops"] + timed["buckets"]))
        alive = times.groupBy("series").agg(F.max("at").alias("at")).where(F.col("at") > F.unix_timestamp() - self.ttl).select(F.col("series").alias("name"))
        living = lambda dfs: reduce(DataFrame.unionByName, (df for df, _ in dfs)).join(alive, F.col("series").eqNullSafe(F.col("name")), "left_semi")
        return State(state["version"], living(timed["ops"]), living(timed["buckets"]))

    def state(self, kind: str, version: int | None = None, only: Iterable[str | None] | None = None) -> State:
        """Operations and buckets of one manifest: the newest, or that of a version. With ``only``, nothing but the parts that
        these series are in is read."""
        state = self.manifest(kind, version)
        return self._of(kind, state, None if only is None else {part_of(s, state["parts"]) for s in only})

    def ops(self, kind: str) -> DataFrame:
        return self.state(kind).ops

    def buckets(self, kind: str) -> DataFrame:
        return self.state(kind).buckets

    def replace(self, kind: str, update: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], merge: Callable[[DataFrame], DataFrame] | None = None, only: Iterable[str | None] | None = None, rebase: bool = False) -> None:
        """A new snapshot from (operations, buckets), written in order of series and time, committed exactly once.

        With ``merge`` the operations are merged and written once, and update works on them. With ``only``, update gets the
        parts that these series are in, whole, and nothing else is read or written. With ``rebase`` it is committed on top of
        what others have appended meanwhile, which stays in the log.
        """
        state = self.manifest(kind)
        count = state["parts"]
        parts = set(range(count)) if only is None else {part_of(s, count) for s in only}
        _, ops, buckets = self._of(kind, state, None if only is None else parts)
        scratch = f"{self.root}/{kind}/merged/{uuid.uuid4().hex}"
        if merge:
            merged = merge(ops)
            merged.write.parquet(scratch)
            ops = self.spark.read.schema(merged.schema).parquet(scratch)
        made, at = {}, int(time.time())
        for name, df, schema in zip(("ops", "buckets"), update(ops, buckets), KINDS[kind], strict=True):
            columns, path = [c.split()[0] for c in schema.split(", ")], f"{self.root}/{kind}/{name}/{uuid.uuid4().hex}"
            dealt = df.select(*columns, part(F.col("series"), count).alias("part"))
            dealt.repartitionByRange("part", "series", "t").sortWithinPartitions("part", "series", "t").write.partitionBy("part").parquet(path)
            fs, folder = self._fs(path)
            found = sorted(int(n[5:]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("part="))
            if not parts.issuperset(found):
                raise ValueError(f"the update of some series of {kind} made rows of others")
            made[name] = {"path": path, "at": at, "parts": found}
        self._snapshot(kind, state, parts, made, rebase)
        if merge:
            fs, p = self._fs(scratch)
            fs.delete(p, True)

    def _snapshot(self, kind: str, state: dict, parts: set[int], made: dict[str, dict], rebase: bool) -> None:
        """Commits what was made of some parts of a state, in place of them."""
        known, now = {b["path"]: b for b in state["log"]}, state
        for _ in range(ATTEMPTS):
            if now is not state:
                same = all(now[name] == state[name] for name in made) and [b for b in now["log"] if b["path"] in known] == state["log"]
                if not rebase or not same:
                    break
            log = [b | {"gone": sorted({*b["gone"], *parts})} if b["path"] in known else b for b in now["log"]]
            tables = {name: [*(e | {"parts": left} for e in now[name] if (left := [p for p in e["parts"] if p not in parts])), new] for name, new in made.items()}
            try:
                return self._commit(kind, now | {"version": now["version"] + 1, "log": [b for b in log if len(b["gone"]) < now["parts"]], **tables})
            except ConflictError:
                now = self.manifest(kind)
        raise ConflictError(f"another has replaced or added to what version {state['version']} of {kind} had")

    def delete(self, kind: str, series: str | None) -> None:
        """Forgets a series at the next snapshot of its part, which is written at once."""
        self.replace(kind, lambda ops, buckets: (ops.where(~named(series)), buckets.where(~named(series))), only=[series])

    def close(self) -> None:
        pass


class CachedStore:
    """Keeps the state that it has read until something is committed."""

    def __init__(self, inner: ParquetStore) -> None:
        self.inner, self._kept = inner, {}

    def state(self, kind: str, version: int | None = None, only: Iterable[str | None] | None = None) -> State:
        """The whole of the newest state is kept, whatever is asked for."""
        if version is not None:
            return self.inner.state(kind, version, only)
        if kind not in self._kept or self._kept[kind].version != self.inner.version(kind):
            self._drop(kind)
            found = self.inner.state(kind)
            self._kept[kind] = State(found.version, found.ops.persist(), found.buckets.persist())
        return self._kept[kind]

    def _drop(self, kind: str) -> None:
        for df in self._kept.pop(kind, ())[1:]:
            df.unpersist()

    def ops(self, kind: str) -> DataFrame:
        return self.state(kind).ops

    def buckets(self, kind: str) -> DataFrame:
        return self.state(kind).buckets

    def close(self) -> None:
        for kind in list(self._kept):
            self._drop(kind)
        self.inner.close()

    def __getattr__(self, name: str):
        return getattr(self.inner, name)


_OPENERS: dict[str, Callable] = {}


def register(scheme: str, opener: Callable) -> None:
    """opener(spark, url) -> store; the last registration of a scheme holds."""
    _OPENERS[scheme] = opener


def open_store(spark: SparkSession, uri: str):
    url = urlsplit(uri)
    if not url.scheme:
        raise ValueError(f"no scheme in {uri!r}")
    if url.scheme not in _OPENERS:
        raise ValueError(f"no store is registered for {url.scheme!r}")
    return _OPENERS[url.scheme](spark, url)


def _parquet(spark: SparkSession, url) -> ParquetStore:
    query = parse_qs(url.query)
    root = query["at"][0] if "at" in query else f"{url.netloc}{url.path}"
    store = ParquetStore(spark, root, int(query["ttl"][0]) if "ttl" in query else None, int(query.get("parts", [PARTS])[0]))
    return CachedStore(store) if query.get("cache") == ["1"] else store


def _memory(spark: SparkSession, url) -> ParquetStore:
    """A store for one session, in a scratch folder: a series expires ttl seconds (default a day) after its last write."""
    return ParquetStore(spark, scratch(spark), int(parse_qs(url.query).get("ttl", ["86400"])[0]))


register("parquet", _parquet)
register("memory", _memory)
