"""A store of series in a database that Spark reaches by JDBC.

Each snapshot is a pair of tables with a name of its own; one row for each kind says which pair is current. Its version
grows with every commit, and a snapshot is only made current by a writer that still finds the version it started from.

Tasks write what is appended to a table of its own; one transaction then moves its rows to the current pair, counts the
version up and notes the batch number, so all of a batch is there or nothing, and once. Rows carry PART, a hash of their
series. Reads are dealt by it, and parts of many rows by ranges of time as well.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.schema import KINDS
from tideline.sources.store import LEASE, PARTS, ConflictError, State, named, of_schema, part_of, register, renewed
from tideline.sources.store import part as hashed

_MAPS = ("neg", "pos")
#: Rows of a part from which on it is read by several tasks.
TASK_ROWS = 1_000_000
#: The part of the series without a name.
NAMELESS = -1
#: Seconds after which a table of an append that never came to its transaction may be dropped.
STAGED = 3600


class DatabaseStore:
    def __init__(self, spark: SparkSession, url: str, **properties: str) -> None:
        self.spark, self.url, self.properties = spark, url, properties
        with self._connected() as c:
            if not c.getMetaData().getTables(None, None, "TIDELINE_STATE", None).next():
                self._run(c, "CREATE TABLE TIDELINE_STATE (KIND VARCHAR(16) PRIMARY KEY, VERSION INTEGER NOT NULL, CURRENT_PAIR VARCHAR(64) NOT NULL, HOLDER VARCHAR(64), HELD_UNTIL BIGINT NOT NULL)")
                self._run(c, "CREATE TABLE TIDELINE_APPLIED (KIND VARCHAR(16) NOT NULL, WRITER VARCHAR(512) NOT NULL, BATCH BIGINT NOT NULL, PRIMARY KEY (KIND, WRITER))")
                for kind in KINDS:
                    self._run(c, f"INSERT INTO TIDELINE_STATE VALUES ('{kind}', 0, '0_first', NULL, 0)")
                    self._write(kind, "0_first", *(spark.createDataFrame([], s) for s in KINDS[kind]))

    @contextmanager
    def _connected(self) -> Iterator[object]:
        jvm = self.spark._jvm
        wanted = jvm.java.util.Properties()
        for k, v in self.properties.items():
            wanted.setProperty(k, v)
        c = jvm.java.sql.DriverManager.getConnection(self.url, wanted)
        try:
            yield c
        finally:
            c.close()

    @staticmethod
    def _run(c: object, sql: str) -> int:
        return c.createStatement().executeUpdate(sql)

    def _state(self, kind: str) -> tuple[int, str]:
        """The version and the name of the current pair of tables."""
        with self._connected() as c:
            found = c.createStatement().executeQuery(f"SELECT VERSION, CURRENT_PAIR FROM TIDELINE_STATE WHERE KIND = '{kind}'")
            found.next()
            return found.getInt(1), found.getString(2)

    def version(self, kind: str) -> int:
        return self._state(kind)[0]

    def _write(self, kind: str, pair: str, ops: DataFrame, buckets: DataFrame) -> None:
        self._put(ops, KINDS[kind][0], f"{kind}_ops_{pair}")
        self._put(buckets, KINDS[kind][1], f"{kind}_buckets_{pair}")

    def _put(self, df: DataFrame, schema: str, table: str) -> None:
        columns = [c.split()[0] for c in schema.split(", ")]
        none = F.col("series").isNull()
        part = F.when(none, NAMELESS).otherwise(hashed(F.col("series"), PARTS)).alias("part")
        # Spark takes strings for CLOBs and cannot send a null one to a VARCHAR.
        value = lambda c: F.to_json(c) if c in _MAPS else F.when(none, "").otherwise(F.col(c)) if c == "series" else F.col(c)
        flat = df.select(*(value(c).alias(c) for c in columns), part)
        writer = flat.write.option("createTableColumnTypes", "series VARCHAR(1024)" + "".join(f", {c} VARCHAR(32000)" for c in _MAPS if c in columns))
        writer.jdbc(self.url, table, "overwrite", dict(self.properties))
        with self._connected() as c:
            self._run(c, f'UPDATE {table} SET "series" = NULL WHERE "part" = {NAMELESS}')

    def _predicates(self, c: object, table: str, parts: set[int] | None) -> list[str]:
        """Disjoint conditions that cover the table, or some parts of it: its parts, those of many rows by ranges of time."""
        wanted = "" if parts is None else f'WHERE "part" IN ({", ".join(map(str, sorted(parts)))})'
        found, out = c.createStatement().executeQuery(f'SELECT "part", COUNT(*), MIN("t"), MAX("t") FROM {table} {wanted} GROUP BY "part"'), []
        while found.next():
            part, n, low, high = (found.getLong(k) for k in range(1, 5))
            pieces = min(-(-n // TASK_ROWS), high - low + 1)
            edges = [low + (high - low + 1) * k // pieces for k in range(1, pieces)]
            for first, last in zip([None, *edges], [*edges, None], strict=True):
                bounds = [f'"t" >= {first}'] * (first is not None) + [f'"t" < {last}'] * (last is not None)
                out.append(" AND ".join([f'"part" = {part}', *bounds]))
        return out or ["1 = 0"]

    def _read(self, c: object, kind: str, part: str, pair: str, parts: set[int] | None) -> DataFrame:
        table = f"{kind}_{part}_{pair}"
        df = self.spark.read.jdbc(self.url, table, predicates=self._predicates(c, table, parts), properties=dict(self.properties))
        kinds = dict(c.split(" ", 1) for c in KINDS[kind][part == "buckets"].split(", "))
        return df.select(*(F.transform_keys(F.from_json(c, "map<string,bigint>"), lambda k, _: k.cast("int")).alias(c) if c in _MAPS else F.col(c).cast(kinds[c]).alias(c) for c in kinds))

    def state(self, kind: str, only: Iterable[str | None] | None = None) -> State:
        """Operations and buckets of the pair that is current now; it stays as it is but for appends until vacuum() drops it.
        With ``only``, nothing but the parts that these series are in is read."""
        version, pair = self._state(kind)
        parts = None if only is None else {NAMELESS if s is None else part_of(s, PARTS) for s in only}
        with self._connected() as c:
            return State(version, self._read(c, kind, "ops", pair, parts), self._read(c, kind, "buckets", pair, parts))

    @contextmanager
    def _transaction(self) -> Iterator[object]:
        with self._connected() as c:
            c.setAutoCommit(False)
            try:
                yield c
                c.commit()
            except BaseException:
                c.rollback()
                raise

    def append(self, kind: str, ops: DataFrame, writer: str = "", batch: int | None = None) -> None:
        """Adds operations to whichever pair is current when they are all there. A batch number of a writer that is not
        above its last one has been applied already."""
        who = f"KIND = '{kind}' AND WRITER = '{writer.replace(chr(39), chr(39) * 2)}'"

        def last(c: object) -> int | None:
            found = c.createStatement().executeQuery(f"SELECT BATCH FROM TIDELINE_APPLIED WHERE {who}")
            return found.getLong(1) if found.next() else None

        with self._connected() as c:
            if batch is not None and (seen := last(c)) is not None and batch <= seen:
                return
        ops = of_schema(ops, KINDS[kind][0])
        table, columns = f"{kind}_staged_{int(time.time())}_{uuid.uuid4().hex[:12]}", ", ".join(f'"{c}"' for c in (*ops.columns, "part"))
        self._put(ops, KINDS[kind][0], table)
        with self._transaction() as c:
            # This row is held to the end, so that commits of a kind come one after the other.
            self._run(c, f"UPDATE TIDELINE_STATE SET VERSION = VERSION + 1 WHERE KIND = '{kind}'")
            seen = last(c)
            if batch is not None and seen is not None and batch <= seen:
                c.rollback()
                return
            found = c.createStatement().executeQuery(f"SELECT CURRENT_PAIR FROM TIDELINE_STATE WHERE KIND = '{kind}'")
            found.next()
            pair = found.getString(1)
            found.close()
            self._run(c, f"INSERT INTO {kind}_ops_{pair} ({columns}) SELECT {columns} FROM {table}")
            if batch is not None:
                values = writer.replace("'", "''")
                self._run(c, f"INSERT INTO TIDELINE_APPLIED VALUES ('{kind}', '{values}', {batch})" if seen is None else f"UPDATE TIDELINE_APPLIED SET BATCH = {batch} WHERE {who}")
            self._run(c, f"DROP TABLE {table}")

    def ops(self, kind: str) -> DataFrame:
        return self.state(kind).ops

    def buckets(self, kind: str) -> DataFrame:
        return self.state(kind).buckets

    @contextmanager
    def lease(self, kind: str, ttl: float = LEASE) -> Iterator[bool]:
        """Whether this holder has the only lease of the kind. It is renewed while the block runs and ends with it; a lease
        that nobody has renewed for ttl seconds was left behind and may be taken."""
        token = uuid.uuid4().hex

        def held(values: str, where: str) -> bool:
            with self._connected() as c:
                return self._run(c, f"UPDATE TIDELINE_STATE SET {values} WHERE KIND = '{kind}' AND {where}") == 1

        until = lambda: f"HOLDER = '{token}', HELD_UNTIL = {int((time.time() + ttl) * 1000)}"
        got = held(until(), f"(HOLDER IS NULL OR HELD_UNTIL < {int(time.time() * 1000)})")
        try:
            with renewed(ttl, lambda: held(until(), f"HOLDER = '{token}'")) if got else nullcontext():
                yield got
        finally:
            if got:
                held("HOLDER = NULL", f"HOLDER = '{token}'")

    def replace(self, kind: str, update: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], merge: Callable[[DataFrame], DataFrame] | None = None, only: Iterable[str | None] | None = None, rebase: bool = False) -> None:
        """A new pair of tables from (operations, buckets). It is written whole, also for some series only, and any commit
        that comes first is a conflict."""
        before, ops, buckets = self.state(kind)
        pair = f"{before + 1}_{uuid.uuid4().hex[:8]}"
        self._write(kind, pair, *update(merge(ops) if merge else ops, buckets))
        with self._connected() as c:
            if self._run(c, f"UPDATE TIDELINE_STATE SET VERSION = {before + 1}, CURRENT_PAIR = '{pair}' WHERE KIND = '{kind}' AND VERSION = {before}") != 1:
                raise ConflictError(f"version {before + 1} of {kind} is there already")

    def delete(self, kind: str, series: str | None) -> None:
        self.replace(kind, lambda ops, buckets: (ops.where(~named(series)), buckets.where(~named(series))))

    def vacuum(self, kind: str) -> int:
        """Drops the pairs of tables that were started before the current one, and what appends have left behind."""
        current, gone = int(self._state(kind)[1].split("_")[0]), 0
        with self._connected() as c:
            tables, names = c.getMetaData().getTables(None, None, None, None), []
            while tables.next():
                names.append(tables.getString("TABLE_NAME"))
            for name in names:
                found = re.fullmatch(rf"{kind}_(ops|buckets|staged)_(\d+)_\w+", name.lower())
                if found and int(found[2]) < (time.time() - STAGED if found[1] == "staged" else current):
                    self._run(c, f"DROP TABLE {name}")
                    gone += 1
        return gone

    def close(self) -> None:
        pass


def _database(spark: SparkSession, url: object) -> DatabaseStore:
    """sql://?at=<JDBC URL>, further parameters being connection properties."""
    query = {k: v[0] for k, v in parse_qs(url.query).items()}
    return DatabaseStore(spark, query.pop("at"), **query)


register("sql", _database)
