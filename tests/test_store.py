"""Store, engine handles and streaming ingest."""

import os
import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline.functions.series import Agg
from tideline.plans.engine import Engine
from tideline.operators import compact, resolve
from tideline.schema import COUNTER_OPS, SAMPLE_OPS
from tideline.sources import store as stores
from tideline.streaming.ingest import ingest


def got(df, column="value"):
    return {r["t"]: r[column] for r in df.collect()}


def test_buffered_writes_are_read_before_and_after_flush(spark, tmp_path):
    engine = Engine.open(spark, f"parquet://{tmp_path}/db", replica="a")
    engine.samples("x").set(1.9, 7)
    assert got(engine.samples("x").values()) == {1: 7.0}
    engine.flush()
    engine.samples("x").set(1, 8)
    assert got(engine.samples("x").values()) == {1: 8.0}
    engine.counters("x").add(4, 2)
    engine.counters("x").add(4, 3)
    assert got(engine.counters("x").range(0, 9, 10, Agg.SUM)) == {0: 5.0}
    engine.close()
    again = Engine.open(spark, f"parquet://{tmp_path}/db?cache=1")
    assert got(again.samples().values()) == {1: 8.0} and got(again.counters("x").values()) == {4: 5.0}
    with pytest.raises(ValueError, match="finite"):
        again.sketches("x").add(1, float("nan"))
    with pytest.raises(ValueError, match="grows"):
        again.counters("x").add(1, -1)


def test_compaction_of_one_series_and_deletion(spark, tmp_path):
    with Engine.open(spark, f"parquet://{tmp_path}/db") as engine:
        for name in ("x", "y"):
            for t, v in ((10, 2.0), (11, 4.0)):
                engine.samples(name).set(t, v)
                engine.sketches(name).add(t, v)
        engine.samples("x").compact(cutoff=100, span=60)
        assert got(engine.samples("x").values()) == {0: 3.0}
        assert got(engine.samples("y").values()) == {10: 2.0, 11: 4.0}
        engine.compact("sketches", cutoff=100, span=60)
        told = engine.sketches("x").range(0, 100, 60, {"p50": 0.5}).first()
        assert told["count"] == 2 and told["p50"] == pytest.approx(2.0, rel=0.01)
        engine.samples("x").delete()
        assert engine.samples("x").values().isEmpty() and not engine.samples("y").values().isEmpty()


def test_commits_are_exclusive_and_batches_applied_once(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path / "db"))
    ops = spark.createDataFrame([("s", 1, 1.0, 1, None)], SAMPLE_OPS)
    store.append("samples", ops, "w", 0)
    store.append("samples", ops, "w", 0)
    assert store.version("samples") == 1 and store.ops("samples").count() == 1
    with pytest.raises(stores.ConflictError):
        store._commit("samples", {"version": 1})


def test_two_writers_and_a_lost_one(spark, tmp_path):
    one, other = (stores.ParquetStore(spark, str(tmp_path / "db")) for _ in range(2))
    ops = spark.createDataFrame([("s", 1, 1.0, 1, None)], SAMPLE_OPS)
    one.append("samples", ops)
    with pytest.raises(stores.ConflictError):  # the other one commits in between

        def update(ops, buckets):
            other.append("samples", ops)
            return ops, buckets

        one.replace("samples", update)
    assert one.ops("samples").count() == 2 and one.version("samples") == 2
    # A writer that died while it wrote its manifest hides nothing and stops nobody.
    (tmp_path / "db/samples/manifest/3").write_text("{")
    stores.TORN, before = (1, 0.0), stores.TORN
    other.append("samples", ops)
    assert one.version("samples") == 4 and one.ops("samples").count() == 3
    stores.TORN = before


def test_lease_and_vacuum(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path / "db"))
    with store.lease("samples") as first:
        with store.lease("samples") as second:
            assert first and not second
        with store.lease("samples", ttl=-60) as third:  # what was left behind is taken
            assert third
    # A lease lasts as long as its block, and a holder that has lost it leaves the next one's alone.
    with store.lease("samples", ttl=1.8) as first:
        time.sleep(3)
        with store.lease("samples", ttl=1.8) as second:
            assert first and not second
        assert store._create(f"{tmp_path}/db/samples/lease/9", "")  # someone else has taken it
    assert (tmp_path / "db/samples/lease/9").exists()
    with store.lease("samples", ttl=-60) as third:
        assert third
    ops = spark.createDataFrame([("s", 1, 1.0, 1, None)], SAMPLE_OPS)
    for _ in range(3):
        store.append("samples", ops)
        store.replace("samples", lambda ops, buckets: (ops, buckets))
    assert store.vacuum("samples") == 0  # all are fresh
    # Three batches, two snapshots of two tables, and the manifests but for the last.
    assert store.vacuum("samples", keep=1, grace=-60) == 7 + 5 and store.ops("samples").count() == 3
    assert store.version("samples") == 6
    with pytest.raises(ValueError, match="gone"):
        store.state("samples", 3)


def test_one_of_several_takes_a_lease_that_was_left_behind(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path / "db"))
    assert store._create(f"{tmp_path}/db/samples/lease/1", "")
    os.utime(tmp_path / "db/samples/lease/1", (0, 0))
    got, together, done = [], threading.Barrier(6), threading.Barrier(6)

    def take():
        together.wait()
        with store.lease("samples") as mine:
            got.append(mine)
            done.wait()

    threads = [threading.Thread(target=take) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [False] * 5 + [True]


def test_background_compaction(spark, tmp_path):
    engine = Engine.open(spark, f"parquet://{tmp_path}/db", compact_every=0.2, jitter=0.1)
    engine.counters("x").add(10, 2)
    engine.counters("x").add(11, 3)
    engine.flush()
    for _ in range(100):
        if not engine.store.buckets("counters").isEmpty():
            break
        time.sleep(0.2)
    assert got(engine.counters("x").values()) == {0: 5.0} and not engine.store.version("samples")
    engine.close()
    with pytest.raises(ValueError, match="positive"):
        Engine.open(spark, f"parquet://{tmp_path}/db", compact_every=0)


def test_no_compaction_without_the_lease(spark, tmp_path):
    with Engine.open(spark, f"parquet://{tmp_path}/db") as engine:
        engine.samples("x").set(1, 1.0)
        with engine.store.lease("samples"):
            assert not engine.compact("samples", cutoff=100, span=60)
        assert got(engine.samples("x").values()) == {1: 1.0}
        assert engine.compact("samples", cutoff=100, span=60) and got(engine.samples("x").values()) == {0: 1.0}


def test_database_store(spark, tmp_path):
    with Engine.open(spark, "sql://?at=jdbc:derby:memory:series%3Bcreate=true") as engine:
        engine.samples("x").set(1, 7.0)
        engine.counters("x").add(4, 2)
        for v in (-100.0, -1.0, 0.0, 1.0, 100.0):
            engine.sketches("y").add(5, v)
        engine.flush()
        assert got(engine.samples("x").values()) == {1: 7.0} and got(engine.counters("x").values()) == {4: 2.0}
        assert engine.compact(cutoff=100, span=60)
        assert got(engine.samples("x").values()) == {0: 7.0} and got(engine.counters("x").values()) == {0: 2.0}
        told = engine.sketches("y").range(0, 100, 60, {"p25": 0.25, "p50": 0.5}).first()
        assert told["count"] == 5 and told["p50"] == 0 and told["p25"] == pytest.approx(-1, rel=0.01)
        assert engine.store.vacuum("samples") == 2
        engine.samples("x").delete()
        assert engine.samples("x").values().isEmpty()


def test_database_writers(spark):
    with Engine.open(spark, "sql://?at=jdbc:derby:memory:writers%3Bcreate=true") as engine:
        for k in (5, 3, 4):  # each flush is later than the one before it
            engine.samples("x").set(1, float(k))
            engine.counters("x").add(1, k)
            engine.flush()
        assert got(engine.samples("x").values()) == {1: 4.0} and got(engine.counters("x").values()) == {1: 12.0}
        store, ops = engine.store, spark.createDataFrame([("s", 1, 1.0, 1, None)], SAMPLE_OPS)

        def meanwhile(act):
            def update(old, buckets):
                act()
                return old, buckets

            return update

        with pytest.raises(stores.ConflictError):  # operations that the snapshot lacks
            store.replace("samples", meanwhile(lambda: store.append("samples", ops)))
        with pytest.raises(stores.ConflictError):  # the other snapshot stays whole
            store.replace("samples", meanwhile(lambda: store.replace("samples", lambda old, buckets: (old.where("series = 's'"), buckets))))
        assert got(engine.samples().values()) == {1: 1.0}
        with store.lease("samples", ttl=1.8) as first:
            time.sleep(3)
            with store.lease("samples", ttl=1.8) as second:
                assert first and not second
            with store.lease("samples", ttl=1.8) as other, store.lease("counters") as free:
                assert free and not other
        with store.lease("samples", ttl=-60) as left_behind, store.lease("samples") as third:
            assert left_behind and third


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="share"):
        stores.shared_folder(Session)


def test_streams_of_files_and_folders(spark, tmp_path):
    from tideline.plans import queries

    one = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    one.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for query in (queries.stream_log_range, queries.stream_lww):
        rows = [sorted(map(tuple, query(spark, sf).collect())) for sf in ("/root/testdata/sf0.001", str(tmp_path))]
        assert rows[0] == rows[1] and rows[0]


def test_full_buffers_and_schemas(spark, tmp_path):
    with Engine.open(spark, f"parquet://{tmp_path}/db", most_buffered=2) as engine:
        for v in (1, 2, 3):
            engine.samples("x").set(v, v)
        assert engine.store.version("samples") == 1 and engine.store.ops("samples").count() == 2
        assert got(engine.samples("x").values()) == {1: 1.0, 2: 2.0, 3: 3.0}
        with pytest.raises(ValueError, match="do not fit"):
            engine.store.append("samples", spark.createDataFrame([("x", 1)], "series string, t int"))


def test_registry(spark):
    with pytest.raises(ValueError, match="registered"):
        stores.open_store(spark, "nowhere://x")
    with pytest.raises(ValueError, match="scheme"):
        stores.open_store(spark, "plain")
    stores.register("mine", lambda spark, url: url.netloc)
    assert stores.open_store(spark, "mine://here") == "here"


def test_memory_store_forgets_series_by_their_last_write(spark, monkeypatch):
    ago, now = [0], time.time
    monkeypatch.setattr(stores.time, "time", lambda: now() - ago[0])
    with Engine.open(spark, "memory://?ttl=3600") as engine:
        for name, written in (("old", 4000), ("new", 4000), ("new", 0)):
            ago[0] = written
            engine.samples(name).set(5 + (written == 0), 1.0 + (written == 0))  # a time long ago is no reason to forget it
            engine.flush()
        assert engine.samples("old").values().isEmpty() and got(engine.samples("new").values()) == {5: 1.0, 6: 2.0}
        engine.samples("new").compact(cutoff=100, span=60)
        assert got(engine.samples().values()) == {0: 1.5}


def _counter(spark, *points):
    return spark.createDataFrame([("s", t, Decimal(1), k, v) for k, (t, v) in enumerate(points)], COUNTER_OPS)


@pytest.mark.parametrize("uri", ["parquet://{}/db", "parquet://{}/db?cache=1", "sql://?at=jdbc:derby:memory:torn%3Bcreate=true"])
def test_reads_are_of_one_state(spark, tmp_path, monkeypatch, uri):
    """A compaction that comes while a reader has half of what it reads changes nothing."""
    with Engine.open(spark, uri.format(tmp_path)) as engine:
        store = getattr(engine.store, "inner", engine.store)
        store.append("counters", _counter(spark, (0, 10), (5, 10)))
        before, once = type(store)._read, []

        def read(self, *args):
            found = before(self, *args)
            if not once:
                once.append(1)
                engine.compact("counters", cutoff=100, span=60)
            return found

        monkeypatch.setattr(type(store), "_read", read)
        assert got(engine.counters("s").values()) == {0: 10.0, 5: 10.0}
        assert once and got(engine.counters("s").values()) == {0: 20.0}


def test_older_versions(spark, tmp_path):
    with Engine.open(spark, f"parquet://{tmp_path}/db") as engine:
        engine.store.append("counters", _counter(spark, (0, 1), (5, 2)))
        engine.compact("counters", cutoff=100, span=60)
        engine.store.append("counters", _counter(spark, (70, 4)))
        handle = engine.counters("s")
        assert [got(handle.at(v).values()) for v in range(4)] == [{}, {0: 1.0, 5: 2.0}, {0: 3.0}, {0: 3.0, 70: 4.0}]
        handle.add(80, 1)
        assert got(handle.at(3).values()) == {0: 3.0, 70: 4.0} and 80 in got(handle.values())
        with pytest.raises(ValueError, match="no version 4"):
            handle.at(4).values()


@pytest.mark.parametrize("uri", ["parquet://{}/db", "sql://?at=jdbc:derby:memory:many%3Bcreate=true"])
def test_eight_writers_at_once_lose_nothing(spark, tmp_path, uri):
    with Engine.open(spark, uri.format(tmp_path)) as engine:
        failed = []

        def write(k):
            try:
                for batch in range(2):
                    engine.store.append("counters", spark.createDataFrame([(f"w{k}", batch, Decimal(k), 1, 1)], COUNTER_OPS), f"w{k}", batch)
            except Exception as e:  # noqa: BLE001
                failed.append(e)

        threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert not failed and engine.store.version("counters") == 16
        assert sorted((r["series"], r["t"]) for r in engine.store.ops("counters").collect()) == sorted((f"w{k}", b) for k in range(8) for b in range(2))


def _in_parts(spark, tmp_path, parts=8):
    """A store of 40 series and one without a name, compacted as a whole, with one more batch."""
    store = stores.ParquetStore(spark, str(tmp_path / "db"), parts=parts)
    rows = lambda t: spark.createDataFrame([(name, t, float(k), 1, Decimal(0)) for k, name in enumerate([*(f"s{k}" for k in range(40)), None])], SAMPLE_OPS)
    store.append("samples", rows(10))
    store.replace("samples", lambda ops, buckets: compact.compact_samples(ops, buckets, 60, 60, merged=True), resolve.samples)
    store.append("samples", rows(20))
    store.append("samples", rows(90))
    return store


def _files(tmp_path, name):
    return {p for p in (tmp_path / "db/samples" / name).rglob("*.parquet")}


def test_hashes_of_driver_and_tasks_agree(spark):
    names = [None, "", "a", "größe", "名前", "x" * 1000, *(f"s{k}" for k in range(100))]
    df = spark.createDataFrame([(n,) for n in names], "series string")
    for parts in (1, 7, 4096):
        assert {r[0]: r[1] for r in df.select("series", stores.part(F.col("series"), parts)).collect()} == {n: stores.part_of(n, parts) for n in names}


def test_compaction_of_one_series_rewrites_its_part_alone(spark, tmp_path):
    store, name = _in_parts(spark, tmp_path), "s7"
    own = f"part={stores.part_of(name, 8)}"
    assert {p.parent.name for p in _files(tmp_path, "buckets")} == {f"part={stores.part_of(f's{k}', 8)}" for k in range(40)} | {f"part={stores.part_of(None, 8)}"}
    before, values = {k: _files(tmp_path, k) for k in ("ops", "buckets", "log")}, lambda e: {(r["series"], r["t"]): r["value"] for r in e.samples().values().collect()}
    with Engine(spark, store) as engine:
        want = values(engine)
        engine.compact("samples", cutoff=60, span=60, series=name)
        new = {k: _files(tmp_path, k) - before[k] for k in before}
        assert {p.parent.name for k in ("ops", "buckets") for p in new[k]} == {own} and not new["log"]
        assert all(not before[k] - _files(tmp_path, k) for k in before)
        got_now = values(engine)
        assert got_now == {k: v for k, v in want.items() if k != (name, 20)}
        assert got(engine.samples(name).values()) == {0: 7.0, 90: 7.0}
        # A read of one series opens its part's files and the log.
        paths = [p.split("/samples/")[1] for df in store.state("samples", only=[name])[1:] for p in df.inputFiles()]
        assert paths and {p.split("/")[2] for p in paths if not p.startswith("log")} == {own}
        # The rest follows part by part, until nothing is left in the log.
        engine.compact("samples", cutoff=60, span=60, series=[f"s{k}" for k in range(40)])
        assert not store.manifest("samples")["log"] or stores.part_of(None, 8) not in {stores.part_of(f"s{k}", 8) for k in range(40)}
        store.delete("samples", None)
        assert not store.manifest("samples")["log"]
        assert values(engine) == {(f"s{k}", t): float(k) for k in range(40) for t in (0, 90)}


def test_vacuum_takes_replaced_parts(spark, tmp_path):
    store = _in_parts(spark, tmp_path)
    store.delete("samples", "s7")
    store.delete("samples", "s8")
    rows = store.ops("samples").count(), store.buckets("samples").count()
    parts = {stores.part_of(n, 8) for n in ("s7", "s8")}
    store.vacuum("samples", keep=1, grace=-60)
    for name in ("ops", "buckets"):
        left = [p.parent.name for p in _files(tmp_path, name)]
        assert len(left) == len(set(left)) and {f"part={p}" for p in parts} <= set(left)
    assert (store.ops("samples").count(), store.buckets("samples").count()) == rows == (78, 39)


def test_compaction_commits_on_top_of_appends(spark, tmp_path):
    """What is appended while a compaction runs stays in the log; of two compactions the second one fails."""
    store = _in_parts(spark, tmp_path)
    late = spark.createDataFrame([("s7", 30, 5.0, 9, Decimal(0))], SAMPLE_OPS)

    def update(ops, buckets, between=lambda: store.append("samples", late)):
        between()
        return compact.compact_samples(ops, buckets, 60, 60)

    store.replace("samples", update, only=["s7"], rebase=True)
    with Engine(spark, store) as engine:
        assert got(engine.samples("s7").values()) == {0: 7.0, 30: 5.0, 90: 7.0}
        with pytest.raises(stores.ConflictError):
            store.replace("samples", lambda ops, buckets: update(ops, buckets, lambda: engine.compact("samples", cutoff=60, span=60, series="s8")), rebase=True)
        with pytest.raises(stores.ConflictError):
            store.replace("samples", update)
        assert got(engine.samples("s7").values()) == {0: 7.0, 30: 5.0, 90: 7.0}
        engine.compact("samples", cutoff=60, span=60)
        assert got(engine.samples("s7").values()) == {0: pytest.approx(19 / 3), 90: 7.0}
        other = next(f"s{k}" for k in range(40) if stores.part_of(f"s{k}", 8) != stores.part_of("s7", 8))
        with pytest.raises(ValueError, match="others"):
            store.replace("samples", lambda ops, buckets: (ops.withColumn("series", F.lit(other)), buckets), only=["s7"])


@pytest.mark.parametrize("uri", ["parquet://{}/db", "sql://?at=jdbc:derby:memory:nulls%3Bcreate=true"])
def test_the_series_without_a_name_stays(spark, tmp_path, uri):
    with Engine.open(spark, uri.format(tmp_path)) as engine:
        ops = [(None, 1, 7.0, 1, Decimal(0)), ("a", 1, 1.0, 1, Decimal(0)), ("b", 1, 2.0, 1, Decimal(0)), (None, 90, 3.0, 1, Decimal(0))]
        engine.store.append("samples", spark.createDataFrame(ops, SAMPLE_OPS))
        engine.compact("samples", cutoff=60, span=60, series="a")
        engine.store.delete("samples", "b")
        values = lambda: sorted(((r["series"], r["t"], r["value"]) for r in engine.samples().values().collect()), key=repr)
        assert values() == [("a", 0, 1.0), (None, 1, 7.0), (None, 90, 3.0)]
        engine.compact("samples", cutoff=60, span=60)
        assert values() == [("a", 0, 1.0), (None, 0, 7.0), (None, 90, 3.0)]
        engine.store.delete("samples", None)
        assert values() == [("a", 0, 1.0)]


class Failing:
    """A store whose appends fail, before or after they have been committed."""

    def __init__(self, inner, *ways):
        self.inner, self.ways = inner, list(ways)

    def append(self, *args):
        way = self.ways.pop(0) if self.ways else None
        if way == "before":
            raise stores.ConflictError("lost")
        self.inner.append(*args)
        if way == "after":
            raise OSError("no answer")

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_flushing_goes_on_after_errors(spark, tmp_path):
    store = Failing(stores.ParquetStore(spark, str(tmp_path / "db")), "before", "after", "before")
    engine = Engine(spark, store, flush_every=0.2)
    engine.counters("x").add(1, 10)
    for _ in range(200):
        if not store.ways and not engine._buffer["counters"]:
            break
        time.sleep(0.1)
    # The second try was committed; the third, under the same number, adds nothing.
    assert got(engine.counters("x").values()) == {1: 10.0} and store.inner.ops("counters").count() == 1
    engine.close()


def test_what_a_lost_flush_sent_is_not_sent_twice(spark, tmp_path):
    store = Failing(stores.ParquetStore(spark, str(tmp_path / "db")), "after")
    engine = Engine(spark, store)
    engine.counters("x").add(1, 10)
    with pytest.raises(OSError, match="no answer"):
        engine.flush()
    engine.compact_after = 1
    store.replace("counters", lambda ops, buckets: compact.compact_counters(ops, buckets, 100, 3, merged=True), resolve.counters)
    engine.counters("x").add(1, 5)  # later, and still behind the rows of unknown fate
    engine.flush()
    assert got(engine.counters("x").values()) == {0: 10.0, 1: 5.0}
    engine.close()


def test_background_compaction_leaves_other_series_alone(spark, tmp_path):
    with Engine.open(spark, f"parquet://{tmp_path}/db") as writer:
        for name in ("x", "y"):
            writer.counters(name).add(10, 2)
    engine = Engine.open(spark, f"parquet://{tmp_path}/db", compact_every=0.2)
    engine.counters("x")
    for _ in range(100):
        if not engine.store.buckets("counters").isEmpty():
            break
        time.sleep(0.2)
    engine.close()
    assert got(engine.counters("x").values()) == {0: 2.0} and got(engine.counters("y").values()) == {10: 2.0}


def test_a_stream_into_a_database_is_applied_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"s{j % 5}", k, float(j), j, Decimal(0)) for j in range(40)], SAMPLE_OPS).write.mode("append").parquet(str(tmp_path / "in"))
    with Engine.open(spark, "sql://?at=jdbc:derby:memory:ingest%3Bcreate=true") as engine:
        for _ in range(2):
            stream = spark.readStream.schema(SAMPLE_OPS).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
            ingest(stream, engine.store, "samples", str(tmp_path / "checkpoint")).awaitTermination()
        assert engine.store.ops("samples").count() == 120
        batch = spark.createDataFrame([("twice", 1, 1.0, 1, Decimal(0))], SAMPLE_OPS)
        for number in (7, 7, 6):
            engine.store.append("samples", batch, "it's a writer", number)
        assert engine.store.ops("samples").where("series = 'twice'").count() == 1
        # Nothing of an append that fails halfway is there, nor its number.
        with pytest.raises(Exception, match="TIDELINE|Table|column|does not exist|failed"):
            engine.store._run = lambda c, sql, run=engine.store._run: run(c, sql.replace("UPDATE TIDELINE_APPLIED", "UPDATE NOWHERE"))
            engine.store.append("samples", batch, "it's a writer", 8)
        del engine.store._run
        assert engine.store.ops("samples").where("series = 'twice'").count() == 1
        engine.store.append("samples", batch, "it's a writer", 8)
        assert engine.store.ops("samples").where("series = 'twice'").count() == 2


def test_databases_are_read_by_many_tasks(spark, monkeypatch):
    from tideline.sources import database

    monkeypatch.setattr(database, "TASK_ROWS", 100)
    with Engine.open(spark, "sql://?at=jdbc:derby:memory:parts%3Bcreate=true") as engine:
        ops = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("series"), (F.col("id") * 7 - 5000).alias("t"), F.col("id").cast("double").alias("value"), F.col("id").alias("clock"), F.lit(0).cast("decimal(20,0)").alias("replica"))
        engine.store.append("samples", ops)
        read = engine.store.ops("samples")
        sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and len(sizes) >= 30 and max(sizes) <= 300
        assert read.orderBy("clock").collect() == ops.orderBy("clock").collect()


def test_stream_into_the_log(spark, tmp_path):
    ops = spark.createDataFrame([("s", 1, 1.0, 1, None), ("s", 1, 2.0, 2, None)], SAMPLE_OPS)
    ops.write.parquet(str(tmp_path / "in"))
    store = stores.ParquetStore(spark, str(tmp_path / "db"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(SAMPLE_OPS).parquet(str(tmp_path / "in"))
        ingest(stream, store, "samples", str(tmp_path / "checkpoint")).awaitTermination()
    assert store.ops("samples").count() == 2
