"""Live ranges and rollups against batch reads of all operations."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline import schema
from tideline.functions import sketches
from tideline.functions.series import Agg
from tideline.operators import read
from tideline.operators.sketches import sketch_range
from tideline.plans import queries
from tideline.streaming.ingest import keep_latest, rolled, rollup
from tideline.streaming.live import keep_range, newest

SPAN = 60


def _batches(kind, n=3, size=150):
    """Operations in any order of time, some twice and some that win over earlier ones."""
    rng, out, seen = random.Random(kind), [], []
    for b in range(n):
        rows = []
        for k in range(size):
            if seen and rng.random() < 0.2:
                row = rng.choice(seen)
                if kind != "counters" and rng.random() < 0.5:  # the same identity, another value
                    row = (*row[:2], row[2] + rng.choice((-40.0, 0.5, 40.0)), *row[3:])
            else:
                series, t, clock, replica = rng.choice(["a", "b", None]), rng.randint(-130, 400), rng.randint(0, 5) if kind == "samples" else b * size + k, Decimal(rng.choice((1, 2, 2**64 - 1)))
                value = rng.randint(0, 9) if kind == "counters" else rng.choice((0.0, rng.gauss(0, 30)))
                row = (series, t, replica, clock, value) if kind == "counters" else (series, t, value, clock, replica)
            rows.append(row)
        seen += rows
        out.append(rows)
    return out


def _stream(spark, kind, batches, at):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.KINDS[kind][0]).coalesce(1).write.parquet(f"{at}/in/{k}")
    stream = spark.readStream.schema(schema.KINDS[kind][0]).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    return stream, spark.createDataFrame([r for rows in batches for r in rows], schema.KINDS[kind][0])


def _rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def _held(df):
    return sorted(((r["series"], r["t"], r["sketch"]["count"], round(r["sketch"]["sum"], 6), r["sketch"]["min"], r["sketch"]["max"], [tuple(b) for b in r["sketch"]["bins"]]) for r in df.collect()), key=repr)


def _range(ops, kind):
    """All aggregates of a batch read."""
    f = read.sample_range if kind == "samples" else read.counter_range
    out = None
    for agg in (Agg.COUNT, Agg.SUM, Agg.MIN, Agg.MAX, Agg.FIRST, Agg.LAST):
        one = f(ops, SPAN, agg).select(F.coalesce("series", F.lit("none")).alias("series"), "t", F.col("value").alias(agg.value))
        out = one if out is None else out.join(one, ["series", "t"])
    return out.withColumn("count", F.col("count").cast("long"))


@pytest.mark.parametrize("kind", ["samples", "counters"])
def test_live_ranges_equal_batch_reads(spark, tmp_path, kind):
    stream, ops = _stream(spark, kind, _batches(kind), str(tmp_path))
    query = keep_range(stream, kind, SPAN, f"{tmp_path}/live", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [150] * 3
    live = newest(spark.read.parquet(f"{tmp_path}/live")).withColumn("series", F.coalesce("series", F.lit("none")))
    assert _rows(live) == _rows(_range(ops, kind)) and live.count() > 15


def test_live_sketches_equal_batch_reads(spark, tmp_path):
    stream, ops = _stream(spark, "sketches", _batches("sketches"), str(tmp_path))
    keep_range(stream, "sketches", SPAN, f"{tmp_path}/live", f"{tmp_path}/checkpoint").awaitTermination()
    assert _held(newest(spark.read.parquet(f"{tmp_path}/live"))) == _held(sketch_range(ops, SPAN))


def test_a_late_operation_touches_its_bucket_only(spark, tmp_path):
    op = lambda t, k: ("a", t, Decimal(1), k, 5)
    stream, _ = _stream(spark, "counters", [[op(10, 0), op(70, 1), op(130, 2)], [op(75, 3)], [op(10, 0)]], str(tmp_path))
    keep_range(stream, "counters", SPAN, f"{tmp_path}/live", f"{tmp_path}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/live")
    assert sorted((r["batch"], r["t"], r["sum"]) for r in kept.where("batch < 2").collect()) == [(0, 0, 5.0), (0, 60, 5.0), (0, 120, 5.0), (1, 60, 10.0)]
    assert sorted((r["t"], r["sum"]) for r in newest(kept).collect()) == [(0, 5.0), (60, 10.0), (120, 5.0)]


@pytest.mark.parametrize("kind", ["counters", "sketches"])
def test_rollups_add_up_and_read_no_old_batch(spark, tmp_path, kind):
    batches = _batches("counters")
    if kind == "sketches":
        batches = [[(s, t, float(v), c, r) for s, t, r, c, v in rows] for rows in batches]
    for k in range(3):  # each batch arrives, and the stream starts again where it ended
        spark.createDataFrame(batches[k], schema.KINDS[kind][0]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema.KINDS[kind][0]).parquet(f"{tmp_path}/in/*")
        query = rollup(stream, kind, SPAN, f"{tmp_path}/rolled", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        assert sum(p.numInputRows for p in query.recentProgress) == 150
    ops = spark.createDataFrame([r for rows in batches for r in rows], schema.KINDS[kind][0])
    got = rolled(spark.read.parquet(f"{tmp_path}/rolled"), kind)
    if kind == "sketches":
        assert _held(got) == _held(sketch_range(ops, SPAN))
    else:
        want = _range(ops, kind).select("series", "t", "count", *(F.col(c).cast("long") for c in ("sum", "min", "max")))
        assert _rows(got.withColumn("series", F.coalesce("series", F.lit("none")))) == _rows(want)


def test_sketches_of_a_stream_can_be_asked(spark, tmp_path):
    rows = [("a", k % 50, float(k), k, Decimal(0)) for k in range(200)]
    stream, _ = _stream(spark, "sketches", [rows[::2], rows[1::2]], str(tmp_path))
    keep_range(stream, "sketches", SPAN, f"{tmp_path}/live", f"{tmp_path}/checkpoint").awaitTermination()
    r = newest(spark.read.parquet(f"{tmp_path}/live")).select(sketches.quantile(F.col("sketch"), 0.5).alias("p50"), sketches.count(F.col("sketch")).alias("n")).first()
    assert r["n"] == 200 and r["p50"] == pytest.approx(99, rel=0.01)


def _many(kind, batches=(700, 700, 3000), seed=7):
    """Operations of which many have the identity of another, spread over seconds (samples) or most in one (sketches)."""
    rng = random.Random(seed)
    at = lambda: rng.randint(-4000, 4000) if kind == "samples" or rng.random() < 0.3 else 5
    op = lambda: ("a", at(), rng.choice((0.0, round(rng.gauss(0, 30), 2))), rng.randint(0, 900), rng.choice((None, Decimal(0), Decimal(2**32), Decimal(2**64 - 1))))
    return [[op() for _ in range(n)] for n in batches]


@pytest.mark.parametrize("kind", ["samples", "sketches"])
def test_state_has_few_rows_for_many_operations(spark, tmp_path, kind):
    # Each row of the state is a call for each batch that needs it.
    rows = [("a", k if kind == "samples" else 5, float(k % 97), k, Decimal(1)) for k in range(3000)]
    stream, _ = _stream(spark, kind, [rows[:1500], rows[1500:]], str(tmp_path))
    query = keep_range(stream, kind, 86_400, f"{tmp_path}/live", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal < 30


def test_samples_of_several_slices_equal_batch_reads(spark, tmp_path):
    stream, ops = _stream(spark, "samples", _many("samples"), str(tmp_path))
    keep_range(stream, "samples", 7200, f"{tmp_path}/live", f"{tmp_path}/checkpoint").awaitTermination()
    live = newest(spark.read.parquet(f"{tmp_path}/live"))
    for agg in (Agg.COUNT, Agg.SUM, Agg.MIN, Agg.MAX, Agg.FIRST, Agg.LAST):
        assert _rows(live.select("series", "t", F.col(agg.value).cast("double"))) == _rows(read.sample_range(ops, 7200, agg))


def test_events_arrive_in_files_of_several_tasks(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = []
    queries._arriving(spark, str(tmp_path), "samples", f"{tmp_path}/at", lambda ops: got.append(keep_latest(ops, f"{tmp_path}/latest", f"{tmp_path}/checkpoint")) or got[-1])
    assert len(list(tmp_path.glob("at/in/0/*.parquet"))) == 3
    assert sorted(int(p.name.split("=")[1]) for p in tmp_path.glob("latest/batch=*")) == [0, 1, 2]
    assert [sum(p.numInputRows for p in q.recentProgress) > 0 for q in got] == [True] * 3


def test_sketch_slices_that_are_split_equal_batch_reads(spark, tmp_path):
    stream, ops = _stream(spark, "sketches", _many("sketches"), str(tmp_path))
    keep_range(stream, "sketches", 7200, f"{tmp_path}/live", f"{tmp_path}/checkpoint").awaitTermination()
    assert _held(newest(spark.read.parquet(f"{tmp_path}/live"))) == _held(sketch_range(ops, 7200))


def test_live_counters_are_kept_by_built_in_operators(spark, tmp_path):
    # The operations of one bucket are dealt by their identity; one without a replica is not that of replica 0.
    rows = [("a", k % 50, None if k % 3 == 0 else Decimal(k % 3 - 1), k // 3, 5) for k in range(300)]
    stream, ops = _stream(spark, "counters", [rows[:200], rows[100:]], str(tmp_path))
    query = keep_range(stream, "counters", SPAN, f"{tmp_path}/live", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert {o.operatorName for o in query.lastProgress.stateOperators} == {"dedupe", "stateStoreSave"}
    assert _rows(newest(spark.read.parquet(f"{tmp_path}/live"))) == _rows(_range(ops, "counters").select("series", "t", "count", "sum", "min", "max", "first", "last"))
