"""The store as a Spark data source."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import compact, read
from tideline.sources import source
from tideline.sources.source import register_source
from tideline.sources.store import ParquetStore
from tideline.streaming.ingest import ingest


@pytest.fixture
def store(spark, tmp_path):
    register_source(spark)
    return ParquetStore(spark, str(tmp_path / "db"))


def _ops(spark, low, high, series=("a", "b", None)):
    names = F.array(*map(F.lit, series))
    return spark.range(low, high).select(F.get(names, (F.col("id") % len(series)).cast("int")).alias("series"), F.col("id").alias("t"), F.col("id").cast("double").alias("value"), F.col("id").alias("clock"), F.lit(str(2**64 - 1)).cast("decimal(20,0)").alias("replica"))


def _load(spark, store, **options):
    return spark.read.format("tideline").options(path=store.root, **options).load()


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_batches_equal_the_store(spark, store):
    assert _load(spark, store, kind="samples").isEmpty()
    for k in range(3):
        store.append("samples", _ops(spark, 100 * k, 100 * k + 100))
    store.replace("samples", lambda ops, buckets: compact.compact_samples(ops, buckets, 120, 50))
    store.append("samples", _ops(spark, 300, 350))
    assert _rows(_load(spark, store, kind="samples")) == _rows(store.ops("samples"))
    assert _rows(_load(spark, store, kind="samples", part="buckets")) == _rows(store.buckets("samples"))
    assert _rows(_load(spark, store, kind="samples", version=2)) == _rows(store.state("samples", 2).ops)
    assert _rows(read.sample_values(_load(spark, store, kind="samples"), _load(spark, store, kind="samples", part="buckets"))) == _rows(read.sample_values(*store.state("samples")[1:]))
    with pytest.raises(Exception, match="no version 9"):
        _load(spark, store, kind="samples", version=9).collect()
    with pytest.raises(Exception, match="a kind"):
        _load(spark, store, kind="other").collect()


def test_sketch_buckets_keep_their_maps(spark, store):
    store.append("sketches", _ops(spark, 0, 200))
    store.replace("sketches", lambda ops, buckets: compact.compact_sketches(ops, buckets, 150, 50))
    held = lambda df: {(r["series"], r["t"]): (r["count"], r["zero"], r["neg"], r["pos"]) for r in df.collect()}
    assert held(_load(spark, store, kind="sketches", part="buckets")) == held(store.buckets("sketches"))


def test_sql_with_conditions_pushed_down(spark, store):
    for k in range(4):
        store.append("samples", _ops(spark, 100 * k, 100 * k + 100).coalesce(1))
    _load(spark, store, kind="samples").createOrReplaceTempView("ops_of_store")
    query = spark.sql("SELECT series, count(*) AS n, max(value) AS top FROM ops_of_store WHERE series = 'a' AND t BETWEEN 150 AND 249 AND value > 200 GROUP BY series")
    assert [tuple(r) for r in query.collect()] == [("a", 17, 249.0)]
    # What the reader is given, and what it makes of it.
    reader = source._Reader({"path": store.root, "kind": "samples"}, _load(spark, store, kind="samples").schema)
    left = list(reader.pushFilters([source.EqualTo(("series",), "a"), source.GreaterThanOrEqual(("t",), 150), source.LessThanOrEqual(("t",), 249), source.GreaterThan(("value",), 200.0)]))
    assert [f.attribute for f in left] == [("value",)] and len(reader.wanted) == 3
    assert len(reader.partitions()) == 2  # of four files
    plan = spark.sql("SELECT * FROM ops_of_store WHERE t = 7 AND series IS NULL")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "PushedFilters: []" not in plan
    named = lambda where: sorted(r["t"] for r in spark.sql(f"SELECT t FROM ops_of_store WHERE {where}").collect())
    assert named("t < 6 AND series IS NULL") == [2, 5] and named("t IN (3, 5, 399)") == [3, 5, 399] and named("series <=> 'b' AND t > 395") == [397]
    assert named("t < 4 AND NOT series = 'a'") == [1]


def test_parts_of_the_snapshot_are_read_once_and_pruned(spark, store):
    names = [*(f"s{k}" for k in range(12)), None]
    store.append("samples", _ops(spark, 0, 300, names))
    store.replace("samples", lambda ops, buckets: compact.compact_samples(ops, buckets, 100, 50))
    store.append("samples", _ops(spark, 300, 400, names))
    store.replace("samples", lambda ops, buckets: compact.compact_samples(ops, buckets, 200, 50), only=["s3"])
    store.delete("samples", None)
    for part in ("ops", "buckets"):
        assert _rows(_load(spark, store, kind="samples", part=part)) == _rows(getattr(store, part)("samples"))
    reader = source._Reader({"path": store.root, "kind": "samples", "part": "buckets"}, store.buckets("samples").schema)
    every = len(reader.partitions())
    assert not list(reader.pushFilters([source.EqualTo(("series",), "s3")])) and 0 < len(reader.partitions()) < every
    one = _load(spark, store, kind="samples").where("series = 's3'")
    assert _rows(one) == _rows(store.ops("samples").where("series = 's3'")) and one.count() > 0


def test_streams_give_each_append_once(spark, store, tmp_path):
    for k in range(2):
        store.append("samples", _ops(spark, 10 * k, 10 * k + 10))
    other = ParquetStore(spark, str(tmp_path / "copy"))

    def follow():
        stream = spark.readStream.format("tideline").options(path=store.root, kind="samples").load()
        ingest(stream, other, "samples", str(tmp_path / "checkpoint")).awaitTermination()

    follow()
    assert _rows(other.ops("samples")) == _rows(_ops(spark, 0, 20))
    store.append("samples", _ops(spark, 20, 30))
    store.replace("samples", lambda ops, buckets: compact.compact_samples(ops, buckets, 25, 10))
    store.append("samples", _ops(spark, 30, 40))
    follow()
    follow()
    assert _rows(other.ops("samples")) == _rows(_ops(spark, 0, 40))
