"""Golden vectors and properties of the series operators."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline import schema
from tideline.functions import bins
from tideline.functions.identity import default_replica, fnv1a_64
from tideline.functions.series import Agg
from tideline.operators import compact, distributions, read, resolve


def samples(spark, *points, clock=0):
    return spark.createDataFrame([("s", t, float(v), clock + i, Decimal(1)) for i, (t, v) in enumerate(points)], schema.SAMPLE_OPS)


def counters(spark, *points, clock=0):
    return spark.createDataFrame([("s", t, Decimal(1), clock + i, v) for i, (t, v) in enumerate(points)], schema.COUNTER_OPS)


def sample_buckets(spark, *rows):
    return spark.createDataFrame([("s", t, n, float(s), float(mn), float(mx), float(f), float(l)) for t, n, s, mn, mx, f, l in rows], schema.SAMPLE_BUCKETS)


def counter_buckets(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], schema.COUNTER_BUCKETS)


def got(df, column="value"):
    return {r["t"]: r[column] for r in df.collect()}


def test_values_and_mean(spark):
    ops = samples(spark, (10, 1.5), (11, 2.5))
    assert got(read.sample_values(ops, None, 10, 11)) == {10: 1.5, 11: 2.5}
    assert got(read.sample_range(ops, 10, Agg.MEAN, None, 10, 11)) == {10: 2.0}


def test_all_aggregates(spark):
    ops = samples(spark, (0, 3), (1, 1), (2, 5))
    want = {"sum": 9, "count": 3, "min": 1, "max": 5, "mean": 3, "first": 3, "last": 5}
    assert {a.value: got(read.sample_range(ops, 10, a))[0] for a in Agg} == want


def test_last_write_wins_by_clock_then_unsigned_replica(spark):
    big = Decimal(2**64 - 1)
    rows = [("s", 1, 1.0, 1, big), ("s", 1, 2.0, 2, Decimal(1)), ("s", 2, 1.0, 5, big), ("s", 2, 2.0, 5, Decimal(7)), ("s", 3, 1.0, 1, Decimal(0)), ("s", 3, 4.0, 1, Decimal(0))]
    ops = spark.createDataFrame(rows, schema.SAMPLE_OPS)
    assert got(read.sample_values(ops)) == {1: 2.0, 2: 1.0, 3: 4.0}


def test_bounds_are_inclusive_and_cut_buckets(spark):
    ops = samples(spark, (1, 1), (61, 2))
    assert got(read.sample_range(ops, 60, Agg.SUM, None, 2, 120)) == {60: 2.0}
    assert got(read.sample_range(ops, 60, Agg.SUM, None, 200, 300)) == {}
    assert got(read.sample_range(ops, 60, Agg.SUM, None, 1, 120)) == {0: 1.0, 60: 2.0}


def test_negative_times_round_down(spark):
    assert got(read.sample_range(samples(spark, (-1, 4)), 60, Agg.SUM)) == {-60: 4.0}


def test_samples_with_buckets(spark):
    ops, buckets = samples(spark, (1, 1), (2, 3)), sample_buckets(spark, (10, 1, 4, 4, 4, 4, 4))
    assert len(read.sample_range(ops, 0, Agg.MAX, buckets, 1, 10).collect()) == 3
    assert got(read.sample_range(ops, 10, Agg.MAX, buckets, 1, 10)) == {0: 3.0, 10: 4.0}
    both = sample_buckets(spark, (1, 1, 1, 1, 1, 1, 1), (2, 1, 4, 4, 4, 4, 4))
    assert got(read.sample_range(samples(spark, (1, 1), (2, 2)), 60, Agg.SUM, both, 2, 2)) == {0: 6.0}
    edges = sample_buckets(spark, *((t, 1, v, v, v, v, v) for t, v in ((10, 1), (25, 2), (40, 3))))
    assert got(read.sample_range(samples(spark), 10, Agg.SUM, edges, 20, 30)) == {20: 2.0}


def test_bucket_merge(spark):
    merged = resolve.sample_buckets(sample_buckets(spark, (10, 1, 4, 4, 4, 4, 4)), sample_buckets(spark, (10, 1, 2, 2, 2, 2, 2))).first()
    assert tuple(merged)[1:] == (10, 2, 6.0, 2.0, 4.0, 4.0, 2.0)


def test_compact_samples(spark):
    ops, buckets = samples(spark, (1, 5), (2, 1), (3, 7), (20, 9)), sample_buckets(spark, (0, 1, 2, 2, 2, 2, 2))
    left, made = compact.compact_samples(ops, buckets, 10, 10)
    assert got(left) == {20: 9.0}
    assert tuple(made.first())[1:] == (0, 4, 15.0, 1.0, 7.0, 2.0, 7.0)
    assert compact.compact_samples(ops, buckets, 10, 0) == (ops, buckets)


def test_compaction_keeps_aligned_aggregates(spark):
    rng = random.Random(3)
    ops = samples(spark, *((t, rng.randint(0, 99)) for t in rng.sample(range(1000), 200)))
    left, made = compact.compact_samples(ops, None, 500, 50)
    for agg in (Agg.SUM, Agg.COUNT, Agg.MIN, Agg.MAX, Agg.FIRST, Agg.LAST):
        assert got(read.sample_range(left, 100, agg, made)) == got(read.sample_range(ops, 100, agg))


def test_counters(spark):
    ops = counters(spark, (10, 2), (10, 3))
    assert got(read.counter_values(ops, None, 10, 10)) == {10: 5.0}
    assert got(read.counter_range(ops, 1, Agg.SUM)) == {10: 5.0}
    twice = counters(spark, (1, 2))
    assert got(read.counter_values(twice.unionByName(twice))) == {1: 2.0}
    ops, buckets = counters(spark, (1, 1), (2, 2), (2, 3)), counter_buckets(spark, (1, 1), (2, 4))
    assert got(read.counter_values(ops, buckets, 2, 2)) == {2: 9.0}
    assert got(read.counter_range(ops, 60, Agg.SUM, buckets, 2, 2)) == {0: 9.0}
    left, made = compact.compact_counters(counters(spark, (10, 1), (20, 2)), counter_buckets(spark, (1, 1)), 15, 10)
    assert got(left) == {20: 2} and got(made, "sum") == {1: 1, 10: 1}
    assert got(read.counter_range(counters(spark, (1, 2)), 10, Agg.SUM, counter_buckets(spark, (10, 3)), 1, 10)) == {0: 2.0, 10: 3.0}
    assert got(read.counter_values(counters(spark, (10, 2), (20, 3), (20, 4)), counter_buckets(spark, (100, 7)), 10, 100)) == {10: 2.0, 20: 7.0, 100: 7.0}


def test_counter_order_within_a_second(spark):
    rows = [("s", 5, Decimal(2), 1, 9), ("s", 5, Decimal(1), 1, 4), ("s", 5, Decimal(1), 3, 6)]
    ops = spark.createDataFrame(rows, schema.COUNTER_OPS)
    assert got(read.counter_range(ops, 10, Agg.FIRST)) == {0: 4.0}
    assert got(read.counter_range(ops, 10, Agg.LAST)) == {0: 6.0}


def test_sketch_statistics_and_quantiles(spark):
    ops = samples(spark, (60, 10), (60, -10), (60, 5), (60, 0), (61, 20))
    first = next(r for r in distributions.stats(ops, 0, None, 60, 61).collect() if r["t"] == 60)
    assert (first["count"], first["sum"], first["min"], first["max"], first["mean"]) == (4, 5.0, -10.0, 10.0, 1.25)
    wanted = {"q0": 0, "q5": 0.5, "q75": 0.75, "q1": 1, "bad": 1.1}
    told = next(r for r in distributions.quantiles(ops, 0, wanted).collect() if r["t"] == 60)
    assert (told["q0"], told["q5"], told["q75"], told["q1"]) == (-10.0, 0.0, 5.0, 10.0) and math.isnan(told["bad"])
    whole = distributions.stats(ops, 60).first()
    assert (whole["count"], whole["sum"], whole["max"]) == (5, 25.0, 20.0)


def test_sketch_merge_keeps_the_greatest_bits(spark):
    rows = [("s", 2, v, 7, Decimal(3)) for v in (1.0, 2.0)] + [("s", 3, v, 7, Decimal(3)) for v in (5.0, -1.0, -2.0)]
    for order in (rows, rows[::-1]):
        assert got(resolve.sketches(spark.createDataFrame(order, schema.SKETCH_OPS))) == {2: 2.0, 3: -2.0}


def test_compacted_sketch_with_late_data(spark):
    ops = samples(spark, *((100, v) for v in (-100, -1, 0, 1, 100)))
    left, buckets = compact.compact_sketches(ops, None, 200, 60)
    assert left.isEmpty()
    wanted = {"a": 0.25, "b": 0.5, "c": 0.75, "lo": 0, "hi": 1}
    told = distributions.quantiles(left, 60, wanted, buckets).first()
    assert (told["lo"], told["b"], told["hi"]) == (-100.0, 0.0, 100.0)
    assert told["a"] == pytest.approx(-0.990001, abs=1e-6) and told["c"] == pytest.approx(0.990001, abs=1e-6)
    late = samples(spark, (100, 200), clock=50)
    stats = distributions.stats(late, 60, buckets).first()
    told = distributions.quantiles(late, 60, wanted, buckets).first()
    assert (stats["count"], stats["max"], told["b"], told["hi"]) == (6, 200.0, 0.0, 200.0)
    merged = compact.compact_sketches(late, buckets, 200, 60)[1].first()
    assert (merged["count"], merged["zero"], sum(merged["pos"].values()), sum(merged["neg"].values())) == (6, 1, 3, 2)


def test_bins_stay_within_one_percent(spark):
    rng = random.Random(5)
    values = [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(500)] + [0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    back = df.select("v", bins.representative(bins.sign(F.col("v")), bins.key(F.col("v"))).alias("r")).collect()
    assert all(abs(r["r"] - r["v"]) <= 0.01 * abs(r["v"]) for r in back)


def test_collapse_is_independent_of_order(spark):
    rows = [("s", 0, 1, k, 1) for k in range(1100)] + [("s", 0, -1, 5, 1)]
    results = []
    for order in (rows, rows[::-1]):
        df = distributions.collapsed(spark.createDataFrame(order, "series string, t bigint, sign int, key int, n bigint"))
        results.append({(r["sign"], r["key"]): r["n"] for r in df.collect()})
    assert results[0] == results[1]
    assert len(results[0]) == 1025 and sum(results[0].values()) == 1101 and results[0][0, 0] == 77


def test_input_checks(spark):
    bad = spark.createDataFrame([(float("nan"),)], "v double")
    with pytest.raises(Exception, match="finite"):
        schema.ops(bad, "sketches", F.lit("s"), F.lit(1), F.col("v"), F.lit(1), F.lit(1)).collect()
    with pytest.raises(Exception, match="only grows"):
        schema.ops(spark.createDataFrame([(-1,)], "v bigint"), "counters", F.lit("s"), F.lit(1), F.col("v"), F.lit(1), F.lit(1)).collect()


def test_identities():
    assert fnv1a_64("") == 0xCBF29CE484222325 and fnv1a_64("a") == 0xAF63DC4C8601EC8C
    assert 0 <= default_replica() < 2**63


def test_bounds_reach_the_scan(spark, tmp_path):
    samples(spark, (1, 1)).write.parquet(str(tmp_path / "ops"))
    df = read.sample_values(spark.read.parquet(str(tmp_path / "ops")), None, 5, 9)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,5)" in plan and "LessThanOrEqual(t,9)" in plan


def test_damaged_buckets_are_told(spark):
    from tideline.operators import distributions
    from tideline.schema import SKETCH_BUCKETS

    row = lambda n, zero, neg, pos: spark.createDataFrame([("s", 0, n, 0.0, 0.0, 0.0, zero, neg, pos)], SKETCH_BUCKETS)
    assert distributions.bucket_bins(row(4, 1, {3: 2}, {-1: 1})).count() == 3
    for bad in (row(5, 1, {3: 2}, {-1: 1}), row(3, 1, {3: 2}, {-1: 0}), row(1025, 0, {}, dict.fromkeys(range(1025), 1))):
        with pytest.raises(Exception, match="damaged bucket of s at 0"):
            distributions.bucket_bins(bad).collect()
        with pytest.raises(Exception, match="damaged"):
            distributions.stats(spark.createDataFrame([], "series string, t bigint, value double, clock bigint, replica decimal(20,0)"), 60, bad).collect()


def test_rendered_times(spark):
    from tideline.functions.series import rendered

    times = spark.createDataFrame([(0,), (-1,), (1705363200,)], "t bigint").select(rendered(F.col("t")).cast("string"), rendered(F.col("t"), "Asia/Tokyo").cast("string")).collect()
    assert [tuple(r) for r in times] == [("1970-01-01 00:00:00", "1970-01-01 09:00:00"), ("1969-12-31 23:59:59", "1970-01-01 08:59:59"), ("2024-01-16 00:00:00", "2024-01-16 09:00:00")]


def test_large_groups_give_the_same_quantiles(spark):
    rng = random.Random(3)
    rows = [(("s0", "s1", None)[k % 3], rng.randint(0, 400), rng.choice([0.0, rng.gauss(0, 50), rng.choice([1.5, -2.5])]), k, Decimal(0)) for k in range(900)]
    ops = spark.createDataFrame(rows, schema.SAMPLE_OPS)
    wanted = {"lo": 0.0, "a": 0.001, "b": 0.25, "c": 0.5, "d": 0.999, "hi": 1.0, "none": 1.5}
    left, buckets = compact.compact_sketches(ops, None, 150, 50)
    for these, old in ((ops, None), (left, buckets)):
        one, some, every = ({(r["series"], r["t"]): [repr(x) for x in r[2:]] for r in distributions.quantiles(these, 100, wanted, old, most=m).collect()} for m in (1000, 74, 0))
        assert one == some == every and len(one) == len({(r[0], r[1] // 100) for r in rows})
    # A group that has a bucket has one row, whatever its series is called.
    assert distributions.quantiles(left, 100, wanted, buckets).count() == len(one)


def test_a_hot_group_is_ranked_by_many_tasks(spark, monkeypatch):
    """All values of one hour, most of them within a millionth of each other: no range holds twice the median."""
    ops = spark.range(40_000).select(F.lit("hot").alias("series"), (F.col("id") % 3600).alias("t"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(1 + F.col("id") * 1e-11).alias("value"), F.col("id").alias("clock"), F.lit(0).cast("decimal(20,0)").alias("replica"))
    held = []
    keep = lambda df: held.append(distributions_written(df)) or held[-1]
    distributions_written = distributions.written
    monkeypatch.setattr(distributions, "written", keep)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        told = distributions.quantiles(ops, 3600, {"a": 0.1, "b": 0.5, "c": 0.95}, most=5000).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = sorted(float(i) if i % 10 == 0 else 1 + i * 1e-11 for i in range(40_000))
    assert [told["a"], told["b"], told["c"]] == [values[math.ceil(q * 40_000) - 1] for q in (0.1, 0.5, 0.95)]
    sizes = sorted(r["count"] for r in held[-1].groupBy("range").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
