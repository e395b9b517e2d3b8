"""Sketch-valued columns."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline import schema
from tideline.functions import bins, sketches
from tideline.operators import compact, distributions
from tideline.operators.sketches import combined, sketch_range, sketched

QS = (0, 0.001, 0.25, 0.5, 0.9, 0.999, 1)


def _asked(df):
    c = F.col("sketch")
    told = df.select(*[x for x in df.columns if x != "sketch"], sketches.count(c).alias("n"), sketches.total(c).alias("sum"), sketches.least(c).alias("lo"), sketches.greatest(c).alias("hi"), sketches.mean(c).alias("mean"), F.array(*(sketches.quantile(c, q) for q in QS)).alias("q"))
    return {r[0]: r for r in told.collect()}


def _values(rng, n):
    return [rng.choice((0.0, rng.gauss(0, 1), rng.gauss(500, 3), -(10 ** rng.uniform(-8, 8)))) for _ in range(n)]


def test_answers_of_groups_are_within_a_percent(spark):
    rng = random.Random(2)
    groups = {g: _values(rng, n) for g, n in (("a", 1), ("b", 7), ("c", 900))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    rng.shuffle(rows)
    told = _asked(sketched(spark.createDataFrame(rows, "g string, value double").repartition(4), ["g"]))
    assert set(told) == set(groups)
    for g, vs in groups.items():
        r, vs = told[g], sorted(vs)
        assert (r["n"], r["lo"], r["hi"]) == (len(vs), vs[0], vs[-1]) and r["sum"] == pytest.approx(sum(vs)) and r["mean"] == pytest.approx(sum(vs) / len(vs))
        for q, got in zip(QS, r["q"], strict=True):
            want = vs[max(math.ceil(q * len(vs)), 1) - 1]
            assert abs(got - want) <= 0.01 * abs(want)


def test_merging_equals_building_at_once(spark):
    rng = random.Random(4)
    rows = [(k % 2, k % 10, v) for k, v in enumerate(_values(rng, 2000))]
    df = spark.createDataFrame(rows, "week int, day int, value double")
    days = sketched(df, ["week", "day"])
    for other in (combined(days, ["week"]), combined(days.where("day < 4"), ["week"], values=df.where("day >= 4").select("week", "value"))):
        one, two = _asked(sketched(df, ["week"])), _asked(other)
        for week in (0, 1):
            assert one[week]["q"] == two[week]["q"] and (one[week]["n"], one[week]["lo"], one[week]["hi"]) == (two[week]["n"], two[week]["lo"], two[week]["hi"])
            assert one[week]["sum"] == pytest.approx(two[week]["sum"])


def test_nothing_and_questions_without_an_answer(spark):
    none = spark.createDataFrame([(1, (0, 0.0, None, None, [])), (2, None)], f"g int, sketch {sketches.SKETCH}")
    for r in _asked(none).values():
        assert (r["n"], r["sum"]) == (0, 0.0) and all(map(math.isnan, (r["lo"], r["hi"], r["mean"], *r["q"])))
    assert combined(none, ["g"]).isEmpty() and sketched(spark.createDataFrame([], "g int, value double"), ["g"]).isEmpty()
    one = sketched(spark.createDataFrame([(1, 3.0)], "g int, value double"), ["g"])
    assert all(math.isnan(x) for x in one.select(*(sketches.quantile(F.col("sketch"), q) for q in (-0.1, 1.1, float("nan")))).first())


def test_collapse_equals_the_rows_way(spark):
    rng = random.Random(8)
    for size in (5, 20, 60):
        rows = sorted({(s, k) for s, k in ((rng.choice((-1, 0, 1)), rng.randint(-30, 30)) for _ in range(size))})
        rows = list({(s, k if s else 0): rng.randint(1, 9) for s, k in rows}.items())
        flat = spark.createDataFrame([("s", 0, s, k, n) for (s, k), n in rows], "series string, t bigint, sign int, key int, n bigint")
        want = [tuple(r)[2:] for r in distributions.collapsed(flat, 12).collect()]
        got = flat.groupBy("series").agg(F.collect_list(F.struct("sign", "key", "n")).alias("h")).select(sketches.collapsed(F.col("h"), 12)).first()[0]
        assert [tuple(b) for b in got] == sorted(want, key=lambda b: (b[0], b[0] * b[1]))


def test_buckets_there_and_back(spark):
    rng = random.Random(6)
    rows = [(f"s{k % 3}", rng.randint(0, 300), v, k, Decimal(0)) for k, v in enumerate(_values(rng, 600))]
    ops = spark.createDataFrame(rows, schema.SKETCH_OPS)
    left, buckets = compact.compact_sketches(ops, None, 150, 50)
    back = buckets.select("series", "t", *sketches.as_bucket(sketches.of_bucket()))
    assert back.select(buckets.columns).orderBy("series", "t").collect() == buckets.orderBy("series", "t").collect()
    whole, parts = sketch_range(ops, 100), sketch_range(left, 100, buckets)
    held = lambda df: sorted((r["series"], r["t"], r["sketch"]["count"], [tuple(b) for b in r["sketch"]["bins"]]) for r in df.collect())
    assert held(whole) == held(parts) and len(held(whole)) > 6


def test_asking_needs_no_shuffle(spark):
    df = sketched(spark.createDataFrame([("a", 1.0)], "g string, value double"), ["g"])
    path = f"{spark.conf.get('spark.checkpoint.dir')}/kept-sketches"
    df.write.mode("overwrite").parquet(path)
    plan = spark.read.parquet(path).select(sketches.quantile(F.col("sketch"), 0.5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_bins_hold_the_range_of_doubles(spark):
    tiny, huge = 5e-324, 1.7976931348623157e308
    r = _asked(sketched(spark.createDataFrame([("a", v) for v in (tiny, -tiny, huge, -huge, 0.0)], "g string, value double"), ["g"]))["a"]
    assert (r["lo"], r["hi"], r["q"][3]) == (-huge, huge, 0.0)
    assert r["q"][2] == pytest.approx(-tiny, abs=1e-300) and abs(bins.SCALE) > 50
