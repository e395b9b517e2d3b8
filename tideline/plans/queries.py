"""The registered queries of the series engine, each with the SQL of the same relation.

Sums of doubles are rounded on both sides, as their order is not fixed, and a nudge far below the last digit keeps
means of two-digit values off the points where rounding turns; the operators themselves do not round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions import bins, sketches
from tideline.functions.series import Agg, bucket_start, rendered
from tideline.operators import compact, distributions, read, resolve
from tideline.operators.sketches import combined, sketch_range
from tideline.schema import KINDS
from tideline.sources.scratch import scratch, written
from tideline.sources.source import register_source
from tideline.sources.store import ParquetStore
from tideline.sources.tables import events_as, lineitem_as, load, orders_as
from tideline.streaming.ingest import ingest, keep_latest, rolled, rollup
from tideline.streaming.live import keep_range, newest

#: Window whose ends lie inside buckets; cutoff of compaction (2024-01-16); spans.
START, END, CUTOFF, HOUR, DAY = 1704243617, 1706000000, 1705363200, 3600, 86400
NUDGE = 3.1415926e-6
WANTED = {"p50": 0.5, "p90": 0.9, "p99": 0.99}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql.replace(", 4)", f" + {NUDGE}, 4)")
        return f

    return add


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(F.col(c) + NUDGE, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return events_as("samples", load(spark, sf, "events"))


def _counters(spark: SparkSession, sf: str) -> DataFrame:
    return events_as("counters", load(spark, sf, "events"))


def _sketches(spark: SparkSession, sf: str) -> DataFrame:
    return events_as("sketches", load(spark, sf, "events"))


# Samples ------------------------------------------------------------------------------------------------------------

_SOPS = "sops AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS t, value, event_id AS clock, user_id AS replica, event_id FROM events)"
_RS = f"{_SOPS}, rs AS (SELECT series, t, arg_max(value, row(clock, replica)) AS value FROM sops GROUP BY 1, 2)"
_POINT = "series, t, 1 AS n, value AS s, value AS mn, value AS mx, value AS f, value AS l, 2 * t + 1 AS ord"


def _made(source: str, span: int) -> str:
    return f"SELECT series, t - t % {span} AS t, count(*) AS n, sum(value) AS s, min(value) AS mn, max(value) AS mx, arg_min(value, t) AS f, arg_max(value, t) AS l FROM {source} GROUP BY 1, 2"


_FOLD = {"sum": "round(sum(s), 4)", "count": "CAST(sum(n) AS DOUBLE)", "min": "round(min(mn), 4)", "max": "round(max(mx), 4)", "mean": "round(sum(s) / sum(n), 4)", "first": "round(arg_min(f, ord), 4)", "last": "round(arg_max(l, ord), 4)"}
_SU = f"{_RS}, cb AS ({_made(f'(SELECT * FROM rs WHERE t < {CUTOFF})', HOUR)}), su AS (SELECT {_POINT} FROM rs WHERE t >= {CUTOFF} UNION ALL SELECT *, 2 * t FROM cb)"


@_query("samples_values", f"WITH {_RS} SELECT series, t, value FROM rs")
def samples_values(spark: SparkSession, sf: str) -> DataFrame:
    return read.sample_values(_samples(spark, sf))


@_query("samples_values_window", f"WITH {_RS} SELECT series, t, value FROM rs WHERE t BETWEEN {START} AND {END}")
def samples_values_window(spark: SparkSession, sf: str) -> DataFrame:
    return read.sample_values(_samples(spark, sf), None, START, END)


@_query("samples_values_rendered", f"WITH {_RS} SELECT series, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS time, value FROM rs")
def samples_values_rendered(spark: SparkSession, sf: str) -> DataFrame:
    return read.sample_values(_samples(spark, sf)).select("series", rendered(F.col("t")).cast("string").alias("time"), "value")


@_query("samples_range_span0", f"WITH {_RS} SELECT series, t, value FROM rs WHERE t BETWEEN {START} AND {END}")
def samples_range_span0(spark: SparkSession, sf: str) -> DataFrame:
    return read.sample_range(_samples(spark, sf), 0, Agg.MAX, None, START, END)


@_query("samples_lww_orders", "SELECT o_orderpriority AS series, CAST(epoch(o_orderdate) AS BIGINT) AS t, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2")
def samples_lww_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read.sample_values(orders_as("samples", load(spark, sf, "orders")))


@_query("samples_buffer_overlay", f"WITH {_RS} SELECT series, t, value FROM rs")
def samples_buffer_overlay(spark: SparkSession, sf: str) -> DataFrame:
    ops = _samples(spark, sf)
    committed, pending = ops.where(F.col("clock") % 3 != 0), ops.where(F.col("clock") % 3 <= 1)
    return read.sample_values(committed.unionByName(pending))


for _agg in Agg:

    def _samples_range(spark: SparkSession, sf: str, agg: Agg = _agg) -> DataFrame:
        return _rounded(read.sample_range(_samples(spark, sf), HOUR, agg, None, START, END))

    _query(f"samples_range_{_agg.value}", f"WITH {_RS}, p AS (SELECT {_POINT} FROM rs WHERE t BETWEEN {START} AND {END}) SELECT series, t - t % {HOUR} AS t, {_FOLD[_agg.value]} AS value FROM p GROUP BY 1, 2")(_samples_range)

    def _samples_compacted(spark: SparkSession, sf: str, agg: Agg = _agg) -> DataFrame:
        ops, buckets = compact.compact_samples(_samples(spark, sf), None, CUTOFF, HOUR)
        return _rounded(read.sample_range(ops, DAY, agg, buckets, START, END))

    _query(f"samples_compact_range_{_agg.value}", f"WITH {_SU} SELECT series, t - t % {DAY} AS t, {_FOLD[_agg.value]} AS value FROM su WHERE t BETWEEN {START} AND {END} GROUP BY 1, 2")(_samples_compacted)


@_query("samples_compact_buckets", f'WITH {_SU} SELECT series, t, n AS count, round(s, 4) AS sum, mn AS min, mx AS max, f AS "first", l AS "last" FROM cb')
def samples_compact_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compact.compact_samples(_samples(spark, sf), None, CUTOFF, HOUR)[1])


@_query("samples_compact_values", f"WITH {_SU} SELECT series, t, round(s / n, 4) AS value FROM su WHERE t BETWEEN {START} AND {END}")
def samples_compact_values(spark: SparkSession, sf: str) -> DataFrame:
    ops, buckets = compact.compact_samples(_samples(spark, sf), None, CUTOFF, HOUR)
    return _rounded(read.sample_values(ops, buckets, START, END))


_PART = "SELECT series, t, arg_max(value, row(clock, replica)) AS value FROM sops WHERE event_id % 2 = {} GROUP BY 1, 2"
_MERGED = 'SELECT series, t, CAST(sum(n) AS BIGINT) AS count, round(sum(s), 4) AS sum, min(mn) AS min, max(mx) AS max, arg_min(f, gen) AS "first", arg_max(l, gen) AS "last" FROM {} GROUP BY 1, 2'


@_query("samples_bucket_merge", f"WITH {_SOPS}, two AS (SELECT *, 0 AS gen FROM ({_made(f'({_PART.format(0)})', DAY)}) UNION ALL SELECT *, 1 FROM ({_made(f'({_PART.format(1)})', DAY)})) {_MERGED.format('two')}")
def samples_bucket_merge(spark: SparkSession, sf: str) -> DataFrame:
    ops = _samples(spark, sf)
    older, newer = (compact.compact_samples(ops.where(F.col("clock") % 2 == k), None, 1 << 40, DAY)[1] for k in (0, 1))
    return _rounded(resolve.sample_buckets(older, newer))


_LATE = f"""{_SOPS}, early AS (SELECT series, t, arg_max(value, row(clock, replica)) AS value FROM sops WHERE event_id % 10 <> 0 GROUP BY 1, 2),
cb AS ({_made(f'(SELECT * FROM early WHERE t < {CUTOFF})', HOUR)}),
left_ops AS (SELECT series, t, value, clock, replica FROM sops WHERE event_id % 10 = 0 OR t >= {CUTOFF}),
rs AS (SELECT series, t, arg_max(value, row(clock, replica)) AS value FROM left_ops GROUP BY 1, 2),
su AS (SELECT {_POINT} FROM rs UNION ALL SELECT *, 2 * t FROM cb)"""


@_query("samples_late_after_compact", f"WITH {_LATE} SELECT series, t - t % {DAY} AS t, {_FOLD['mean']} AS value FROM su GROUP BY 1, 2")
def samples_late_after_compact(spark: SparkSession, sf: str) -> DataFrame:
    ops = _samples(spark, sf)
    late = F.col("clock") % 10 == 0
    left, buckets = compact.compact_samples(ops.where(~late), None, CUTOFF, HOUR)
    return _rounded(read.sample_range(left.unionByName(ops.where(late)), DAY, Agg.MEAN, buckets))


# Counters -----------------------------------------------------------------------------------------------------------

_COPS = "cops AS (SELECT DISTINCT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id AS replica, event_id AS clock, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS value FROM events)"
_OP = "series, t, 1 AS n, value AS s, value AS mn, value AS mx, value AS f, value AS l, row(t, 1, clock, replica, value) AS ord"
_CB = f"cb AS (SELECT series, t - t % {HOUR} AS t, CAST(sum(value) AS BIGINT) AS value FROM cops WHERE t < {CUTOFF} GROUP BY 1, 2)"
_CU = f"{_COPS}, {_CB}, cu AS (SELECT {_OP} FROM cops WHERE t >= {CUTOFF} UNION ALL SELECT series, t, 1, value, value, value, value, value, row(t, 0, 0, 0, value) FROM cb)"
_CFOLD = {k: f"CAST({v.removeprefix('round(').removesuffix(', 4)') if k not in ('mean', 'count') else v} AS DOUBLE)" for k, v in _FOLD.items()}


@_query("counters_values", f"WITH {_COPS} SELECT series, t, CAST(sum(value) AS DOUBLE) AS value FROM cops GROUP BY 1, 2")
def counters_values(spark: SparkSession, sf: str) -> DataFrame:
    return read.counter_values(_counters(spark, sf))


@_query("counters_op_dedup", f"WITH {_COPS} SELECT series, t, CAST(sum(value) AS DOUBLE) AS value FROM cops GROUP BY 1, 2")
def counters_op_dedup(spark: SparkSession, sf: str) -> DataFrame:
    ops = _counters(spark, sf)
    return read.counter_values(ops.unionByName(ops))


for _agg in Agg:

    def _counters_range(spark: SparkSession, sf: str, agg: Agg = _agg) -> DataFrame:
        return _rounded(read.counter_range(_counters(spark, sf), HOUR, agg, None, START, END))

    _query(f"counters_range_{_agg.value}", f"WITH {_COPS}, p AS (SELECT {_OP} FROM cops WHERE t BETWEEN {START} AND {END}) SELECT series, t - t % {HOUR} AS t, {_CFOLD[_agg.value]} AS value FROM p GROUP BY 1, 2")(_counters_range)

    def _counters_compacted(spark: SparkSession, sf: str, agg: Agg = _agg) -> DataFrame:
        ops, buckets = compact.compact_counters(_counters(spark, sf), None, CUTOFF, HOUR)
        return _rounded(read.counter_range(ops, DAY, agg, buckets, START, END))

    _query(f"counters_compact_range_{_agg.value}", f"WITH {_CU} SELECT series, t - t % {DAY} AS t, {_CFOLD[_agg.value]} AS value FROM cu WHERE t BETWEEN {START} AND {END} GROUP BY 1, 2")(_counters_compacted)


@_query("counters_compact_values", f"WITH {_CU} SELECT series, t, CAST(sum(s) AS DOUBLE) AS value FROM cu GROUP BY 1, 2")
def counters_compact_values(spark: SparkSession, sf: str) -> DataFrame:
    ops, buckets = compact.compact_counters(_counters(spark, sf), None, CUTOFF, HOUR)
    return read.counter_values(ops, buckets)


# Sketches -----------------------------------------------------------------------------------------------------------

_KOPS = "kops AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS t, value - 50 AS value, event_id AS clock FROM events)"
_STATS = "count(*) AS count, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max, round(sum(value) / count(*), 4) AS mean"
_BIN = f"CAST(sign(value) AS INTEGER) AS sign, CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(ln(abs(value)) * {bins.SCALE!r}) AS INTEGER) END AS key"
_REP = f"CASE WHEN sign = 0 THEN 0 ELSE sign * 2.0 * pow({bins.GAMMA!r}, key) / {bins.GAMMA + 1!r} END"


def _exact_sql(source: str, span: int, q: float) -> str:
    """Nearest-rank quantile of (series, t, value) rows by row number."""
    return f"SELECT series, b AS t, round(min(value) FILTER (WHERE rn >= greatest(ceil({q} * n), 1)), 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series, b ORDER BY value) AS rn, count(*) OVER (PARTITION BY series, b) AS n FROM (SELECT series, t - t % {span} AS b, value FROM {source})) GROUP BY 1, 2"


def _approx_sql(rows: str, q: str = "q") -> str:
    """(series, t, q value) from bin rows (series, t, sign, key, n) of relation rows with extremes in relation ends."""
    return f"SELECT series, t, arg_min(v, cum) AS v FROM (SELECT *, {_REP} AS v, sum(n) OVER (PARTITION BY series, t ORDER BY sign, sign * key) AS cum, sum(n) OVER (PARTITION BY series, t) AS total FROM (SELECT series, t, sign, key, sum(n) AS n FROM {rows} GROUP BY ALL)) WHERE cum >= greatest(ceil({q} * total), 1) GROUP BY 1, 2"


@_query("sketch_values_stats", f"WITH {_KOPS} SELECT series, t, {_STATS} FROM kops GROUP BY 1, 2")
def sketch_values_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(distributions.stats(_sketches(spark, sf), 0))


@_query("sketch_range_stats", f"WITH {_KOPS} SELECT series, t - t % {HOUR} AS t, {_STATS} FROM kops WHERE t BETWEEN {START} AND {END} GROUP BY 1, 2")
def sketch_range_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(distributions.stats(_sketches(spark, sf), HOUR, None, START, END))


@_query("sketch_op_dedup", f"WITH {_KOPS}, both_ops AS (SELECT * FROM kops UNION ALL SELECT series, t, value - 1000, clock FROM kops), one AS (SELECT series, t, clock, arg_max(value, row(value < 0, abs(value))) AS value FROM both_ops GROUP BY 1, 2, 3) SELECT series, t - t % {DAY} AS t, {_STATS} FROM one GROUP BY 1, 2")
def sketch_op_dedup(spark: SparkSession, sf: str) -> DataFrame:
    ops = _sketches(spark, sf)
    return _rounded(distributions.stats(ops.unionByName(ops).unionByName(ops.withColumn("value", F.col("value") - 1000)), DAY))


for _name, _q in WANTED.items():

    def _sketch_range(spark: SparkSession, sf: str, q: float = _q) -> DataFrame:
        return _rounded(distributions.quantiles(_sketches(spark, sf), HOUR, {"value": q}))

    _query(f"sketch_range_{_name}", f"WITH {_KOPS} {_exact_sql('kops', HOUR, _q)}")(_sketch_range)

    def _orders_quantile(spark: SparkSession, sf: str, q: float = _q) -> DataFrame:
        return _rounded(distributions.quantiles(orders_as("sketches", load(spark, sf, "orders")), 30 * DAY, {"value": q}))

    _query(f"sketch_orders_{_name}", f"WITH o AS (SELECT o_orderpriority AS series, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_totalprice AS value FROM orders) {_exact_sql('o', 30 * DAY, _q)}")(_orders_quantile)


_ALL_BINS = f"{_KOPS}, raw AS (SELECT series, t - t % {DAY} AS t, value, {_BIN} FROM kops WHERE t < {CUTOFF}), rows_ AS (SELECT series, t, sign, key, 1 AS n FROM raw), ends AS (SELECT series, t, min(value) AS lo, max(value) AS hi FROM raw GROUP BY 1, 2)"


@_query("sketch_compact_bins", f"WITH {_ALL_BINS} SELECT series, t, sign, key, count(*) AS n FROM rows_ GROUP BY 1, 2, 3, 4")
def sketch_compact_bins(spark: SparkSession, sf: str) -> DataFrame:
    return distributions.bucket_bins(compact.compact_sketches(_sketches(spark, sf), None, CUTOFF, DAY)[1])


@_query("sketch_compact_quantile", f"WITH {_ALL_BINS}, picked AS ({_approx_sql('rows_', '0.9')}) SELECT series, t, round(greatest(least(v, hi), lo), 4) AS p90 FROM picked JOIN ends USING (series, t)")
def sketch_compact_quantile(spark: SparkSession, sf: str) -> DataFrame:
    _, buckets = compact.compact_sketches(_sketches(spark, sf), None, CUTOFF, DAY)
    nothing = _sketches(spark, sf).where("false")
    return _rounded(distributions.quantiles(nothing, DAY, {"p90": 0.9}, buckets))


_MIXED = f"""{_KOPS}, raw AS (SELECT series, t - t % {DAY} AS t, value, {_BIN} FROM kops WHERE t < {CUTOFF} + 43200 OR t >= {CUTOFF} + {DAY}),
groups AS (SELECT DISTINCT series, t - t % {DAY} AS t FROM kops WHERE t < {CUTOFF} + 43200),
part AS (SELECT series, t - t % {DAY} AS t, value, {_BIN} FROM kops SEMI JOIN groups ON kops.series = groups.series AND kops.t - kops.t % {DAY} = groups.t),
rows_ AS (SELECT series, t, sign, key, 1 AS n FROM part), ends AS (SELECT series, t, min(value) AS lo, max(value) AS hi FROM part GROUP BY 1, 2),
others AS (SELECT * FROM kops ANTI JOIN groups ON kops.series = groups.series AND kops.t - kops.t % {DAY} = groups.t)"""


@_query("sketch_mixed_quantile", f"WITH {_MIXED}, picked AS ({_approx_sql('rows_', '0.5')}) SELECT series, t, round(greatest(least(v, hi), lo), 4) AS value FROM picked JOIN ends USING (series, t) UNION ALL ({_exact_sql('others', DAY, 0.5)})")
def sketch_mixed_quantile(spark: SparkSession, sf: str) -> DataFrame:
    # The cutoff lies inside a day: that day is read from buckets and operations together.
    ops, buckets = compact.compact_sketches(_sketches(spark, sf), None, CUTOFF + 43200, HOUR)
    return _rounded(distributions.quantiles(ops, DAY, {"value": 0.5}, buckets))


# Two compactions, one after the other: the second folds what is left into the buckets of the first.
_EARLY, _LATER = CUTOFF - 7 * DAY - 1800, CUTOFF + 1800


@_query("sketch_compact_twice", f"WITH {_KOPS} SELECT series, t - t % {DAY} AS t, CAST(sign(value) AS INTEGER) AS sign, CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(ln(abs(value)) * {bins.SCALE!r}) AS INTEGER) END AS key, count(*) AS n FROM kops WHERE t < {_LATER} GROUP BY ALL")
def sketch_compact_twice(spark: SparkSession, sf: str) -> DataFrame:
    ops, buckets = compact.compact_sketches(_sketches(spark, sf), None, _EARLY, DAY)
    return distributions.bucket_bins(compact.compact_sketches(ops, buckets, _LATER, DAY)[1])


@_query("sketch_bucket_merge", f"WITH {_KOPS} SELECT series, t - t % {DAY} AS t, CAST(sign(value) AS INTEGER) AS sign, CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(ln(abs(value)) * {bins.SCALE!r}) AS INTEGER) END AS key, count(*) AS n FROM kops GROUP BY ALL")
def sketch_bucket_merge(spark: SparkSession, sf: str) -> DataFrame:
    ops = _sketches(spark, sf)
    older, newer = (compact.compact_sketches(ops.where(F.col("clock") % 2 == k), None, 1 << 40, DAY)[1] for k in (0, 1))
    return distributions.bucket_bins(compact.sketch_buckets(older, newer))


@_query("state_merge", f"WITH {_RS}, {_COPS} SELECT 'samples' AS kind, series, t, value FROM rs UNION ALL SELECT 'counters', series, t, CAST(sum(value) AS DOUBLE) FROM cops GROUP BY 1, 2, 3")
def state_merge(spark: SparkSession, sf: str) -> DataFrame:
    # Two replicas that hold some operations both.
    none = {kind: spark.createDataFrame([], KINDS[kind][1]) for kind in KINDS}
    held = lambda some: {kind: (f(spark, sf).where(some), none[kind]) for kind, f in (("samples", _samples), ("counters", _counters))}
    state = compact.merged_states(held(F.col("clock") % 3 != 0), held(F.col("clock") % 3 != 1))
    values = {"samples": read.sample_values(*state["samples"]), "counters": read.counter_values(*state["counters"])}
    return values["samples"].withColumn("kind", F.lit("samples")).unionByName(values["counters"].withColumn("kind", F.lit("counters")))


@_query("counters_compact_twice", f"WITH {_COPS} SELECT series, t - t % {DAY} AS t, CAST(sum(value) AS BIGINT) AS sum FROM cops WHERE t < {_LATER} GROUP BY ALL")
def counters_compact_twice(spark: SparkSession, sf: str) -> DataFrame:
    ops, buckets = compact.compact_counters(_counters(spark, sf), None, _EARLY, DAY)
    return compact.compact_counters(ops, buckets, _LATER, DAY)[1]


# A few bins of the events' compacted days, so that collapsing has something to do; the operator's own limit is MAX_BINS.
_FEW = 64


@_query("sketch_collapse", f"WITH {_ALL_BINS}, b AS (SELECT series, t, sign, key, count(*) AS n FROM rows_ GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY series, t ORDER BY sign = 0, key DESC, sign DESC) <= {_FEW} AND sign <> 0 AS stays FROM b) SELECT series, t, CASE WHEN stays THEN sign ELSE 0 END AS sign, CASE WHEN stays THEN key ELSE 0 END AS key, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL")
def sketch_collapse(spark: SparkSession, sf: str) -> DataFrame:
    day = _sketches(spark, sf).where(F.col("t") < CUTOFF).withColumn("t", bucket_start(F.col("t"), DAY))
    return distributions.collapsed(distributions.binned(day), _FEW)


_WEEK = 7 * DAY
_ASKED = "count(*) AS count, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max"


def _asked_sql(source: str, span: int) -> str:
    """Totals and quantiles of (series, t, value) rows by bins of each span."""
    picked = ", ".join(f"p_{c} AS ({_approx_sql('rows_', str(q))})" for c, q in WANTED.items())
    return f"""raw AS (SELECT series, t - t % {span} AS t, value, {_BIN} FROM {source}), rows_ AS (SELECT series, t, sign, key, 1 AS n FROM raw), ends AS (SELECT series, t, {_ASKED}, min(value) AS lo, max(value) AS hi FROM raw GROUP BY 1, 2), {picked}
SELECT series, t, count, sum, min, max, {', '.join(f'round(greatest(least(p_{c}.v, hi), lo), 4) AS {c}' for c in WANTED)} FROM ends {' '.join(f'JOIN p_{c} USING (series, t)' for c in WANTED)}"""


def _asked(held: DataFrame) -> DataFrame:
    c = F.col("sketch")
    told = (sketches.count(c).alias("count"), sketches.total(c).alias("sum"), sketches.least(c).alias("min"), sketches.greatest(c).alias("max"))
    return _rounded(held.select("series", "t", *told, *(sketches.quantile(c, q).alias(name) for name, q in WANTED.items())))


@_query("sketch_weeks_of_days", f"WITH {_KOPS}, {_asked_sql('kops', _WEEK)}")
def sketch_weeks_of_days(spark: SparkSession, sf: str) -> DataFrame:
    # Sketches by day are written as a table; weeks are made and asked from that table alone.
    days = written(sketch_range(_sketches(spark, sf), DAY))
    return _asked(combined(days.withColumn("t", bucket_start(F.col("t"), _WEEK)), ["series", "t"]))


@_query("sketch_value_mixed", f"WITH {_KOPS}, {_asked_sql('kops', DAY)}")
def sketch_value_mixed(spark: SparkSession, sf: str) -> DataFrame:
    # Buckets by hour up to a time within a day, operations after it: one sketch a day of both.
    ops, buckets = compact.compact_sketches(_sketches(spark, sf), None, CUTOFF + 43200, HOUR)
    return _asked(sketch_range(ops, DAY, buckets))


@_query("sketch_all_series", "WITH o AS (SELECT o_orderpriority AS series, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_totalprice AS value FROM orders), " + _asked_sql("o", 30 * DAY))
def sketch_all_series(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(sketch_range(orders_as("sketches", load(spark, sf, "orders")), 30 * DAY))


@_query("sketch_large_groups", f"WITH w AS (SELECT l_returnflag AS series, CAST(epoch(l_shipdate) AS BIGINT) AS t, max(l_extendedprice) AS value FROM lineitem GROUP BY l_returnflag, l_shipdate, l_orderkey, l_linenumber) SELECT a.series, a.t, a.value AS p50, b.value AS p99 FROM ({_exact_sql('w', 1 << 30, 0.5)}) a JOIN ({_exact_sql('w', 1 << 30, 0.99)}) b USING (series, t)")
def sketch_large_groups(spark: SparkSession, sf: str) -> DataFrame:
    # Three groups hold all line items; each is ranked by ranges.
    items = lineitem_as("sketches", load(spark, sf, "lineitem"))
    return _rounded(distributions.quantiles(items, 1 << 30, {"p50": 0.5, "p99": 0.99}, most=1 << 10))


# Store and streams --------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    schema = load(spark, sf, "events").schema
    # A pattern, as a stream takes no path of a single file.
    return events_as(kind, spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet"))


@_query("store_compact_range", f"WITH {_SU} SELECT series, t - t % {DAY} AS t, {_FOLD['mean']} AS value FROM su WHERE t BETWEEN {START} AND {END} GROUP BY 1, 2")
def store_compact_range(spark: SparkSession, sf: str) -> DataFrame:
    store = ParquetStore(spark, scratch(spark))
    ops = _samples(spark, sf)
    store.append("samples", ops.where(F.col("clock") % 2 == 0))
    store.append("samples", ops.where(F.col("clock") % 2 == 1))
    store.replace("samples", lambda ops, buckets: compact.compact_samples(ops, buckets, CUTOFF, HOUR, merged=True), resolve.samples)
    return _rounded(read.sample_range(store.ops("samples"), DAY, Agg.MEAN, store.buckets("samples"), START, END))


@_query("store_compact_twice", f"WITH {_COPS}, b AS (SELECT series, t - t % {DAY} AS t, value FROM cops WHERE t < {_LATER} UNION ALL SELECT series, t, value FROM cops WHERE t >= {_LATER}) SELECT series, t, CAST(sum(value) AS DOUBLE) AS value FROM b GROUP BY 1, 2")
def store_compact_twice(spark: SparkSession, sf: str) -> DataFrame:
    store = ParquetStore(spark, scratch(spark))
    ops = _counters(spark, sf)
    store.append("counters", ops.where(F.col("t") < _EARLY))
    for cutoff, more in ((_EARLY, ops.where(F.col("t") >= _EARLY)), (_LATER, None)):
        store.replace("counters", lambda ops, buckets, cutoff=cutoff: compact.compact_counters(ops, buckets, cutoff, DAY, merged=True), resolve.counters)
        if more is not None:
            store.append("counters", more)
    return read.counter_values(store.ops("counters"), store.buckets("counters"))


@_query("stream_lww", f"WITH {_RS} SELECT series, t, value FROM rs")
def stream_lww(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    keep_latest(_stream(spark, sf, "samples"), f"{at}/latest", f"{at}/checkpoint").awaitTermination()
    latest = spark.read.parquet(f"{at}/latest")
    return latest.groupBy("series", "t").agg(F.max_by("value", "batch").alias("value"))


@_query("stream_log_range", f"WITH {_COPS}, p AS (SELECT {_OP} FROM cops) SELECT series, t - t % {HOUR} AS t, {_CFOLD['sum']} AS value FROM p GROUP BY 1, 2")
def stream_log_range(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    store = ParquetStore(spark, f"{at}/store")
    ingest(_stream(spark, sf, "counters"), store, "counters", f"{at}/checkpoint").awaitTermination()
    return read.counter_range(store.ops("counters"), HOUR, Agg.SUM, store.buckets("counters"))


def _arriving(spark: SparkSession, sf: str, kind: str, at: str, follow: Callable[[DataFrame], StreamingQuery]) -> None:
    """Three micro-batches: the later two thirds of the events, then the earlier third, late, and then some of all again.
    Each is written by as many tasks as read the events; the stream that follows them starts again where it ended."""
    ops = {"samples": _samples, "counters": _counters, "sketches": _sketches}[kind](spark, sf)
    stream = spark.readStream.schema(ops.schema).parquet(f"{at}/in/*")
    for k, part in enumerate((F.col("t") >= CUTOFF, F.col("t") < CUTOFF, F.col("clock") % 5 == 0)):
        ops.where(part).write.parquet(f"{at}/in/{k}")
        follow(stream).awaitTermination()


_CALL = ", ".join(f"{_CFOLD[k]} AS {n}" for k, n in (("sum", "sum"), ("min", "min"), ("max", "max"), ("first", '"first"'), ("last", '"last"')))


@_query("stream_counters_live", f"WITH {_COPS}, p AS (SELECT {_OP} FROM cops) SELECT series, t - t % {DAY} AS t, CAST(sum(n) AS BIGINT) AS count, {_CALL} FROM p GROUP BY 1, 2")
def stream_counters_live(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    _arriving(spark, sf, "counters", at, lambda ops: keep_range(ops, "counters", DAY, f"{at}/live", f"{at}/checkpoint"))
    return newest(spark.read.parquet(f"{at}/live"))


_SALL = ", ".join(f"{_FOLD[k]} AS {n}" for k, n in (("sum", "sum"), ("min", "min"), ("max", "max"), ("first", '"first"'), ("last", '"last"')))


@_query("stream_samples_live", f"WITH {_RS}, p AS (SELECT {_POINT} FROM rs) SELECT series, t - t % {DAY} AS t, CAST(sum(n) AS BIGINT) AS count, {_SALL} FROM p GROUP BY 1, 2")
def stream_samples_live(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    _arriving(spark, sf, "samples", at, lambda ops: keep_range(ops, "samples", DAY, f"{at}/live", f"{at}/checkpoint"))
    return _rounded(newest(spark.read.parquet(f"{at}/live")))


@_query("stream_sketch_live", f"WITH {_KOPS}, {_asked_sql('kops', DAY)}")
def stream_sketch_live(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    _arriving(spark, sf, "sketches", at, lambda ops: keep_range(ops, "sketches", DAY, f"{at}/live", f"{at}/checkpoint"))
    return _asked(newest(spark.read.parquet(f"{at}/live")))


@_query("stream_counters_rollup", f"WITH {_COPS}, p AS (SELECT {_OP} FROM cops) SELECT series, t - t % {HOUR} AS t, CAST(sum(n) AS BIGINT) AS count, CAST(sum(s) AS BIGINT) AS sum, CAST(min(mn) AS BIGINT) AS min, CAST(max(mx) AS BIGINT) AS max FROM p GROUP BY 1, 2")
def stream_counters_rollup(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    _arriving(spark, sf, "counters", at, lambda ops: rollup(ops, "counters", HOUR, f"{at}/rolled", f"{at}/checkpoint"))
    return rolled(spark.read.parquet(f"{at}/rolled"), "counters")


@_query("stream_sketch_rollup", f"WITH {_KOPS}, {_asked_sql('kops', _WEEK)}")
def stream_sketch_rollup(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    _arriving(spark, sf, "sketches", at, lambda ops: rollup(ops, "sketches", _WEEK, f"{at}/rolled", f"{at}/checkpoint"))
    return _asked(rolled(spark.read.parquet(f"{at}/rolled"), "sketches"))


@_query("source_sql_window", f"WITH {_COPS} SELECT series, t - t % {HOUR} AS t, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM cops WHERE series IN ('click', 'view', 'purchase') AND t BETWEEN {START} AND {END} GROUP BY 1, 2")
def source_sql_window(spark: SparkSession, sf: str) -> DataFrame:
    # The store as a source of SQL: series and time are held against statistics and rows in its reader.
    store = ParquetStore(spark, scratch(spark))
    ops = _counters(spark, sf)
    store.append("counters", ops.where(F.col("t") < CUTOFF))
    store.append("counters", ops.where(F.col("t") >= CUTOFF))
    register_source(spark)
    view = f"counters_{uuid.uuid4().hex}"
    spark.read.format("tideline").options(path=store.root, kind="counters").load().createOrReplaceTempView(view)
    return spark.sql(f"SELECT series, t - pmod(t, {HOUR}) AS t, count(*) AS n, sum(value) AS total FROM (SELECT DISTINCT * FROM {view}) WHERE series IN ('click', 'view', 'purchase') AND t BETWEEN {START} AND {END} GROUP BY 1, 2")


@_query("source_stream_log", f"WITH {_COPS} SELECT series, t, CAST(sum(value) AS DOUBLE) AS value FROM cops GROUP BY 1, 2")
def source_stream_log(spark: SparkSession, sf: str) -> DataFrame:
    # One store follows another's commits as a stream.
    at = scratch(spark)
    store, other, ops = ParquetStore(spark, f"{at}/store"), ParquetStore(spark, f"{at}/other"), _counters(spark, sf)
    register_source(spark)
    for part in (F.col("t") < CUTOFF, F.col("t") >= CUTOFF):
        store.append("counters", ops.where(part))
        stream = spark.readStream.format("tideline").options(path=store.root, kind="counters").load()
        ingest(stream, other, "counters", f"{at}/checkpoint").awaitTermination()
    return read.counter_values(other.ops("counters"))
