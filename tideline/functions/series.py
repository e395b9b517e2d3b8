"""Bucketing and the seven aggregates."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Agg(Enum):
    SUM = "sum"
    COUNT = "count"
    MIN = "min"
    MAX = "max"
    MEAN = "mean"
    FIRST = "first"
    LAST = "last"


def bucket_start(t: Column, span: int) -> Column:
    """Start of the epoch-aligned bucket; a span under one second leaves the time as it is. Integer arithmetic only."""
    return t - F.pmod(t, F.lit(int(span))) if span >= 1 else t


def fold(agg: Agg) -> Column:
    """An aggregate over partial rows (n, s, mn, mx, f, l, ord); ord says which row is first and last."""
    return {
        Agg.SUM: F.sum("s").cast("double"),
        Agg.COUNT: F.sum("n").cast("double"),
        Agg.MIN: F.min("mn").cast("double"),
        Agg.MAX: F.max("mx").cast("double"),
        Agg.MEAN: F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)),
        Agg.FIRST: F.min_by("f", "ord").cast("double"),
        Agg.LAST: F.max_by("l", "ord").cast("double"),
    }[agg]


def rendered(t: Column, zone: str | None = None) -> Column:
    """Whole seconds as a timestamp without zone: in UTC, or as clocks show it in a zone."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=t.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at) if zone else at
