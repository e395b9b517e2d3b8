"""A distribution as a column: what sketches hold and what can be asked of them, by array functions alone.

A sketch is a struct of count, sum, min, max and bins; the bins (sign, key, n) are in the order of the values that they
stand for, the zero bin among them. Quantiles are of the nearest rank, within one percent, and never beyond min and max.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions import bins

BIN = "struct<sign:int,key:int,n:bigint>"
SKETCH = f"struct<count:bigint,sum:double,min:double,max:double,bins:array<{BIN}>>"


def _bin(sign: Column, key: Column, n: Column) -> Column:
    return F.struct(sign.cast("int").alias("sign"), key.cast("int").alias("key"), n.cast("bigint").alias("n"))


def in_order(held: Column) -> Column:
    """Bins sorted by the values that they stand for."""
    placed = F.transform(held, lambda b: F.struct((b["sign"] * F.lit(1 << 20) + b["sign"] * b["key"]).alias("at"), b.alias("b")))
    return F.transform(F.array_sort(placed), lambda x: x["b"])


def collapsed(held: Column, most: int = bins.MAX_BINS) -> Column:
    """Ordered bins of which at most ``most`` are not the zero bin: those of smallest key beyond that, negative ones first,
    join it."""
    # Largest key first, positive before negative; what follows the first ``most`` goes to zero.
    ranked = F.transform(F.filter(held, lambda b: b["sign"] != 0), lambda b: F.struct((-b["key"]).alias("key"), (-b["sign"]).alias("sign"), b.alias("b")))
    ranked = F.transform(F.array_sort(ranked), lambda x: x["b"])
    stay, go = F.slice(ranked, 1, most), F.slice(ranked, most + 1, F.greatest(F.size(ranked) - most, F.lit(0)))
    zero = F.aggregate(F.concat(go, F.filter(held, lambda b: b["sign"] == 0)), F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    nothing = F.array().cast(f"array<{BIN}>")
    joined = F.concat(stay, F.when(zero > 0, F.array(_bin(F.lit(0), F.lit(0), zero))).otherwise(nothing))
    return F.when(F.size(held) > most, in_order(joined)).otherwise(in_order(held))


def bucket_bins() -> Column:
    """The bins of a stored bucket's columns (zero, neg, pos), in no order."""
    side = lambda c, s: F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<int,bigint>"))), lambda e: _bin(F.lit(s), e["key"], e["value"]))
    zero = F.when(F.col("zero") > 0, F.array(_bin(F.lit(0), F.lit(0), F.col("zero")))).otherwise(F.array().cast(f"array<{BIN}>"))
    return F.concat(side(F.col("neg"), -1), zero, side(F.col("pos"), 1))


def of_bucket() -> Column:
    """A stored bucket's columns (count, sum, min, max, zero, neg, pos) as a sketch."""
    return F.struct("count", "sum", "min", "max", in_order(bucket_bins()).alias("bins"))


def as_bucket(sketch: Column) -> list[Column]:
    """The columns of a stored bucket from a sketch."""
    side = lambda s: F.map_from_entries(F.transform(F.filter(sketch["bins"], lambda b: b["sign"] == s), lambda b: F.struct(b["key"], b["n"])))
    zero = F.aggregate(F.filter(sketch["bins"], lambda b: b["sign"] == 0), F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    return [*(sketch[c].alias(c) for c in ("count", "sum", "min", "max")), zero.alias("zero"), side(-1).alias("neg"), side(1).alias("pos")]


def count(sketch: Column) -> Column:
    return F.coalesce(sketch["count"], F.lit(0).cast("bigint"))


def total(sketch: Column) -> Column:
    """The sum; 0 of none."""
    return F.coalesce(sketch["sum"], F.lit(0.0))


def _or_nan(sketch: Column, value: Column) -> Column:
    return F.when(sketch["count"] > 0, value).otherwise(F.lit(float("nan")))


def least(sketch: Column) -> Column:
    return _or_nan(sketch, sketch["min"])


def greatest(sketch: Column) -> Column:
    return _or_nan(sketch, sketch["max"])


def mean(sketch: Column) -> Column:
    return _or_nan(sketch, sketch["sum"] / sketch["count"])


def quantile(sketch: Column, q: float) -> Column:
    """The value of rank ceil(q n): the representative of the first bin up to which so many lie. NaN of none and for q
    outside 0 to 1; the quantiles 0 and 1 are min and max."""
    if math.isnan(q) or not 0 <= q <= 1:
        return F.lit(float("nan"))
    if q in (0, 1):
        return least(sketch) if q == 0 else greatest(sketch)
    rank = F.greatest(F.ceil(F.lit(q) * sketch["count"]), F.lit(1)).cast("bigint")
    start = F.struct(rank.alias("left"), F.lit(0).alias("sign"), F.lit(0).alias("key"))
    step = lambda a, b: F.when(a["left"] > 0, F.struct((a["left"] - b["n"]).alias("left"), b["sign"].alias("sign"), b["key"].alias("key"))).otherwise(a)
    told = lambda a: bins.representative(a["sign"], a["key"])
    return _or_nan(sketch, F.greatest(F.least(F.aggregate(sketch["bins"], start, step, told), sketch["max"]), sketch["min"]))
