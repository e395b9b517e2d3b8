"""Logarithmic bins of bounded relative error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins of a sketch, contracted and built-in relative error.
MAX_BINS, ERROR, BUILT_ERROR = 1024, 0.01, 0.009999
GAMMA = (1 + BUILT_ERROR) / (1 - BUILT_ERROR)
SCALE = 1 / math.log(GAMMA)


def sign(v: Column) -> Column:
    return F.when(v < 0, -1).when(v > 0, 1).otherwise(0)


def key(v: Column) -> Column:
    """Number of the bin whose magnitudes reach up to GAMMA ** key; 0 for zero."""
    return F.when(v == 0, 0).otherwise(F.ceil(F.ln(F.abs(v)) * F.lit(SCALE))).cast("int")


def representative(sign: Column, key: Column) -> Column:
    return F.when(sign == 0, F.lit(0.0)).otherwise(sign * 2.0 * F.pow(F.lit(GAMMA), key.cast("double")) / F.lit(GAMMA + 1))
