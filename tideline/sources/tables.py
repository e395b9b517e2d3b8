"""The driver's tables as operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.schema import ops, seconds


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as(kind: str, df: DataFrame) -> DataFrame:
    """events: samples of value, counters of the number in props, sketches of value less 50."""
    value = {"samples": F.col("value"), "counters": F.get_json_object("props", "$.k"), "sketches": F.col("value") - 50}[kind]
    return ops(df, kind, F.col("event_type"), seconds(F.col("ts")), value, F.col("event_id"), F.col("user_id"))


def orders_as(kind: str, df: DataFrame) -> DataFrame:
    """orders: the total price by priority and date; many orders share both."""
    return ops(df, kind, F.col("o_orderpriority"), seconds(F.col("o_orderdate")), F.col("o_totalprice"), F.col("o_orderkey"), F.lit(0))


def lineitem_as(kind: str, df: DataFrame) -> DataFrame:
    """lineitem: the extended price by return flag and ship date; order and line number tell operations apart."""
    return ops(df, kind, F.col("l_returnflag"), seconds(F.col("l_shipdate")), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))
