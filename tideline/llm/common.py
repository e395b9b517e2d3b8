"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every word-based contract: space and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session within one process may go without naming one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tideline-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session may have ended already; the folder is scratch
        pass


#: Spark then drops the shuffle files of a statement when it ends; later ones read what it wrote.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back; survives the loss of any executor."""
    spark = df.sparkSession
    path, before = f"{scratch_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer = df.write.option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialise() has written, once nothing reads it any more."""
    _delete(df.sparkSession, df.written_to)


#: Stands for a null id on the way through pandas, which would turn a column with nulls to floating point.
NO_ID = -(1 << 63)


def without_nulls(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """df with NO_ID for null in a bigint column; other types pass pandas as they are."""
    return df.withColumn(column, F.coalesce(column, F.lit(NO_ID))) if dict(df.dtypes)[column] == "bigint" else df


def with_nulls(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) != F.lit(NO_ID), F.col(column))) if dict(df.dtypes)[column] == "bigint" else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that a batch of long texts fits a Python worker, and send workers the code."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    context = spark.sparkContext
    if getattr(context, "_tideline_sent", None) is None:
        package = Path(__file__).resolve().parents[1]
        zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tideline-')}/tideline", "zip", package.parent, package.name)
        context.addPyFile(zipped)
        context._tideline_sent = zipped
