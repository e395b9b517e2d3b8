"""A training-data pipeline of five text operators, each working on all that the one before it kept.

quality      drops documents that the quality classifier rejects (score below 0.3)
near_dup     keeps one document, the smallest id, of each group of near copies
decontaminate drops documents that hold a benchmark item
secrets      replaces secrets in the texts that stay by marks
tokens       encodes the texts, giving the ids to train on

Every stage but the last returns the columns of documents. Decisions are made and applied by row, so rows that repeat an
id, or have none, are judged like any other: of wholly equal rows one stays. A null text counts as empty; texts without
words are like no other; of a group without any id the row that comes first stays; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, near_dup, quality_model, secrets
from tideline.llm.common import arrow_rows, materialise, table

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    trees = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.with_scores(docs, trees).where("predicted = 1").select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written so that it holds for every later read."""
    return materialise(docs.withColumn("__row", F.monotonically_increasing_id()))


def _by_row(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("__row").alias("doc_id"), "text")


def _without(numbered: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The documents whose number is not among gone (doc_id)."""
    return numbered.join(gone.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    numbered = _numbered(docs)
    groups = materialise(near_dup.near_duplicates(_by_row(numbered)).select("doc_id", "component_id"))
    # Only rows of groups of several are told apart further: the smallest id stays, null being the largest.
    others = groups.where("doc_id <> component_id")
    several = others.select("component_id").distinct()
    members = materialise(others.unionByName(groups.where("doc_id = component_id").join(several, "component_id", "left_semi").select(others.columns)))
    ids = members.join(numbered.select(F.col("__row").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
    first = ids.groupBy("component_id").agg(F.min(rank)["doc_id"].alias("doc_id"))
    return _without(numbered, members.join(first, "doc_id", "left_anti"), docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    numbered = _numbered(docs)
    return _without(numbered, decontaminate.contaminated(_by_row(numbered), table(spark, sf_dir, "benchmark")), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(secrets.scan_secrets(docs)).select(docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return bpe.encode_texts(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_tokens", F.col("ids").cast("array<int>").alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dup", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: Similarity, trained trees and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
