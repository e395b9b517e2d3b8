"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, centroids, chat, decontaminate, exact_dedup, near_dup, pii, quality_model, quality_rules, resample, secrets, substring_dedup, url_filter
from tideline.llm.common import arrow_rows, table
from tideline.llm.oracles import INJECTION, ORACLES, op4
from tideline.llm.spans import count_kind, joined

#: The rules of the URL contract (fixed values).
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def _base_columns(spans: str, kinds: tuple[str, ...]) -> list:
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return [*(count_kind(F.col(spans), k).alias(f"n_{k}") for k in kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans")]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_base_columns("spans", pii.KINDS[:4]))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_base_columns("secret_spans", tuple(r.kind for r in secrets.BASE_RULES)))


def op2_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.with_scores(docs, trees).select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("lm_score", 6).alias("lm_score"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    distance = lambda c: F.round(c, 6).alias(c) if c.endswith("_distance") else F.col(c)
    return judged.select("doc_id", *map(distance, quality_rules.RESULTS))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", INJECTION), (-1, 1, "assistant", INJECTION)], "conv_id long, turn long, role string, text string")
    arrow_rows(spark)
    return chat.digests(chat.format_trees(chat.reply_chain(rows.unionByName(planted))))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark").select("text"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two batches, told by a hash of the id: the first becomes the snapshot that the second meets."""
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    found = exact_dedup.deduplicate([docs.where(~second), docs.where(second)])
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return centroids.described(*centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


__all__ = ["ORACLES", "QUERIES"]

ORACLES = ORACLES | {"op4_url_filter": op4(RULES)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op10_secrets": op10_secrets,
    "op2_bpe": op2_bpe,
    "op3_near_dup": op3_near_dup,
    "op4_url_filter": op4_url_filter,
    "op5_quality_model": op5_quality_model,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_format": op9_chat_format,
    "op11_resample": op11_resample,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_centroids": op13_centroids,
}
