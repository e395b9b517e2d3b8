"""Exact deduplication against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import exact_dedup
from tideline.llm.exact_dedup import FuseFilter, Snapshot


def _expected(docs):
    groups = defaultdict(list)
    for i, text in docs:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        last = max(ids, key=lambda i: (i is not None, i or 0))
        left = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, last, len(ids), i == last and left, hashlib.sha256(text.encode()).hexdigest()))
            left &= i != last
    return sorted(out, key=repr)


def _docs(rng, n):
    texts = ["", None, "a", "b", "a ", "ä", "ä", "long " * 20_000, *(f"text {k}" for k in range(60))]
    docs = [(i, rng.choice(texts) if i % 3 else f"one of its own {i}") for i in range(n)]
    return [*docs, (None, "a"), (None, "nobody else"), (None, "nobody"), (None, "nobody"), (7, docs[7][1]), (7, docs[7][1]), (7, "another text")]


def _got(spark, docs, parts, **options):
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, digest string, n int").repartition(7)
    rng = random.Random(1)
    batches = [df.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [df]
    rng.shuffle(batches)
    return exact_dedup.deduplicate(batches, **options)


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_equals_plain_python(spark, parts):
    docs = _docs(random.Random(parts), 400)
    got = _got(spark, docs, parts)
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got.collect()), key=repr)
    assert rows == _expected(docs)


@pytest.mark.parametrize("broadcast", [0, 1 << 18])
def test_texts_of_one_digest_are_told_apart(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST", broadcast)
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 4)
    docs = _docs(random.Random(9), 300)
    got = _got(spark, docs, 2, digest=lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2)))
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()), key=repr)
    assert rows == sorted((x[:4] for x in _expected(docs)), key=repr)


def test_many_copies_of_one_text(spark):
    docs = [(i, "the same" if i % 2 else f"own {i}") for i in range(6000)]
    got = _got(spark, docs, 2).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] % 2} == {(5999, 3000)}
    assert sum(r["kept"] for r in got) == 3001


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.deduplicate([empty]).isEmpty()
    assert exact_dedup.deduplicate([empty, empty]).isEmpty()
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for order in ([one, empty], [empty, one]):
        assert [tuple(r)[2:] for r in exact_dedup.deduplicate(order).collect()] == [(1, 1, True)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 2048, 60_000])
def test_filters_hold_all_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    f = FuseFilter.of(keys)
    assert f.may_hold(keys).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 20_000, dtype=np.uint64), keys)
    assert f.may_hold(others).mean() < 0.01
    assert n < 2048 or len(f.slots) < 1.5 * n


def test_snapshots_screen_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 16)
    index = spark.range(200).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"), F.lit("").alias("odd"), F.lit(1).alias("n"), F.lit(0).alias("last"))
    held = Snapshot.of(index)
    assert held.buckets == 13 and held.filters.count() <= 13
    asked = spark.range(100, 5000).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"))
    passed = {bytes(r["digest"]) for r in exact_dedup.screened(asked, held).collect()}
    assert {hashlib.sha256(str(k).encode()).digest() for k in range(100, 200)} <= passed and len(passed) < 200
