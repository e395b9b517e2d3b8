"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tideline.llm import resample
from tideline.llm.resample import BUCKETS


def _features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def _expected(docs, target, percent=25, least=20):
    bucket = lambda f: crc32(f.encode()) % BUCKETS
    s, t = (Counter(bucket(f) for text in texts for f in _features(text)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + BUCKETS) / ((s[b] + 1) * (t_all + BUCKETS))))
    out, able = [], []
    for row, (i, text) in enumerate(docs):
        words, features = _features(text)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(features), weight, score, None])
        if len(words) >= least:
            able.append((-score, i is None, i or 0, row))
    for rank, key in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[key[3]][4] = rank
    return sorted(map(tuple, out), key=repr)


def _docs(rng, n):
    words = ["Alpha", "beta", "ÄRGER", "straße", "x1", "東京", "don't", "a-b", "É", "zeta\x7f", "K"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_equals_plain_python(spark):
    rng = random.Random(3)
    docs = [*_docs(rng, 400), (1000, None), (1001, ""), (1002, "  \n"), (1003, "word " * 50_000), (None, "seven words " * 30), (5, "a repeated id " * 20), (-7, "below zero " * 20), (2**62, "far out " * 20)]
    target = [x for _, x in _docs(rng, 30)] + [None, ""]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank long, weight long")
    got = resample.resample(df.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert [c for c, k in got.dtypes if k == "bigint"] == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    want = _expected(docs, target)
    assert rows == want and sum(r[4] is not None for r in rows) > 50


def test_repeated_rows_are_drawn_each(spark):
    docs = [(i // 4, "the same twenty words " * 10) for i in range(40)]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=35).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 15))
    by_rank = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [x[1:] for x in by_rank] == sorted(x[1:] for x in by_rank)
    assert min(-s for _, s, _ in by_rank) >= max(r["score"] for r in got if not r["rank"])


@pytest.mark.parametrize("docs", [[], [(1, "too short")]])
def test_nothing_to_draw(spark, docs):
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")).collect()
    assert len(got) == len(docs) and all(r["rank"] is None for r in got)


def test_kth_key_over_the_whole_range(spark):
    rng = random.Random(5)
    for values in ([rng.randint(-(2**63), 2**63 - 1) for _ in range(300)], [rng.choice([-(2**63), -1, 0, 2**63 - 1]) for _ in range(300)]):
        rows = [(v, k) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, "v long, k long")
        for k in (1, 150, 300):
            assert resample.kth(df, ["v", "k"], k) == list(sorted(rows)[k - 1])


def test_only_counts_of_digits_are_gathered(spark):
    df = spark.range(0, 300_000, 1, 8).selectExpr("id * 7919 % 300007 AS v", "id")
    assert resample.kth(df, ["v", "id"], 1234) == list(df.orderBy("v", "id").limit(1234).tail(1)[0])
