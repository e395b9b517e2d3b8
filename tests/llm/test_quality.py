"""Quality model on held-out labels, quality rules against plain counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from tideline.llm import quality_model as qm
from tideline.llm import quality_rules as qr

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = qm.with_scores(docs, qm.train(docs, labels)).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality", qm.held_out(docs["doc_id"]).alias("held_out"))
    rows = scored.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_flat_trees_equal_walking_each_row():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    trees = qm.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:20], trees.score(x[:20]), strict=True):
        total = trees.prior
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_model_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x " * 9, 0.5), (2, "", 0.5), (3, "word " * 50_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = qm.with_scores(docs, qm.train(docs, none)).collect()
    assert len(rows) == 5 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert qm.with_scores(docs.where("false"), qm.fit(np.zeros((0, 20)), np.zeros(0))).count() == 0
    assert qm.statistics(pd.Series([None, "", "a"])).shape == (3, len(qm.STATISTICS))


def _plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        covered |= {i, i + 1, i + 2} if counts[w] > 1 else set()
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_plain_counts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "a b " * 20_000, "xx"), (-4, "\n\n \n", "en"), (None, "é# ü\né# ü", "fr"), (-3, "a b " * 20_000, "xx")], docs.schema)
    docs = docs.unionByName(more)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = qr.apply_rules(docs.withColumn("n_words", docs["doc_id"])).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        n, chars, symbols, lines, repeats = _plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.0, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    assert math.isclose(df.select(qr.distance(df["p"], df["q"])).first()[0], math.sqrt((kl(p) + kl(q)) / 2), rel_tol=1e-12)


def test_clean_documents_stay_and_foreign_ones_go(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = qr.apply_rules(docs).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.6


def test_rules_on_an_empty_table(spark):
    assert qr.apply_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_every_language_has_a_reference_of_its_own(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(70):
        words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(20)]
        rows += [(100 * k + i, " ".join(rng.choice(words, 120)), f"l{k}") for i in range(2 if k > 5 else 4)]
    rows += [(-1, " ".join(rng.choice(["some", "words", "of", "none"], 120)), None), (-2, None, "l3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    limits = qr.Limits(max_repeat=100)
    got = {r["doc_id"]: r.asDict() for r in qr.apply_rules(docs, limits).collect()}
    assert len(got) == len(rows) and all(r["kept"] == (i != -2) for i, r in got.items())
    assert got[-1]["word_distance"] < 1e-6 < max(r["word_distance"] or 0 for r in got.values()) < 0.5
    # The same with references joined by label, of which only a few are broadcast.
    monkeypatch.setattr(qr, "BROADCAST", 0)
    monkeypatch.setattr(qr, "HOT", 4)
    assert {r["doc_id"]: r.asDict() for r in qr.apply_rules(docs, limits).collect()} == got


def test_real_trees_on_clashing_and_empty_tables_within_the_bound(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    named = docs.withColumns({"label": docs["doc_id"], "x": docs["lang"], "predicted": docs["lang"], "score": docs["lang"]})
    clashing = labels.withColumns({"text": labels["doc_id"], "label": labels["toxic"]})
    trees = qm.train(named, clashing)
    want, got = (qm.with_scores(d, t).select("doc_id", "score").orderBy("doc_id").limit(50).collect() for d, t in ((docs, qm.train(docs, labels)), (named, trees)))
    assert want == got and 0 < len({r["score"] for r in got})
    assert qm.with_scores(docs.where("false"), trees).count() == 0
    learnt = []
    monkeypatch.setattr(qm, "fit", lambda x, y: learnt.append((x.shape, len(y))))
    qm.train(docs.unionByName(docs).unionByName(docs), labels, sample=50)  # ids repeat
    assert learnt == [((50, len(qm.STATISTICS)), 50)]


def _counted(text):
    """The statistics by counting characters one by one."""
    text = text or ""
    raw = text.encode()
    if not raw:
        return [0.0] * len(qm.STATISTICS)
    kinds = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "space": " \t\r\x0b\x0c", "newline": "\n", "stop": ".,;:'\"()-", "exclaim": "!?", "symbol": "#*$%&|<>@^~_=+/\\{}[]`"}
    told = {k: sum(chr(b) in chars for b in raw) / len(raw) for k, chars in kinds.items()}
    told["wide"] = sum(b >= 128 for b in raw) / len(raw)
    shares = [n / len(raw) for n in Counter(raw).values()]
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = len(words) or 1, len(lines) or 1
    told |= {
        "log_chars": math.log(1 + len(raw)), "log_words": math.log(1 + len(words)), "word_length": len(raw) / n, "entropy": -sum(p * math.log2(p) for p in shares),
        "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / m, "log_lines": math.log(1 + len(lines)), "top_byte": max(shares), "words_a_line": n / m,
        "symbol_words": sum(w[-1] in "#*$%&|<>!" for w in words) / n, "upper_words": sum(w.isupper() for w in words) / n,
    }
    return [told[s] for s in qm.STATISTICS]


def test_statistics_against_counting_each_character():
    import random

    rng = random.Random(5)
    pieces = [*"aZ9 .!?#\n\t-é東$", "WORD ", "word ", "x* ", "\n\n", "the the\n"]
    texts = [None, "", " ", "\n", "a", "A!", "é" * 40, "long " * 30_000] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    got = qm.statistics(pd.Series(texts))
    assert np.allclose(got, [_counted(t) for t in texts], rtol=1e-5, atol=1e-6)


def test_trees_take_the_best_split_of_each_node_and_newton_leaves(monkeypatch):
    """Every split of two small trees against trying all splits, every leaf against its formula."""
    monkeypatch.setattr(qm, "TREES", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    x[:, 2] = rng.integers(0, 4, 400)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 1)).astype(float)
    trees = qm.fit(x, y)
    mean = y.mean()
    assert trees.prior == math.log(mean / (1 - mean))
    margin = np.full(len(y), trees.prior)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, qm.BINS + 1)[1:-1]).astype(np.float32)) for f in range(3)]
    for t in range(2):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        worth = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + qm.RIDGE)
        held = {0: np.ones(len(y), dtype=bool)}
        for node in range(2**qm.DEPTH - 1):
            rows, best = held[node], 0.0
            gain = lambda f, c, rows=rows: worth(rows & (x[:, f] <= c)) + worth(rows & (x[:, f] > c)) - worth(rows)
            for f in range(3):
                for c in cuts[f]:
                    if min(hess[rows & (x[:, f] <= c)].sum(), hess[rows & (x[:, f] > c)].sum()) >= qm.LEAST:
                        best = max(best, gain(f, c))
            f, c = trees.feature[t, node], trees.threshold[t, node]
            if np.isfinite(c):
                assert gain(f, c) == np.float64(best) or abs(gain(f, c) - best) < 1e-9
            else:
                assert best <= 1e-6
            held[2 * node + 1], held[2 * node + 2] = rows & (x[:, f] <= c), rows & (x[:, f] > c)
        for leaf in range(2**qm.DEPTH):
            rows = held[leaf + 2**qm.DEPTH - 1]
            want = -qm.RATE * grad[rows].sum() / (hess[rows].sum() + qm.RIDGE)
            assert abs(trees.value[t, leaf] - want) < 1e-9
            margin = np.where(rows, margin + want, margin)
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-margin)))
