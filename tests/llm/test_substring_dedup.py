"""Substring deduplication against a dictionary of every window."""

import hashlib
import random

import numpy as np
import pandas as pd

from tideline.llm import substring_dedup as sd


def brute(rows):
    first = {}
    for i, b in rows:
        for p in range(len(b) - sd.WINDOW + 1):
            w = b[p : p + sd.WINDOW]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - sd.WINDOW + 1):
            if first[b[p : p + sd.WINDOW]] < i:
                gone[p : p + sd.WINDOW] = b"\1" * sd.WINDOW
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def test_equals_every_window(spark):
    rng = random.Random(4)
    some = lambda n, letters="abcd é\n": "".join(rng.choice(letters) for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 75, 200, 400)] + ["ab" * 150, "a" * 400, "abc" * 60]
    texts = ["".join(rng.choice((some(rng.randint(0, 60)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 20) :])) for _ in range(rng.randint(0, 8))) for _ in range(250)]
    texts += ["", "a" * 49, "a" * 50, "a" * 5000, texts[7], texts[7], "é" * 300, "日" * 100]
    rows = [(i * 7 % 263, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (900, None), (5, texts[3]), (5, texts[3])], "doc_id long, text string")
    want = brute([(i, (t or "").encode()) for i, t in [*rows, (900, None), (5, texts[3]), (5, texts[3])]])
    assert sorted((*r[:5], bytes(r[5])) for r in sd.remove_repeats(docs, with_text=True).collect()) == want
    assert sorted(tuple(r) for r in sd.remove_repeats(docs).collect()) == [w[:5] for w in want]


def test_null_id_is_smallest_and_empty_table(spark):
    text = "0123456789" * 7
    docs = spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(docs).collect()} == {None: 0, 1: 70}
    assert sd.remove_repeats(docs.where("false")).count() == 0


def test_hot_anchors_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 300)
    rng = random.Random(5)
    phrase = "This phrase stands in very many of the documents. "[:rng.randint(35, 48)]
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    tails = [fresh(60) for _ in range(8)]
    rows = [(i, fresh(rng.randint(0, 90)) + phrase + rng.choice([fresh(60), rng.choice(tails)]) + phrase * rng.randint(0, 2)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [w[:5] for w in brute([(i, t.encode()) for i, t in rows])]
    for most in (3, 10_000):
        assert sorted(tuple(r) for r in sd.remove_repeats(docs, most=most).collect()) == want


def test_rounds_sort_suffixes_and_count_common_symbols():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 12), dtype=np.uint8)) for _ in range(300)]
    end = rng.integers(12, 15, 300)  # the column after each string's last symbol
    begin = end - np.array([len(x) for x in strings])
    order, common = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint8)
    for k in range(14, -1, -1):
        has = (begin <= k) & (k < end)
        symbols = np.array([x[k - b] if h else 0 for x, b, h in zip(strings, begin, has, strict=True)], dtype=np.uint8)
        order, common = sd.insert(order, common, np.flatnonzero(end == k + 1), symbols, has)
        suffixes = [strings[i][k - begin[i] :] for i in order]
        assert suffixes == sorted(suffixes) and sorted(order) == np.flatnonzero(has).tolist()
        for a, b, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_least_of_ranges():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 200, 1000, dtype=np.uint8)
    lo = rng.integers(0, 1000, 3000)
    hi = lo + 1 + (rng.random(3000) * (1000 - lo)).astype(int)
    assert sd.least(values, lo, hi).tolist() == [values[a:b].min() for a, b in zip(lo, hi, strict=True)]


def test_strings_of_an_anchor_count_in_full_over_few_blocks():
    """300 strings in each of eight blocks are more than 2048; 2000 in one are not."""
    codes = sd._pack(np.array([3, 9], dtype=np.uint64))
    for blocks, each, hot in ((8, 300, True), (2, 1100, True), (1, 2000, False)):
        rows = pd.DataFrame({"bucket": [1] * blocks, "block": range(blocks), "codes": [codes] * blocks, "strings": [np.array([1, each], dtype=np.uint16).tobytes()] * blocks, "twice": [np.packbits([True, True]).tobytes()] * blocks})
        told = sd._shared(rows, sd.HOT)
        assert len(told) == blocks
        for packed in told["hot"]:
            assert np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=2).tolist() == [0, int(hot)]
