"""Planted passages, exact and with substitutions."""

import random
import re

import duckdb
import numpy as np

from tideline.llm import decontaminate as dc
from tideline.llm.oracles import OP6


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(500)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, fresh(rng.randint(15, 60))) for k in range(30)]
    docs, want = [], set()
    for i in range(150):
        words = fresh(rng.randint(0, 200))
        if i % 3 == 0:
            k, passage = rng.choice(items)
            passage = list(passage)
            for p in range(rng.randrange(6), len(passage), rng.choice((6, 8, 1000))):
                passage[p] = "CHANGED"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in passage]
            want.add((i, k))
        docs.append((i, ", ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(items[3][1][:7])), (None, " ".join(items[4][1])), (5000, "x " * 60_000)]
    want |= {(None, 4)}
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(90, None), (91, "w1"), (92, "w1 w2 w3 w4")], "item_id long, text string")
    rows = dc.contaminated(table, bench, shortest=5).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    # By default the items of one word and of four count like any other.
    more = {(i, 91) for i, text in docs if re.search(r"\bw1\b", text or "", re.I)}
    rows = dc.contaminated(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["item_id"] < 92} == want | more
    assert all(r["n_matched"] >= 0.75 * r["n_aligned"] for r in rows)
    assert dc.contaminated(table.where("false"), bench).count() == 0
    assert dc.contaminated(table, bench.where("false")).count() == 0


def test_columns_whose_names_clash_and_empty_tables(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a b {passage} c", 9, 9, 9, "x"), (2, "else", 9, 9, 9, "x"), (1, passage, 9, 9, 9, "x")], "doc_id long, text string, item_id long, item long, seed long, words string")
    items = spark.createDataFrame([(7, passage, 2, 2, "y", 3), (8, None, 1, 1, "y", 3)], "item_id long, text string, doc_id long, doc long, seeds string, shifts long")
    rows = dc.contaminated(docs, items)
    assert sorted((r["doc_id"], r["item_id"], r["doc_word"], r["n_matched"]) for r in rows.collect()) == [(1, 7, 0, 20), (1, 7, 2, 20)]
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false"))):
        none = dc.contaminated(d, i)
        assert none.columns == rows.columns and none.count() == 0


def fullest_avoiding(masks, longest):
    """For each length, the most equal words of a run that none of the masks hits."""
    reach, best, out = max(map(len, masks)) - 1, {"": 0}, []
    hit = lambda t: any(len(t) >= len(m) and all(c == "1" for c, on in zip(t[-len(m) :], m, strict=True) if on == "1") for m in masks)
    for _ in range(longest):
        longer = {}
        for state, n in best.items():
            for c in "01":
                if not hit(state + c):
                    key = (state + c)[-reach:]
                    longer[key] = max(longer.get(key, 0), n + int(c))
        best = longer
        out.append(max(best.values()))
    return out


def test_no_run_that_counts_avoids_the_masks():
    avoiding = fullest_avoiding(dc.MASKS, 300)
    assert all(avoiding[n - 1] < max(dc.LEAST_WORDS, dc.SHARE * n) for n in range(dc.SHORT, 301))
    assert all(avoiding[n - 1] < dc.LEAST_WORDS for n in range(dc.LEAST_WORDS, dc.SHORT))  # so long a run of a long item
    avoiding = fullest_avoiding(dc.MASKS + dc.SHORT_MASKS, dc.SHORT)
    for size in range(5, dc.SHORT):
        needed = min(dc.LEAST_WORDS, int(np.ceil(dc.SHARE * size)))
        assert all(avoiding[n - 1] < max(needed, dc.SHARE * n) for n in range(needed, size + 1))


def brute(docs, items, shortest=dc.SHORTEST):
    """Every alignment of every document and item."""
    out = {}
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    for i, text in docs:
        words = split(text)
        for k, item in items:
            other = split(item)
            if len(other) < shortest:
                continue
            needed = min(12, np.ceil(0.75 * len(other)))
            for shift in range(-len(other) + 1, len(words)):
                first, last = max(0, -shift), min(len(other), len(words) - shift)
                start, end, matched = dc.accepted_run(np.array([words[p + shift] == other[p] for p in range(first, last)], dtype=bool), needed, 0.75)
                if matched is not None:
                    one = (-matched, first + start + shift, first + start, end - start)
                    out[i, k] = min(out.get((i, k), one), one)
    return out


def test_equals_every_alignment(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(40)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, fresh(n)) for k, n in enumerate([*range(1, 16), 20, 33, 5, 8, 12])] + [(90, ["x"] * 9)]
    docs = []
    for i in range(80):
        words = fresh(rng.randint(0, 60))
        passage = [w if rng.random() < 0.82 else "other" for w in rng.choice(items)[1]]
        at = rng.randint(0, len(words))
        words[at:at] = passage
        docs.append((i, " ".join(words)))
    docs += [(500, "x " * 300), (501, "x y " * 100)]
    items = [(k, " ".join(w)) for k, w in items]
    table, bench = spark.createDataFrame(docs + docs[:2], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shortest in (5, 1):
        want = brute(docs, items, shortest)
        rows = dc.contaminated(table, bench, shortest=shortest).collect()
        got = {(r["doc_id"], r["item_id"]): (-r["n_matched"], r["doc_word"], r["item_word"], r["n_aligned"]) for r in rows}
        assert len(want) > 40 and got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert got == want and len(rows) == len(want) + sum(i in (docs[0][0], docs[1][0]) for i, _ in want)
        if shortest == dc.SHORTEST:
            duck = duckdb.connect()
            for name, columns, held in (("documents", "doc_id BIGINT, text VARCHAR", docs + docs[:2]), ("benchmark", "item_id BIGINT, text VARCHAR", items)):
                duck.execute(f"CREATE TABLE {name} ({columns})")
                duck.executemany(f"INSERT INTO {name} VALUES (?, ?)", held)
            assert sorted(duck.sql(OP6).fetchall()) == sorted(map(tuple, rows))


def test_repetitive_documents(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 30_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "ab cd " * 10), (2, "cd ab " * 12)], "item_id long, text string")
    rows = {r["item_id"]: (r["doc_word"], r["n_matched"]) for r in dc.contaminated(docs, bench).collect()}
    assert rows == {1: (0, 20), 2: (1, 24)}


def test_best_run_against_all_runs():
    rng = np.random.default_rng(4)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 25)) < 0.6
        score = lambda a, b: int(np.where(equal[a:b], 1, -2).sum())  # noqa: B023, E731
        start, end, matched = dc.best_run(equal)
        assert score(start, end) == max(score(a, b) for a in range(len(equal) + 1) for b in range(a, len(equal) + 1))
        assert matched == equal[start:end].sum()


def test_seeds_hash_only_selected_words():
    words = np.arange(40, dtype=np.uint64)
    counts = np.array([15, 25])
    for k, (at, seed) in enumerate(dc.seeds(words, counts)):
        mask = dc.MASKS[k]
        assert all(p + len(mask) <= 15 or p >= 15 for p in at.tolist()) and len(at) == 40 - 2 * (len(mask) - 1)
        changed = words.copy()
        changed[[j for j in range(len(mask)) if mask[j] == "0"]] = 999
        assert list(dc.seeds(changed, counts))[k][1][0] == seed[0]


def test_an_alignment_counts_if_any_run_meets_both_limits():
    rng, more = np.random.default_rng(9), 0
    for _ in range(3000):
        equal = rng.random(rng.integers(1, 60)) < rng.uniform(0.5, 0.95)
        equal[rng.integers(0, min(4, len(equal)))] = equal[-rng.integers(1, min(4, len(equal)) + 1)] = False
        needed = min(12, int(np.ceil(0.75 * len(equal))))
        seen = np.concatenate(([0], np.cumsum(equal)))
        runs = [int(seen[b] - seen[a]) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if seen[b] - seen[a] >= 0.75 * (b - a)]
        start, end, matched = dc.accepted_run(equal, needed, 0.75)
        assert (matched is not None) == (max(runs, default=0) >= needed)
        assert dc.fullest_run(equal, 0.75)[2] == max(runs, default=0)
        if matched is not None:
            assert matched == equal[start:end].sum() >= needed and matched >= 0.75 * (end - start)
            a, b, best = dc.best_run(equal)
            more += best < needed or best < 0.75 * (b - a)
    assert more > 100


def test_copies_with_words_substituted_near_the_ends_are_found(spark):
    item = [f"v{k}" for k in range(14)]
    long = [f"u{k}" for k in range(60)]
    near = [w if k not in (2, 11) else "CHANGED" for k, w in enumerate(item)]
    # 8 equal words of each 11: the best run, 43 of 58, has less than SHARE, one inside it has 36 of 48.
    worn = [w if k * 7 % 11 < 8 else "CHANGED" for k, w in enumerate(long)]
    docs = spark.createDataFrame([(1, " ".join(["x", *near, "y"])), (2, " ".join(worn)), (3, " ".join(["CHANGED" if k % 2 else w for k, w in enumerate(long)]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): (r["doc_word"], r["item_word"], r["n_aligned"], r["n_matched"]) for r in dc.contaminated(docs, bench).collect()}
    assert rows.keys() == {(1, 1), (2, 2)}
    assert rows[1, 1] == (1, 0, 14, 12)
    assert rows[2, 2][3] >= 12 and rows[2, 2][3] >= 0.75 * rows[2, 2][2]
