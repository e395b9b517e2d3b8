"""Near duplicates against comparing all pairs."""

import random
import re

import numpy as np

from tideline.llm import near_dup
from tideline.llm.hashing import word_hashes


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, parent = [(i, set_of(t)) for i, t in rows if i is not None], {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for k, (i, a) in enumerate(sets):
        find(i)
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, base = [], fresh(120)
    for i in range(60):  # near copies of one text, many of them at the border of similarity
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [" ".join(fresh(rng.randint(0, 200))) for _ in range(40)]
    rows += ["", " \t\n", "One two", "ONE two", "one  two\n", "É a b c d e", "é a b c d e", "x " * 3000, "x " * 5]
    chain = fresh(100)
    for k in range(12):  # each like the next, the ends unlike
        rows.append(" ".join(chain[3 * k :] + [f"n{j}" for j in range(3 * k)]))
    table = list(enumerate(rows)) + [(200, None), (3, rows[3]), (None, rows[0])]
    rng.shuffle(table)
    return table


def test_components_equal_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bands string")
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    sizes = {i: len(set_of(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_words_on_which_polynomials_modulo_a_power_of_two_agree(spark):
    one = "".join("ab"[b] for b in thue_morse(1024))
    other = "".join("ba"[b] for b in thue_morse(1024))
    got = near_dup.near_duplicates(spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_hashes_of_words():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(n)) for n in [*range(1, 30), 63, 64, 65, 200] for _ in range(300)})
    hashes, counts, _ = word_hashes([b" ".join(words), b"", b" ".join(words)])
    assert counts.tolist() == [len(words), 0, len(words)] and len(set(hashes.tolist())) == len(words)
    assert hashes[: len(words)].tolist() == hashes[len(words) :].tolist() == [word_hashes([w])[0][0] for w in words]


def test_sets_keep_all_bits_of_a_shingle():
    near = np.sort(np.array([1 << 40, (1 << 40) + 1, 5 << 40], dtype=np.uint64))
    assert near_dup.unpacked(near.tobytes()).tolist() == near.tolist() and near_dup._set_key(near) != near_dup._set_key(near[:2])


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_is_that_of_the_definition():
    """Slot by slot, with a whole permutation for each element and no early stop."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 5, 60, 1500)]
    got = near_dup.signatures(sets)
    for s, row in zip(sets, got, strict=True):
        want = np.full(near_dup.SLOTS, np.inf)
        for e in s:
            slots = list(range(near_dup.SLOTS))
            for j in range(near_dup.SLOTS):
                drawn = int(near_dup.mix(np.array([e], dtype=np.uint64) + np.uint64(near_dup._ROUND * (j + 1) % 2**64))[0])
                k = j + ((drawn & 0xFFFFFFFF) * (near_dup.SLOTS - j) >> 32)
                slots[j], slots[k] = slots[k], slots[j]
                want[slots[j]] = min(want[slots[j]], j + (drawn >> 11) * 2.0**-53)
        assert np.array_equal(row, want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    errors = []
    for _ in range(40):
        both, a, b = np.split(rng.permutation(pool)[:400], [300, 350])
        x, y = near_dup.signatures([np.sort(np.concatenate([both, a])), np.sort(np.concatenate([both, b]))])
        errors.append((x == y).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_ids_that_repeat_with_different_texts(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", " ".join(f"b{k}" for k in range(20))
    near_b = b + " and some more"
    for order in ([(1, a), (1, b), (2, near_b)], [(1, b), (1, a), (2, near_b)], [(2, near_b), (1, a), (1, b)]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()}
        assert got == {(1, 8, 1), (1, 16, 1), (2, 19, 1)}


def test_repeated_ids_equal_all_pairs(spark):
    rng = random.Random(21)
    texts = [t for _, t in corpus()]
    rows = [(rng.randrange(90), t) for t in texts]
    want = brute(rows)
    for order in (rows, rows[::-1]):
        got = near_dup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == (want[r["doc_id"]] if r["n_shingles"] else r["doc_id"])
