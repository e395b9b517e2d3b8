"""Centroid clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from tideline.llm import centroids
from tideline.llm.centroids import SIZE


def _expected(rows, clusters=16, rounds=3):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else i
    centers = [v for _, v in sorted(((hashlib.sha256(f"1:{name(i)}".encode()).hexdigest(), v) for i, v in vectors))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in vectors]
        for c in range(len(centers)):
            if held := [v for (_, v), k in zip(vectors, own, strict=True) if k == c]:
                centers[c] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    out = [(i, c := nearest(v), far(v, centers[c])) for i, v in vectors]
    return sorted(out, key=repr), centers


def _frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, n int").repartition(5)


def _rounded(v):
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("grid", [None, 2])
def test_equals_plain_python(spark, grid):
    """With a coarse grid many distances are equal."""
    rng = random.Random(4)
    draw = (lambda: rng.gauss(0, 1)) if grid is None else (lambda: rng.randrange(grid) / 64)
    rows = [(i, _rounded(draw() for _ in range(SIZE))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (-5, [0.0] * SIZE), (900, [-0.0] * SIZE)]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [None] + [1.0] * 63), (1005, [float("nan")] + [1.0] * 63), (1006, [1.0] * 63 + [float("-inf")])]
    assigned, found = centroids.cluster(_frame(spark, rows + odd))
    want, centers = _expected(rows + odd)
    assert found.tolist() == centers
    assert sorted(map(tuple, assigned.collect()), key=repr) == want
    told = centroids.described(assigned, found).collect()
    assert {r["inertia"] for r in told} == {sum(d for _, _, d in want)}
    for r in told:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * SIZE) for i in range(n)]
    assigned, found = centroids.cluster(_frame(spark, rows, "double"))
    assert len(found) == n and sorted(r["distance"] for r in assigned.collect()) == [0] * n
    assert centroids.described(assigned, found).count() == n


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(2)
    middle = rng.integers(-2000, 2000, (16, SIZE))
    vectors = middle[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, SIZE))
    cluster, upper, lower = np.zeros(3000, dtype=np.int32), np.full(3000, np.inf, dtype=np.float32), np.zeros((3000, 16), dtype=np.float32)
    before = now = middle[rng.permutation(16)]
    worked = []
    for _ in range(4):
        worked.append(centroids.assign(vectors, cluster, upper, lower, now, before))
        every = np.stack([centroids.squared(vectors, c) for c in now], axis=1)
        assert (cluster == every.argmin(axis=1)).all()
        assert (upper.astype(float) >= np.sqrt(every[np.arange(3000), cluster])).all() and (lower <= np.sqrt(every)).all()
        before, now = now, now + rng.integers(-9, 9, now.shape)
    assert worked[0] < 3000 * 16 * 0.8 and max(worked[1:]) < 3000 * 2


def test_components_out_of_range(spark):
    with pytest.raises(Exception, match="fit a long"):
        centroids.cluster(_frame(spark, [(1, [2.0**40] * SIZE)], "double"))
