"""Centroid clustering with Elkan's bounds, exact in integers.

Components are scaled to whole numbers, so that distances and centroids have no rounding. With each vector goes an upper
bound of the distance to its own centroid and a lower bound of the distance to every one. When centroids move, bounds
move by as much; a distance is only worked out where neither the lower bound nor half the distance between the two
centroids rules the other centroid out. Bounds are floats rounded outwards and must rule out strictly, so a centroid
that is as near is always looked at, and among equals the smaller number wins as if all distances were worked out.

A round is one pass over the vectors and their bounds, which are written for the next one together with each task's sums
by cluster; a cluster of any size costs a row a batch. Only the centroids and their sums come to the driver.

Edge cases: vectors that are null, of another length, or with a null or non-finite component are left out; a null id
hashes as empty; of fewer vectors than clusters each is a centroid; rows that repeat an id count each, and share a
first centroid's hash in the order of their components; an empty table gives an empty result; a component of LIMIT or
more, of which distances would not fit a long, is an error; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, materialise

#: Components of a vector, their scale, clusters, rounds of moving centroids, and what the first centroids' hashes start with.
SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Scaled components must be smaller in magnitude.
LIMIT = 1 << 26


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, dtype=np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.asarray(x, dtype=np.float64).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def assign(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> int:
    """Moves each vector to its nearest centroid, and the bounds from the centroids before to those now, all in place.

    Returns how many distances were worked out.
    """
    moved = _up(np.sqrt(squared(centroids, before)))
    lower[:] = _down(lower.astype(np.float64) - moved)
    upper[:] = _up(upper.astype(np.float64) + moved[cluster])
    half = _down(np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)) / 2)
    alone = np.where(np.eye(len(centroids), dtype=bool), np.float32(np.inf), half).min(axis=1)
    # Those nearer to their own centroid than half the way to any other stay where they are.
    todo = np.flatnonzero(upper >= alone[cluster])
    mine, own = vectors[todo], cluster[todo]
    near, worked = squared(mine, centroids[own]), len(todo)
    most = _up(np.sqrt(near))
    lower[todo, own] = _down(np.sqrt(near))
    for c in range(len(centroids)):
        at = np.flatnonzero((own != c) & (most >= lower[todo, c]) & (most >= half[own, c]))
        d = squared(mine[at], centroids[c])
        worked += len(at)
        lower[todo[at], c] = _down(np.sqrt(d))
        better = (d < near[at]) | ((d == near[at]) & (c < own[at]))
        at, d = at[better], d[better]
        own[at], near[at], most[at] = c, d, _up(np.sqrt(d))
    cluster[todo], upper[todo] = own, most
    return worked


_STATE = "vec_id {}, vector array<int>, cluster int, upper float, lower array<float>, n long, sums array<long>"


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel(), type=kind))


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that count."""
    e = F.col("embedding")
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where((F.size(e) == SIZE) & finite).select("vec_id", e.cast("array<double>").alias("embedding"))
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.floor(SCALE * _rows(b.column(1)))
                if np.abs(x).max() >= LIMIT:
                    raise ValueError(f"scaled components of {LIMIT} or more have no distances that fit a long")
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(x.astype(np.int32), pa.int32())], names=["vec_id", "vector"])

    return kept.mapInArrow(run, f"vec_id {kind}, vector array<int>")


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(h.alias("h"), "vector").orderBy("h", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in found], dtype=np.int64).reshape(len(found), SIZE)


def _pass(state: DataFrame, centroids: np.ndarray, before: np.ndarray, final: bool) -> DataFrame:
    """Assigns the vectors of state, which are new if they have no cluster yet. Gives the state with sums by cluster, at the
    end (vec_id, cluster, distance)."""
    kind = state.schema["vec_id"].dataType.simpleString()
    fresh = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            vectors = _rows(b.column("vector")).astype(np.int64)
            cluster = np.zeros(len(b), dtype=np.int32) if fresh else b.column("cluster").to_numpy(zero_copy_only=False).copy()
            upper = np.full(len(b), np.inf, dtype=np.float32) if fresh else b.column("upper").to_numpy(zero_copy_only=False).copy()
            lower = np.zeros((len(b), len(centroids)), dtype=np.float32) if fresh else _rows(b.column("lower")).copy()
            assign(vectors, cluster, upper, lower, centroids, before)
            if final:
                distance = squared(vectors, centroids[cluster])
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])
                continue
            none = lambda kind: pa.nulls(len(b), kind)
            names = ["vec_id", "vector", "cluster", "upper", "lower", "n", "sums"]
            columns = [b.column("vec_id"), b.column("vector"), pa.array(cluster), pa.array(upper), _lists(lower, pa.float32()), none(pa.int64()), none(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            n = np.bincount(cluster, minlength=len(centroids))
            held = np.flatnonzero(n)
            sums = np.zeros((len(centroids), vectors.shape[1]), dtype=np.int64)
            np.add.at(sums, cluster, vectors)
            nothing = [pa.nulls(len(held), c.type) for c in columns]
            yield pa.RecordBatch.from_arrays([*nothing[:2], pa.array(held.astype(np.int32)), *nothing[3:5], pa.array(n[held]), _lists(sums[held], pa.int64())], names=names)

    if final:
        return state.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    return state.mapInArrow(run, _STATE.format(kind))


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the vectors of each cluster; one without vectors stays."""
    sums = state.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(centroids.shape[1]))).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the vectors (vec_id, embedding) that count, and the final centroids, scaled."""
    state = materialise(scaled(vectors))
    kind = state.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(state, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    before = centroids
    held = state
    for _ in range(rounds):
        done = materialise(_pass(state, centroids, before, final=False))
        discard(held)
        before, centroids = centroids, moved(done, centroids)
        state, held = done.where("n is null"), done
    out = materialise(_pass(state, centroids, before, final=True))
    discard(held)
    return out, centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with cluster_inertia, inertia and centroid_sha256: a table of one row a cluster is broadcast."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(k, sums[k], sum(sums.values()), centroid_digest(centroids[k])) for k in sums]
    told = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
