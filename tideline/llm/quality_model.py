"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from a document's whole text. The trees are fitted with numpy on the driver from at most
``sample`` labelled rows (a documented bound: the rows of smallest hash, so that the choice does not depend on order or
partitions) and flattened into arrays of complete binary trees, which executors walk a batch and a level at a time.

Edge cases: null text counts as empty and is scored like any other; labels that are null are not learnt from; repeated
rows are each scored; without any labelled row every score is 0.5; an empty table gives an empty result; a column named
like a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
#: Trees, their depth, shrinkage, histogram bins, ridge on leaves, least weight of a leaf.
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 80, 4, 0.15, 64, 1.0, 1.0
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "lower", "digit", "space", "newline", "stop", "exclaim", "symbol",
    "wide", "entropy", "distinct_words", "distinct_lines", "log_lines", "top_byte", "words_a_line", "symbol_words", "upper_words",
)


def _classes() -> np.ndarray:
    """Class of each byte."""
    of = np.zeros(256, dtype=np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?", b"#*$%&|<>@^~_=+/\\{}[]`"), start=1):
        of[list(chars)] = k
    of[128:] = 9
    return of


_CLASS = _classes()
_SYMBOLS = tuple("#*$%&|<>!")


def statistics(texts: pd.Series) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)), dtype=np.float32)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            continue
        seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        share = np.bincount(_CLASS, weights=seen, minlength=10) / len(raw)
        p = seen[seen > 0] / len(raw)
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        n, m = max(len(words), 1), max(len(lines), 1)
        marked = sum(w.endswith(_SYMBOLS) for w in words)
        loud = sum(map(str.isupper, words))
        out[i] = (
            np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8],
            share[9], -(p * np.log2(p)).sum(), len(set(words)) / n, len(set(lines)) / m, np.log1p(len(lines)), p.max(), n / m, marked / n, loud / n,
        )
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node i has children 2i + 1 and 2i + 2; a row goes right if its value is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.prior + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss over binned statistics."""
    inner, leaves, features = 2**DEPTH - 1, 2**DEPTH, x.shape[1]
    none = Trees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner), dtype=np.float32), np.zeros((0, leaves)), 0.0)
    if not len(y):
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), prior)
    feature, threshold, value = np.zeros((TREES, inner), dtype=np.int64), np.full((TREES, inner), np.inf, dtype=np.float32), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            cell = (node - first) * BINS
            gain = np.zeros((features, nodes, BINS))
            for f in range(features):
                g = np.bincount(cell + binned[:, f], weights=grad, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                h = np.bincount(cell + binned[:, f], weights=hess, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                ga, ha = g[:, -1:], h[:, -1:]
                split = g**2 / (h + RIDGE) + (ga - g) ** 2 / (ha - h + RIDGE) - ga**2 / (ha + RIDGE)
                gain[f] = np.where((h >= LEAST) & (ha - h >= LEAST), split, 0)
                gain[f, :, len(edges[f]) :] = 0
            flat = gain.transpose(1, 0, 2).reshape(nodes, -1)
            best = flat.argmax(axis=1)
            for k in np.flatnonzero(flat[np.arange(nodes), best] > 1e-9):
                f, b = divmod(int(best[k]), BINS)
                feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, weights=grad, minlength=leaves), np.bincount(leaf, weights=hess, minlength=leaves)
        value[t] = -RATE * g / (h + RIDGE)
        margin += value[t, leaf]
    return Trees(feature, threshold, value, prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` documents of at most ``sample`` labelled rows outside the held-out fold."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")

    @F.pandas_udf("array<float>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(texts)))

    # Ids may repeat in both tables; the bound holds for what is learnt from, and the choice does not depend on order.
    taken = joined.select("doc_id", "label", stats("text").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(sample)
    found = taken.toPandas().sort_values(["doc_id", "label"], kind="stable")
    x = np.array(found["x"].tolist(), dtype=np.float32).reshape(len(found), len(STATISTICS))
    return fit(x, found["label"].to_numpy(dtype=np.float64))


def with_scores(docs: DataFrame, trees: Trees, least: float = 0.3) -> DataFrame:
    """The documents with score and predicted (1 if the score reaches ``least``)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(statistics(texts)))

    docs = docs.drop("score", "predicted").withColumn("score", scored("text"))
    return docs.withColumn("predicted", (F.col("score") >= least).cast("int"))
