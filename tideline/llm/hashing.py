"""Vectorised hashes of bytes and words, and a filter of fixed size, for tasks that numpy carries out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Odd base of the polynomial hash modulo 2^64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of a word beyond which it is hashed by a digest, and masks that keep the first bytes of a lane of eight.
LONG = 64
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes that part words, as in the word contracts.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A filter's bits, and those of one of its chunks.
FILTER_BITS, CHUNK_BITS = 26, 20
#: Text bytes that are hashed side by side.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    #: A random value for each byte.
    _VALUE = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(_BASE))

_powers = np.zeros(0, dtype=np.uint64)
_inverses = np.zeros(0, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        steps = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        for s in steps:
            s[0] = 1
        _powers, _inverses = np.cumprod(steps[0]), np.cumprod(steps[1])
    return _powers, _inverses


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums S with which substring() hashes any substring of the bytes."""
    powers, _ = _grown(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * powers[: len(data)], out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    return _grown(n)[1]


def substring(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of bytes [start, end)."""
    _, inverses = _grown(len(sums))
    return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))


def blocks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes together; a longer text stands alone."""
    first, size = 0, 0
    for i, r in enumerate(raws):
        if size and size + len(r) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(r)
    if first < len(raws):
        yield first, len(raws)


def hashed_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) of each word.

    Eight bytes at a time go through the mixer, so that words of up to eight bytes and of one length never share a hash,
    and longer ones are no linear function of their letters.
    """
    size = end - start
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)
    out = mix(size.astype(np.uint64) + U(_BASE))
    todo, at = np.arange(len(start)), 0
    while len(todo):
        lane = lanes[start[todo] + at].view(np.uint64).ravel() & _LANE[np.minimum(size[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ lane) * U(_BASE) + U(at + 1))
        at += 8
        todo = todo[size[todo] > at] if at < LONG else todo[:0]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(raws: list[bytes], parts: bytes = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the texts in order, words of each text, and each word's start in the texts joined by a byte."""
    inside = np.ones(256, dtype=bool)
    inside[list(parts)] = False
    inside[10] = False
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", dtype=np.uint8)
    word = inside[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    hashes = hashed_words(data, start, end)
    begins = np.cumsum([1, *(len(r) + 1 for r in raws)])
    counts = np.diff(np.searchsorted(start, begins))
    return hashes, counts, start


def filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit map of 2^FILTER_BITS bits in which two bits are set for each 64-bit value of the column.

    Its size is fixed; more values only let more others pass.
    """

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        for b in batches:
            for place in _places(b[column].to_numpy(dtype=np.int64).view(np.uint64)):
                seen[place] = True
        packed = np.packbits(seen, bitorder="little").reshape(-1, (1 << CHUNK_BITS) // 8)
        used = np.flatnonzero(packed.any(axis=1))
        yield pd.DataFrame({"chunk": used, "bits": [packed[k].tobytes() for k in used]})

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b["chunk"], b["bits"], strict=True):
                x = np.frombuffer(raw, dtype=np.uint8)
                own[k] = own[k] | x if k in own else x
        yield pd.DataFrame({"chunk": list(own), "bits": [x.tobytes() for x in own.values()]})

    kind = "chunk long, bits binary"
    rows = hashes.select(column).mapInPandas(bits, kind).repartition("chunk").mapInPandas(united, kind).collect()
    out = np.zeros(((1 << FILTER_BITS) // (1 << CHUNK_BITS), (1 << CHUNK_BITS) // 8), dtype=np.uint8)
    for r in rows:
        out[r["chunk"]] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mix(values)
    return (x >> U(64 - FILTER_BITS)).astype(np.int64), (x & U((1 << FILTER_BITS) - 1)).astype(np.int64)


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indices of the values that may be in the filter."""
    first, second = _places(values)
    at = np.flatnonzero((bitmap[first >> 3] >> (first & 7).astype(np.uint8)) & 1)
    second = second[at]
    return at[((bitmap[second >> 3] >> (second & 7).astype(np.uint8)) & 1).astype(bool)]


def utf8(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def xxhash_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.xxhash64(column).alias("h"))
