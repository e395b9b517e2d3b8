"""Exact substring deduplication by column-wise construction over many texts at once.

A byte goes if a WINDOW-byte string that covers it also starts in a document of smaller id. Which windows are equal is
read off sorted suffixes and their common prefixes, built column by column: each round inserts one more symbol in front
of every string's suffix; the symbols in the order of the suffixes are that column of the collection's Burrows-Wheeler
transform, its stable counting sort gives the order of the longer suffixes, and the common prefix of two neighbours is
one more than the least one between their places before.

A collection of whole documents would take as many rounds as the longest has bytes, so its strings are runs: the
windows around one anchor, the place of the smallest hashed GRAM-byte substring (the leftmost of equal ones). Equal
windows have equal anchors in equal places, so strings are laid with their anchors in one column, equal windows begin
in equal columns, suffixes of different columns need no common order, and a string has at most COLUMNS symbols.

1. Documents are packed into blocks of about BLOCK bytes. Each block names the distinct anchors of its windows; those
   that only one document has are dropped.
2. Each block lists its distinct strings around the others, by columns. An anchor with more than HOT different strings
   is split: each of its windows is a string of its own, which goes where the hash of the whole window says.
3. The rounds run in three jobs over thirds of the columns. A job reads its columns and the order and common prefixes
   that the job before wrote, both from files in the shared folder, in sequence, and writes the next ones.
4. Each block learns which windows an earlier document has, and drops the bytes under them.

Hashes only say where strings meet; bytes decide. Blocks and buckets follow from the number of bytes, so no group grows
with the input, nor with the frequency of an anchor: a window of a hot anchor has one row for each block that holds it.

Edge cases: null text counts as empty; texts shorter than WINDOW bytes keep all; rows of equal id never remove bytes of
each other; a null id counts as smaller than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import NO_ID, discard, materialise
from tideline.llm.hashing import U, inverse_powers, mix, prefix_hashes, substring, utf8

WINDOW, GRAM = 50, 26
#: Grams in a window, and so the most windows of one run; columns to the left of an anchor; columns in all.
REACH = WINDOW - GRAM + 1
LEFT = REACH - 1
COLUMNS = LEFT + WINDOW
#: Columns [from, to) of the jobs, in their order; windows begin in those of the last.
JOBS = ((50, COLUMNS), (REACH, 50), (0, REACH))
#: Bytes of a block and of a bucket's share of the texts, strings of an anchor beyond which it is split, strings that a
#: block lists at a time.
BLOCK, SHARE, HOT, LOT = 8 << 20, 16 << 20, 2048, 1 << 19
#: As far as a block counts an anchor's strings: beyond any limit that they are held against.
MOST = 65_535
#: Buckets for the windows of split anchors, for each one of others: at worst there is such a window at every byte.
FINE = 8
#: Bytes of an anchor's hash that blocks exchange; bytes of text hashed side by side, and bits that hold a place in them.
SHORT, PIECE, PLACE = 5, 1 << 18, 20


def _zip(values: np.ndarray | bytes) -> bytes:
    """Size and compressed bytes; wide numbers byte plane by byte plane, which compresses sorted and small ones."""
    raw = values
    if isinstance(values, np.ndarray):
        raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes, kind: type | None = None) -> np.ndarray | bytes:
    out = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    if kind is None:
        return out
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(out, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for about BLOCK bytes of texts."""
    ids: list[int] = []
    raws: list[bytes] = []
    size = 0

    def row() -> pd.DataFrame:
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        return pd.DataFrame({"n_bytes": [size], "ids": [_zip(np.array(ids, dtype=np.int64))], "sizes": [_zip(sizes)], "texts": [_zip(b"".join(raws))]})

    for b in batches:
        for i, r in zip(b["id"].tolist(), utf8(b["text"]), strict=True):
            if raws and size + len(r) > BLOCK:
                yield row()
                ids, raws, size = [], [], 0
            ids.append(i)
            raws.append(r)
            size += len(r)
    if raws:
        yield row()


def _texts(row: pd.Series) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block."""
    ends = np.cumsum(_unzip(row["sizes"], np.int64)).tolist()
    whole = _unzip(row["texts"])
    return _unzip(row["ids"], np.int64), [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Runs:
    """Windows of a piece of text by their anchors; arrays with a value for each run."""

    def __init__(self, part: list[tuple[int, int, bytes]]) -> None:
        self.data = np.frombuffer(b"".join(p for _, _, p in part), dtype=np.uint8)
        self.sums = prefix_hashes(self.data)
        n = len(self.sums) - GRAM
        grams = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * inverse_powers(len(self.sums))[:n])
        # The smallest gram of each window: its hash above, its place below, so that the leftmost of equal ones is taken.
        low, span = ((grams >> U(PLACE)) << U(PLACE)) | np.arange(n, dtype=np.uint64), 1
        while span * 2 <= REACH:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = REACH - span
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        sizes = np.array([len(p) for _, _, p in part], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        ends = begins + sizes - WINDOW + 1
        cut = np.ones(len(low), dtype=bool)
        cut[1:] = low[1:] != low[:-1]
        cut[begins] = True
        cut[ends[ends < len(low)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(low)))
        which = np.searchsorted(begins, start, side="right") - 1
        inside = start < ends[which]
        self.start, self.size, which = start[inside], size[inside], which[inside]
        anchor = (low[self.start] & U((1 << PLACE) - 1)).astype(np.int64)
        self.lead, self.anchor = anchor - self.start, grams[anchor]
        #: Text, and the run's first byte in it.
        self.text = np.array([d for d, _, _ in part], dtype=np.int64)[which]
        self.at = self.start - begins[which] + np.array([o for _, o, _ in part], dtype=np.int64)[which]

    def take(self, keep: np.ndarray) -> Runs:
        for name in ("start", "size", "lead", "anchor", "text", "at"):
            setattr(self, name, getattr(self, name)[keep])
        return self

    def split(self, hot: np.ndarray) -> np.ndarray:
        """Makes each window of the runs marked a run of its own, and tells which these are."""
        parts = np.where(hot, self.size, 1)
        which = np.repeat(np.arange(len(parts)), parts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        split = hot[which]
        self.take(which)
        self.start, self.at, self.lead = self.start + step, self.at + step, self.lead - step
        self.size = np.where(split, 1, self.size)
        return split

    def hashes(self) -> np.ndarray:
        return substring(self.sums, self.start, self.start + self.size + WINDOW - 1)

    def strings(self) -> np.ndarray:
        """A row of COLUMNS symbols for each run, its anchor in column LEFT, zeros outside of it."""
        room = np.zeros(COLUMNS, dtype=np.uint8)
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([room[:LEFT], self.data, room]), COLUMNS)
        column, first = np.arange(COLUMNS), (LEFT - self.lead)[:, None]
        return np.where((column >= first) & (column < first + self.size[:, None] + WINDOW - 1), wide[self.start + self.lead], 0)


def runs(raws: list[bytes]) -> Iterator[Runs]:
    """The runs of the texts' windows. Long texts are taken in parts that share WINDOW - 1 bytes."""
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for d, r in enumerate(raws):
        for at in range(0, max(len(r) - WINDOW + 1, 0), PIECE):
            piece = r[at : at + PIECE + WINDOW - 1]
            if part and size + len(piece) > PIECE:
                yield Runs(part)
                part, size = [], 0
            part.append((d, at, piece))
            size += len(piece)
    if part:
        yield Runs(part)


def _code(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an anchor and the bytes of its hash that are exchanged, in one number."""
    bucket = (anchor >> U(8 * SHORT)) % U(buckets)
    return (bucket << U(8 * SHORT)) | (anchor & U((1 << 8 * SHORT) - 1))


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // SHORT, 8), dtype=np.uint8)
    wide[:, :SHORT] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, SHORT)
    return wide.view(np.uint64).ravel()


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where the groups of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1], [True])))


_NAMED = "bucket long, block long, codes binary, strings binary, twice binary"


def _named(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """By bucket, each block's distinct anchors, how many strings each has (up to MOST) and whether two documents have it."""
    for b in batches:
        for _, row in b.iterrows():
            ids, raws = _texts(row)
            found = [(_code(r.anchor, buckets), r.hashes(), ids[r.text]) for r in runs(raws)]
            if not found:
                continue
            code, string, own = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((string, code))
            code, string, own = code[order], string[order], own[order]
            begin = _groups(code)[:-1]
            fresh = np.append(True, (string[1:] != string[:-1]) | (code[1:] != code[:-1])).astype(np.int64)
            count = np.minimum(np.add.reduceat(fresh, begin), MOST).astype(np.uint16)
            twice = np.minimum.reduceat(own, begin) < np.maximum.reduceat(own, begin)
            code = code[begin]
            edges = _groups(code >> U(8 * SHORT)).tolist()
            rows = [(int(code[lo] >> U(8 * SHORT)), row["block"], _pack(code[lo:hi]), count[lo:hi].tobytes(), np.packbits(twice[lo:hi]).tobytes()) for lo, hi in zip(edges, edges[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["bucket", "block", "codes", "strings", "twice"])


_SHARED = "block long, bucket long, codes binary, hot binary"


def _shared(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """For each block, its anchors of the bucket that more than one document has, and which of them have many strings."""
    codes = [_unpack(c) for c in group["codes"]]
    sizes = np.array([len(c) for c in codes])
    count = np.concatenate([np.frombuffer(s, dtype=np.uint16) for s in group["strings"]]).astype(np.int64)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=n) for t, n in zip(group["twice"], sizes.tolist(), strict=True)])
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    edges = _groups(code[order])
    begin, blocks = edges[:-1], np.diff(edges)
    several = (blocks > 1) | (np.maximum.reduceat(twice[order], begin) > 0)
    many = np.add.reduceat(count[order], begin) > most
    told = np.empty((2, len(code)), dtype=bool)
    told[:, order] = np.repeat(np.stack([several, many]), blocks, axis=1)
    out, ends = [], np.cumsum(sizes)
    for block, bucket, lo, hi in zip(group["block"].tolist(), group["bucket"].tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        own = lo + np.flatnonzero(told[0, lo:hi])
        if len(own):
            out.append((block, bucket, _pack(code[own]), np.packbits(told[1, own]).tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "codes", "hot"])


_LISTED = "part int, block long, lot int, bucket long, leads binary, sizes binary, symbols binary, firsts binary"
_COLUMNS = [c.split()[0] for c in _LISTED.split(", ")]
#: Parts of _LISTED besides those of JOBS: where strings stand, what an earlier document has, order and common prefixes.
PLACES, MARKS, STATE = len(JOBS), len(JOBS) + 1, len(JOBS) + 2


def _lot(found: list[tuple], ids: np.ndarray, block: int, lot: int) -> list[tuple]:
    """Distinct strings by bucket and part of the columns, and where they stand."""
    text, at, size, lead, string, bucket, rows = (np.concatenate([f[k] for f in found]) for k in range(7))
    own = ids[text]
    order = np.lexsort((own, string))
    again = np.zeros(len(order), dtype=bool)
    twin = np.flatnonzero(string[order][1:] == string[order][:-1]) + 1
    x, y = order[twin], order[twin - 1]
    again[twin] = (rows[x] == rows[y]).all(axis=1) & (lead[x] == lead[y]) & (size[x] == size[y]) & (bucket[x] == bucket[y])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(~again) - 1
    distinct = order[~again]
    moved = np.argsort(bucket[distinct], kind="stable")
    place = np.empty(len(moved), dtype=np.int64)
    place[moved] = np.arange(len(moved))
    later = own > own[distinct][which]
    distinct, which = distinct[moved], place[which]
    edges = _groups(bucket[distinct]).tolist()
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        d = distinct[lo:hi]
        leads, sizes = _zip(lead[d].astype(np.uint8)), _zip(size[d].astype(np.uint8))
        for part, (a, b) in enumerate(JOBS):
            firsts = _zip(own[d]) if part == len(JOBS) - 1 else None
            out.append((part, block, lot, int(bucket[d[0]]), leads, sizes, _zip(np.ascontiguousarray(rows[d, a:b]).tobytes()), firsts))
    begin = np.array(edges[:-1])
    places = _zip(np.concatenate([text, at, which, size, later.astype(np.int64)]).astype(np.int32))
    out.append((PLACES, block, lot, 0, _zip(bucket[distinct[begin]].astype(np.int64)), _zip(np.diff(edges).astype(np.int64)), places, None))
    return out


def _listed(block: pd.DataFrame, shared: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The strings of a block around shared anchors, in lots of about LOT strings."""
    rows: list[tuple] = []
    if len(block) and len(shared):
        known = np.concatenate([(np.uint64(b) << U(8 * SHORT)) | _unpack(c) for b, c in zip(shared["bucket"], shared["codes"], strict=True)])
        hot = np.concatenate([np.unpackbits(np.frombuffer(h, dtype=np.uint8), count=len(c) // SHORT) for h, c in zip(shared["hot"], shared["codes"], strict=True)]).astype(bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        number, found, held, lot = int(block["block"].iloc[0]), [], 0, 0
        ids, raws = _texts(block.iloc[0])
        for r in runs(raws):
            code = _code(r.anchor, buckets)
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = np.flatnonzero(known[at] == code)
            if not len(hit):
                continue
            split = r.take(hit).split(hot[at[hit]])
            string = r.hashes()
            bucket = np.where(split, U(buckets) + string % U(FINE * buckets), _code(r.anchor, buckets) >> U(8 * SHORT)).astype(np.int64)
            found.append((r.text, r.at, r.size, r.lead, string, bucket, r.strings()))
            held += len(string)
            if held > LOT:
                rows += _lot(found, ids, number, lot)
                found, held, lot = [], 0, lot + 1
        if found:
            rows += _lot(found, ids, number, lot)
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value of each range [lo, hi), none of which is empty."""
    out = np.empty(len(lo), dtype=values.dtype)
    power = np.frexp(hi - lo)[1] - 1
    order = np.argsort(power.astype(np.uint8), kind="stable")
    edges = np.searchsorted(power[order], np.arange(int(power.max(initial=-1)) + 2)).tolist()
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        own, width = order[a:b], 1 << k
        out[own] = np.minimum(values[lo[own]], values[hi[own] - width])
        values = np.minimum(values[:-width], values[width:]) if len(values) > width else values
    return out


def insert(order: np.ndarray, common: np.ndarray, fresh: np.ndarray, symbols: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the order of the suffixes after each string that ``has`` one got a symbol in front, and the symbols
    that each has in common with the one before it.

    fresh are the strings whose last symbol it is; their empty suffixes come first and have nothing in common.
    """
    if len(fresh):
        common = np.concatenate([np.zeros(len(fresh), dtype=np.uint8), common])
        common[len(fresh) : len(fresh) + 1] = 0
        order = np.concatenate([fresh.astype(order.dtype), order])
    place = np.flatnonzero(has[order])
    # The symbols in the order of the suffixes: a column of the collection's Burrows-Wheeler transform.
    transform = symbols[order[place]]
    turn = np.argsort(transform, kind="stable")
    place, transform = place[turn], transform[turn]
    after = np.zeros(len(place), dtype=np.uint8)
    same = np.flatnonzero(transform[1:] == transform[:-1]) + 1
    after[same] = 1 + least(common, place[same - 1] + 1, place[same] + 1)
    return order[place], after


def _round(group: pd.DataFrame, job: int) -> pd.DataFrame:
    """The columns of a job inserted into a bucket's strings: the state for the next, or after the last one a mark for
    each string: a bit for each of its windows that a smaller document has."""
    state = group[group["part"] == STATE]
    own = group[group["part"] == job].sort_values(["block", "lot"], kind="stable")
    lead, size = (np.concatenate([_unzip(x, np.uint8) for x in own[c]]).astype(np.int16) for c in ("leads", "sizes"))
    a, b = JOBS[job]
    symbols = np.ascontiguousarray(np.frombuffer(b"".join(_unzip(x) for x in own["symbols"]), dtype=np.uint8).reshape(-1, b - a).T)
    begin = LEFT - lead
    end = begin + size + WINDOW - 1
    order, common = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint8)
    if len(state):
        order, common = _unzip(state["symbols"].iloc[0], np.int32), _unzip(state["firsts"].iloc[0], np.uint8)
    last = job == len(JOBS) - 1
    first = np.concatenate([_unzip(x, np.int64) for x in own["firsts"]]) if last else None
    marks = np.zeros(len(lead), dtype=np.uint32)
    for k in range(b - 1, a - 1, -1):
        order, common = insert(order, common, np.flatnonzero(end == k + 1), symbols[k - a], (begin <= k) & (k < end))
        if last and len(order):
            edges = np.flatnonzero(np.append(True, common[1:] < WINDOW))
            sizes = np.diff(np.append(edges, len(order)))
            several = np.repeat(sizes > 1, sizes)
            if several.any():
                mine, theirs = first[order], np.repeat(np.minimum.reduceat(first[order], edges), sizes)
                gone = order[theirs < mine]
                marks[gone] |= np.uint32(1) << (k - begin[gone]).astype(np.uint32)
    if not last:
        return pd.DataFrame([(STATE, 0, 0, own["bucket"].iloc[0], None, None, _zip(order), _zip(common))], columns=_COLUMNS, dtype=object)
    rows, at = [], 0
    for block, lot, bucket, n in zip(own["block"], own["lot"], own["bucket"], (int.from_bytes(x[:8], "little") for x in own["leads"]), strict=True):
        if marks[at : at + n].any():
            rows.append((MARKS, block, lot, bucket, None, None, _zip(marks[at : at + n]), None))
        at += n
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def _inserting(job: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: _round(group, job)


def _removed(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block without the bytes that smaller documents have."""
    columns = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    if not len(block):
        return pd.DataFrame([], columns=columns)
    ids, raws = _texts(block.iloc[0])
    begins = np.cumsum([0, *map(len, raws)])
    starts = np.zeros(int(begins[-1]) + 1, dtype=np.int32)
    marks = {(x["lot"], x["bucket"]): _unzip(x["symbols"], np.uint32) for _, x in told[told["part"] == MARKS].iterrows()}
    for _, x in told[told["part"] == PLACES].iterrows():
        buckets, counts = (_unzip(x[c], np.int64).tolist() for c in ("leads", "sizes"))
        bits = np.concatenate([marks.get((x["lot"], b), np.zeros(n, dtype=np.uint32)) for b, n in zip(buckets, counts, strict=True)])
        text, at, which, size, later = _unzip(x["symbols"], np.int32).reshape(5, -1)
        # A document that is not the first of the block with this string loses all of its windows.
        own = np.where(later > 0, (np.uint32(1) << size.astype(np.uint32)) - np.uint32(1), bits[which])
        at, own = (begins[text] + at)[own > 0], own[own > 0]
        for k in range(REACH):
            starts[at[(own >> np.uint32(k)) & np.uint32(1) > 0] + k] = 1
    seen = np.cumsum(starts)
    seen[WINDOW:] -= seen[:-WINDOW].copy()
    covered = seen > 0
    rows = []
    for i, raw, lo, hi in zip(ids.tolist(), raws, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        gone = covered[lo:hi]
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() if gone.any() else raw
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rows.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(rows, columns=columns)


def remove_repeats(docs: DataFrame, with_text: bool = False, most: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; with_text adds kept, the remaining bytes."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = texts.mapInPandas(_blocks, "n_bytes long, ids binary, sizes binary, texts binary").withColumn("block", F.monotonically_increasing_id())
    blocks = materialise(blocks)
    n_blocks, n_bytes = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    least_parts = 2 * docs.sparkSession.sparkContext.defaultParallelism
    buckets, tasks = max(least_parts, -(-n_bytes // SHARE)), max(least_parts, -(-n_blocks // 2))
    by_bucket, by_block = (lambda df, n=n, key=key: df.repartition(n, key).groupBy(key) for n, key in ((buckets, "bucket"), (tasks, "block")))
    named = blocks.select("block", "ids", "sizes", "texts").mapInPandas(lambda b: _named(b, buckets), _NAMED)
    shared = materialise(by_bucket(named).applyInPandas(lambda g: _shared(g, most), _SHARED))
    packed = blocks.select("block", "ids", "sizes", "texts")
    listed = materialise(by_block(packed).cogroup(by_block(shared)).applyInPandas(lambda b, s: _listed(b, s, buckets), _LISTED), by="part")
    discard(shared)
    state = None
    for job in range(len(JOBS)):
        rows = listed.where(F.col("part") == job)
        before, state = state, rows if state is None else rows.unionByName(state)
        state = materialise(by_bucket(state).applyInPandas(_inserting(job), _LISTED))
        if before is not None:
            discard(before)
    told = listed.where(F.col("part") == PLACES).unionByName(state)
    done = by_block(packed).cogroup(by_block(told)).applyInPandas(_removed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.when(F.col("id") != F.lit(NO_ID), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
