"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters and digits and bytes beyond ASCII, A-Z lower-cased. Fixed masks lay over every word
position and hash only the selected words, so a substituted word under an ignored place does not matter. Seeds of
documents are joined with seeds of benchmark items; each hit names an alignment (item, shift), and the words aligned
around it are compared: any run of the alignment may hold LEAST_WORDS matches (or SHARE of a shorter item) with SHARE of
its words equal. If the run of best score (a match counting 1, a substitution -2) does, it is the one that is told, else
the run with most matches of those that do.

The masks miss no run that counts: among all patterns of equal and substituted words, none of a run that meets both
limits avoids MASKS if its item has SHORT words or more, and none of a shorter item's avoids MASKS and SHORT_MASKS (the
tests go through all patterns).

A filter of fixed size over the benchmark's seeds drops document seeds that no item can have before anything is
shuffled, however large either side is; joins do the rest, with the benchmark's seeds broadcast while they are at most
BROADCAST, which is counted. Each document and item then meet in one row, with all shifts and the stretch of the document
that these touch. Every item counts, one of a single word too, unless it has fewer than ``shortest`` words.

Edge cases: null or empty text matches nothing; repeated items match each under their own id, repeated documents each;
of several alignments of an item the one with most matches, then the leftmost, stands; empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialise, with_nulls, without_nulls
from tideline.llm.hashing import U, blocks, filter_of, mix, passes, signed, utf8, word_hashes

#: Masks of five selected words (1) and ignored ones (0).
MASKS = ("11111", "111011", "110111", "1101011", "1011101", "11001011")
#: Items of fewer words have further masks, of four selected words.
SHORT, SHORT_MASKS = 14, ("1111", "11011", "10111", "11101", "110011")
LEAST_WORDS, SHARE, SHORTEST = 12, 0.75, 1
BROADCAST = 1 << 18
#: Masks of items of up to four words, if these are not too short to count.
TINY_MASKS = ((), ("1",), ("11",), ("111",), ("111", "1101", "1011"))
_PARTS = bytes(b for b in range(128) if not chr(b).isalnum())
_FACTORS = mix((np.arange(8, dtype=np.uint64) + U(7)) * U(0xD6E8FEB86659FD93)) | U(1)


def seeds(words: np.ndarray, counts: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: positions among all words at which it lies within one text, and the seeds there."""
    last = np.repeat(np.cumsum(counts), counts)
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, int(mask, 2), dtype=np.uint64)
        for j, on in enumerate(x for x, c in enumerate(mask) if c == "1"):
            total += words[on : on + n] * _FACTORS[j]
        at = np.flatnonzero(np.arange(n) + len(mask) <= last[:n])
        yield at, mix(total[at])


def _lowered(texts: pd.Series) -> list[bytes]:
    return [r.lower() for r in utf8(texts)]


def item_seeds(items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, words, seeds: array<struct<seed, at>>) of each benchmark item; words are hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            words, found = [], []
            for raw in _lowered(b["text"]):
                w, counts, _ = word_hashes([raw], _PARTS)
                words.append(signed(w).tolist())
                masks = () if len(w) < shortest else MASKS if len(w) >= SHORT else MASKS + SHORT_MASKS if len(w) > 4 else TINY_MASKS[len(w)]
                found.append([{"seed": s, "at": a} for at, own in seeds(w, counts, masks) for a, s in zip(at.tolist(), signed(own).tolist(), strict=True)])
            yield pd.DataFrame({"item_id": b["item_id"], "words": words, "seeds": found})

    kind = items.schema["item_id"].dataType.simpleString()
    return with_nulls(without_nulls(items.select("item_id", "text"), "item_id").mapInPandas(run, f"item_id {kind}, words array<long>, seeds array<struct<seed:long,at:long>>"), "item_id")


def document_hits(docs: DataFrame, bitmap: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc_id, words, hits) of the documents with a seed that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, raws = b["doc_id"], _lowered(b["text"])
            out: dict[str, list] = {"doc_id": [], "words": [], "hits": []}
            for lo, hi in blocks(raws):
                words, counts, _ = word_hashes(raws[lo:hi], _PARTS)
                ends = np.cumsum(counts)
                found = [(at[keep], own[keep]) for at, own in seeds(words, counts, masks) for keep in [passes(shared.value, own)]]
                if not found:
                    continue
                at, own = (np.concatenate([x[i] for x in found]) for i in range(2))
                doc = np.searchsorted(ends, at, side="right")
                for d in np.unique(doc).tolist():
                    mine, begin = doc == d, int(ends[d] - counts[d])
                    out["doc_id"].append(ids.iloc[lo + d])
                    out["words"].append(signed(words[begin : ends[d]]).tolist())
                    out["hits"].append([{"seed": s, "at": a} for a, s in zip((at[mine] - begin).tolist(), signed(own[mine]).tolist(), strict=True)])
            if out["doc_id"]:
                yield pd.DataFrame({"doc_id": pd.Series(out["doc_id"], dtype=ids.dtype), "words": out["words"], "hits": out["hits"]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_nulls(without_nulls(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, words array<long>, hits array<struct<seed:long,at:long>>"))


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the run of highest score (match 1, substitution -2)."""
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.argmin(score[: end + 1]))
    return start, end, int(equal[start:end].sum())


def fullest_run(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """Start, end and matches of the run with most matches among all with a share of their words equal, the leftmost."""
    seen = np.concatenate(([0], np.cumsum(equal)))
    # A run has the share if this does not fall from its start to its end.
    over = seen - share * np.arange(len(seen))
    start = np.flatnonzero(equal)
    if not len(start):
        return 0, 0, 0
    # The farthest end of each start: the last place from which on something is as high.
    highest = np.maximum.accumulate(over[::-1])
    end = len(over) - 1 - np.searchsorted(highest, over[start] - 1e-9)
    best = int(np.argmax(seen[end] - seen[start]))
    first = int(start[best])
    last = int(start[np.searchsorted(start, end[best]) - 1])
    return first, last + 1, int(seen[last + 1] - seen[first])


def accepted_run(equal: np.ndarray, needed: float, share: float) -> tuple[int | None, int | None, int | None]:
    """Start, end and matches of a run with the needed matches and the share of its words equal; of the best run if it is one."""
    if equal.sum() < needed:
        return None, None, None
    start, end, matched = best_run(equal)
    if matched < needed or matched < share * (end - start):
        start, end, matched = fullest_run(equal, share)
    return (start, end, matched) if matched >= needed else (None, None, None)


def best_alignment(doc: np.ndarray, at: int, item: np.ndarray, shifts: np.ndarray, needed: float, share: float) -> tuple[int | None, ...]:
    """Place in the document and in the item, words and matches of the accepted run with most matches, then the leftmost;
    doc are the document's words from the place ``at`` on."""
    best: tuple[int, ...] | None = None
    for shift in np.sort(shifts).tolist():
        first, last = max(0, at - shift), min(len(item), at + len(doc) - shift)
        start, end, matched = accepted_run(doc[first + shift - at : last + shift - at] == item[first:last], needed, share)
        if matched is not None:
            one = (-matched, first + start + shift, first + start, end - start)
            best = one if best is None else min(best, one)
    return (None,) * 4 if best is None else (*best[1:], -best[0])


def compared(share: float, *columns: Column) -> Column:
    """struct<doc_word, item_word, n_aligned, n_matched> of the best alignment, nulls without one."""

    @F.pandas_udf("doc_word long, item_word long, n_aligned long, n_matched long")
    def run(doc: pd.Series, at: pd.Series, item: pd.Series, shifts: pd.Series, needed: pd.Series) -> pd.DataFrame:
        found = [best_alignment(np.asarray(d), a, np.asarray(i), np.asarray(s), n, share) for d, a, i, s, n in zip(doc, at, item, shifts, needed, strict=True)]
        return pd.DataFrame(found, columns=["doc_word", "item_word", "n_aligned", "n_matched"], dtype="Int64")

    return run(*columns)


def contaminated(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, share: float = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_aligned, n_matched) for each document and item that overlap."""
    known = materialise(item_seeds(items, shortest).withColumn("item", F.monotonically_increasing_id()))
    wanted = known.select("item", F.explode("seeds").alias("s")).select("item", "s.seed", F.col("s.at").alias("item_at"))
    bitmap = filter_of(wanted.select("seed"), "seed")
    few, short, n_seeds = known.select(*(F.coalesce(F.max((F.size("words") >= shortest) & (F.size("words") < n)), F.lit(False)) for n in (5, SHORT)), F.coalesce(F.sum(F.size("seeds")), F.lit(0))).first()
    masks = MASKS + (SHORT_MASKS if short else ()) + (sum(TINY_MASKS[:4], ()) + TINY_MASKS[4][1:] if few else ())
    hits = materialise(document_hits(docs, bitmap, masks).withColumn("doc", F.monotonically_increasing_id()))
    each = hits.select("doc", F.explode("hits").alias("h")).select("doc", "h.seed", F.col("h.at").alias("doc_at"))
    met = each.join(F.broadcast(wanted) if n_seeds <= BROADCAST else wanted, "seed")
    shifts = met.groupBy("doc", "item").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts"))
    pairs = hits.select("doc", "doc_id", F.col("words").alias("doc_words")).join(shifts, "doc").join(known.select("item", "item_id", F.col("words").alias("item_words")), "item")
    # The stretch of the document that the shifts touch.
    begin = F.greatest(F.lit(0).cast("long"), F.array_min("shifts"))
    end = F.least(F.size("doc_words").cast("long"), F.array_max("shifts") + F.size("item_words"))
    needed = F.least(F.lit(float(least_words)), F.ceil(share * F.size("item_words")).cast("double"))
    stretch = F.slice("doc_words", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    told = pairs.select("doc_id", "item_id", compared(share, stretch, begin, F.col("item_words"), F.col("shifts"), needed).alias("v"))
    return told.where(F.col("v.n_matched").isNotNull()).select("doc_id", "item_id", "v.doc_word", "v.item_word", "v.n_aligned", "v.n_matched")
