"""Near-duplicate detection with SuperMinHash.

A text's set is its distinct five-word shingles. SuperMinHash walks a random permutation of the signature's slots for
every shingle: in round j a shingle offers j plus a fresh uniform value to the j-th slot of its permutation, and a text
needs no further round once every slot holds less than j + 1. Ranks within a permutation exclude each other, which
lowers the variance against independent minima. Bands of the signature bring similar texts together, candidates are
verified on the full sets, and verified links are united to components.

A shingle is 64 bits made of its words' hashes, in which no letter counts linearly; texts are of one class if the digests
of their whole sets agree, and links compare whole sets. Two sets of 20,000 shingles hold a false match with a chance of
about 2e-11.

Whole job without all pairs of a group:

* Texts of equal sets form one class, represented by the smallest id.
* In each bucket the class of smallest id is the hub and the others are verified against it, so a large group of near
  copies costs a star; links found unite components.
* In buckets of more than two classes that then still hold several components, the signatures of all classes of
  different components are compared in blocks of at most BLOCK_ROWS rows or BLOCK_BYTES of sets, and where they agree in
  LIKELY of all slots the full sets are compared on the spot. (At similarity 0.75 the share of equal slots is 0.75 with
  a standard deviation below 0.04.) Only links leave a block.

Edge cases: null text and text without words have an empty set and are linked with nothing; a text of fewer than five
words is one shingle; rows that share an id keep one row each, the texts of one id
being linked with each other (but for those without words); a row without an id has a
null component and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialise, with_nulls, without_nulls
from tideline.llm.hashing import U, blocks, filter_of, mix, passes, signed, utf8, word_hashes

WORDS = 5
#: Bands and rows of a band; a pair of similarity 0.75 shares no band with a chance of about 5 in a million.
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Rows and bytes of sets of a block of a bucket, least share of equal slots that is verified.
BLOCK_ROWS, BLOCK_BYTES, LIKELY = 1024, 16 << 20, 0.55
#: Buckets whose sizes are broadcast.
BROADCAST = 1 << 18
#: Bytes of a shingle's hash.
KEPT = 8
_FACTORS = mix((np.arange(WORDS, dtype=np.uint64) + U(11)) * U(0xC2B2AE3D27D4EB4F)) | U(1)
_ROUND = 0x9E3779B97F4A7C15


def shingle_sets(raws: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (already lower-cased UTF-8)."""
    words, counts, _ = word_hashes(raws)
    ends = np.cumsum(counts)
    n = len(words) - width + 1
    total = np.full(max(n, 0), width, dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        total += words[k : k + n] * _FACTORS[k]
    total = mix(total)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(total[end - count : end - width + 1]))
        elif count:
            whole = words[end - count : end]
            out.append(mix(np.array([(whole * _FACTORS[:count]).sum() + U(count)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, a row for each set; an empty set's row is infinite."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), SLOTS), np.inf)
    flat = out.ravel()
    element = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    slots = np.zeros((0, SLOTS), dtype=np.uint8)
    for j in range(SLOTS):
        drawn = mix(element + U(_ROUND * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        value = j + (drawn >> U(11)).astype(np.float64) * 2.0**-53
        k = j + (((drawn & U(0xFFFFFFFF)) * U(SLOTS - j)) >> U(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            row = np.arange(len(element))
            slot = slots[row, k].astype(np.int64)
            slots[row, k] = slots[row, j]
        np.minimum.at(flat, owner * SLOTS + slot, value)
        needed = (out.max(axis=1) >= j + 1) & (sizes > 0)
        stays = needed[owner]
        if not stays.any():
            break
        if j == 0:
            first = k[stays]
            slots = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(first), 1))
            slots[np.arange(len(first)), first] = 0
        elif not stays.all():
            slots = slots[stays]
        element, owner = element[stays], owner[stays]
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band (the band's number included)."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(-1, BANDS, ROWS)
    total = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(bits), 1))
    for r in range(ROWS):
        total = mix(total * U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return total


def lowered(texts: pd.Series) -> list[bytes]:
    """UTF-8 with A-Z lower-cased."""
    return [r.lower() for r in utf8(texts)]


def _set_key(s: np.ndarray) -> bytes:
    """A digest of the whole sorted set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, slots): slots holds two bytes of a hash of each slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = lowered(b["text"])
            for lo, hi in blocks(raws):
                sets = shingle_sets(raws[lo:hi])
                signature = signatures(sets)
                bands, slots = signed(band_hashes(signature)), (mix(signature.view(np.uint64)) >> U(48)).astype(np.uint16)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].reset_index(drop=True), "n_shingles": [len(s) for s in sets], "set_key": [_set_key(s) for s in sets], "bands": list(bands), "slots": [x.tobytes() for x in slots]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, slots binary")


def packed_sets(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, n, set_key, packed) with the whole sets of the documents whose id passes the filter, sorted."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.iloc[np.sort(passes(shared.value, b["h"].to_numpy(dtype=np.int64).view(np.uint64)))]
            raws = lowered(b["text"])
            for lo, hi in blocks(raws):
                sets = shingle_sets(raws[lo:hi])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].reset_index(drop=True), "n": [len(s) for s in sets], "set_key": [_set_key(s) for s in sets], "packed": [s.tobytes() for s in sets]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInPandas(run, f"doc_id {kind}, n long, set_key binary, packed binary")


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def similar(a: Column, b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union of two packed sets."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        out = []
        for x, y, n, m in zip(a, b, n_a, n_b, strict=True):
            both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
            out.append(100 * both >= percent * (n + m - both))
        return pd.Series(out, dtype=bool)

    return run(a, b, n_a, n_b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar; each set is sent once to its hub a and once to each partner b."""
    near = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb"), F.col("n").alias("nb")), "b")
    both = near.join(sets.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa"), F.col("n").alias("na")), "a")
    # Sets of too different sizes cannot be similar.
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.where(similar(F.col("pa"), F.col("pb"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(v, c): smallest vertex reachable, for each vertex of the links (a, b).

    Alternately joins every vertex' larger neighbours, then its smaller ones, to the smallest it knows, until nothing
    changes; a star is left for each component. Partial minima are taken before each shuffle.
    """
    edges = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Large star: every larger neighbour goes to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least are written, so that the joins read both sides from exchanges and a vertex of very many edges is split.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the vertex itself, goes to the smallest.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.where(F.col("u") != F.col("v")).distinct())
        # Done when no vertex has two smaller neighbours, or a smaller and a larger one.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e"))
        loose = ends.groupBy("e.x").agg(F.sum("e.below").alias("below"), F.max("e.above").alias("above")).where("below + above > 1 and below > 0")
        if not loose.agg(F.count(F.lit(1))).collect()[0][0]:
            break
    return edges.select(F.col("u").alias("v"), F.col("v").alias("c"))


def links_in_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members (bucket, rep, n, c) of one bucket and different components that are similar.

    Large buckets are dealt into blocks, and each two blocks are compared in a group of their own: first the signatures,
    then, where these are alike enough, the full sets. A pair is looked at in the first bucket that it shares only, and
    nothing but links leaves the group.
    """
    rows, shingles = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = 2 * members.sparkSession.sparkContext.defaultParallelism + max(rows // BLOCK_ROWS, shingles * KEPT // BLOCK_BYTES)
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 2")
    sizes = materialise(sizes.select("bucket", F.ceil(F.greatest(F.col("size") / BLOCK_ROWS, F.col("shingles") * KEPT / BLOCK_BYTES)).cast("int").alias("blocks")))
    # Few buckets get this far; while they are few, members need not meet by bucket, where one may hold very many.
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST else sizes
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    # Small buckets share groups; a unit of a large one has its own.
    part = F.when(F.col("blocks") > 1, unit).otherwise(F.pmod(unit, F.lit(parts)))
    placed = placed.select(part.alias("part"), unit.alias("unit"), (F.col("own") != F.col("other")).alias("apart"), "bucket", "rep", "c", "own", "n")
    # Each class of the id comes, with its own size; one that is not in the bucket shares no band there.
    placed = placed.drop("n").join(sets.select(F.col("doc_id").alias("rep"), "n", "bands", "slots", "packed"), "rep")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        """All units of a part, one after the other."""
        group = group.sort_values("unit", kind="stable")
        rep, c, own, apart, unit, bucket, n = (group[x].to_numpy() for x in ("rep", "c", "own", "apart", "unit", "bucket", "n"))
        rows = np.frombuffer(b"".join(group["slots"]), dtype=np.uint16).reshape(len(group), SLOTS)
        bands, packed = np.stack(group["bands"].to_list()), group["packed"].to_list()
        edges = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])).tolist()
        left, right = [], []
        for lo, hi in zip(edges, [*edges[1:], len(unit)], strict=True):
            full: dict[int, np.ndarray] = {}
            for x in range(lo, hi):
                may = (rep[x] < rep[lo:hi]) & (c[x] != c[lo:hi]) & (100 * np.minimum(n[x], n[lo:hi]) >= percent * np.maximum(n[x], n[lo:hi]))
                if apart[lo]:
                    may &= own[x] != own[lo:hi]
                y = lo + np.flatnonzero(may)
                y = y[(rows[x] == rows[y]).mean(axis=1) >= LIKELY]
                y = y[bands[x, (bands[x] == bands[y]).argmax(axis=1)] == bucket[lo]]
                if not len(y):
                    continue
                for k in {x, *y.tolist()} - full.keys():
                    full[k] = unpacked(packed[k])
                others = [full[k] for k in y.tolist()]
                flat, mine = np.concatenate(others), full[x]
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                ends = np.cumsum([len(o) for o in others])
                both = np.diff(np.concatenate(([0], np.cumsum(hit)[ends - 1])))
                y = y[100 * both >= percent * (n[x] + n[y] - both)]
                left.append(np.full(len(y), rep[x], dtype=rep.dtype))
                right.append(rep[y])
        none = np.zeros(0, dtype=rep.dtype)
        return pd.DataFrame({"a": np.concatenate([none, *left]), "b": np.concatenate([none, *right])})

    kind = dict(members.dtypes)["rep"]
    return placed.repartition(parts, "part").groupBy("part").applyInPandas(run, f"a {kind}, b {kind}")


def spread(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(bucket, rep, n, c): members with their components, of the buckets that hold more than one."""
    placed = members.withColumn("c", F.col("rep"))
    if comp is not None:
        placed = members.join(comp.select(F.col("v").alias("rep"), F.col("c").alias("own")), "rep", "left").select("bucket", "rep", "n", F.coalesce("own", "rep").alias("c"))
    several = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    return materialise(placed.join(several, "bucket"))


def same_ids(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes that hold rows of one id, by their smallest ids."""
    held = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "set_key", "n_shingles", F.xxhash64("set_key").alias("h"))
    repeated = held.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("doc_id")
    known = held.join(repeated, "doc_id", "left_semi").distinct().join(classes.select("set_key", "n_shingles", "rep"), ["set_key", "n_shingles"])
    hub = known.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return known.join(hub, "doc_id").where(F.col("rep") > F.col("a")).select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    docs = without_nulls(docs.select("doc_id", "text"))
    sketches = materialise(with_nulls(sketched(docs)))
    classes = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_key", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "slots")).alias("m"))
    classes = materialise(classes.select("set_key", "n_shingles", F.col("m.doc_id").alias("rep"), "m.bands", "m.slots"))
    members = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = materialise(members.join(shared.select("bucket"), "bucket").select("bucket", "rep", "n"))
    bitmap = filter_of(members.select(F.xxhash64("rep").alias("h")).distinct(), "h")
    known = classes.select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n"), "set_key", "bands", "slots")
    sets = materialise(packed_sets(docs, bitmap).dropDuplicates(["doc_id", "n", "set_key"]).join(known, ["doc_id", "n", "set_key"]))
    placed = spread(members, None)
    hubs = placed.groupBy("bucket").agg(F.min("rep").alias("a"))
    pairs = placed.join(hubs, "bucket").where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct()
    comp = components(materialise(verified(pairs, sets, percent).unionByName(same_ids(sketches, classes))))
    links = materialise(links_in_buckets(spread(members, comp), sets, percent))
    # Components so far, as stars, and the new links.
    comp = components(links.unionByName(comp.select(F.col("v").alias("a"), F.col("c").alias("b"))))
    by_key = classes.select("set_key", "n_shingles", "rep")
    by_key = by_key.join(comp.select(F.col("v").alias("rep"), "c"), "rep", "left").select("set_key", "n_shingles", F.coalesce("c", "rep").alias("c"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(by_key, ["set_key", "n_shingles"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
