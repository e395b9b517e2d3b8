"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for each distinct new word; every adjacent pair of proposed tokens is then checked
for compatibility (the pair's own text merges back into just these two tokens) by one vectorised look-up for the whole
batch; a word all of whose pairs are compatible is what merging would give, and only words that fail are merged
exactly. Pairs are judged once, by exact merging, and remembered.

Reads tokenizer files whose model is BPE with an end-of-word suffix over byte-level symbols, with NFC, white space and
lower-case normalisation; the file's vocabulary (of fixed size) is broadcast.

Edge cases: null text counts as empty and has no tokens; a word of any length is merged in n log n steps; control
strings of the tokenizer inside a text become their own ids, as in the library; repeated rows are each encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tideline.llm.common import with_nulls, without_nulls

#: Distinct words and token pairs that a worker remembers.
REMEMBERED = 500_000
#: Symbols of a word beyond which it is merged by itself.
WIDE = 48
SUFFIX = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _ranges(points: Iterable[int]) -> str:
    """The inside of a character class of these code points."""
    points = sorted(points)
    firsts = [c for c, before in zip(points, [-9, *points], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(points, [*points[1:], -9], strict=False) if after != c + 1]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(firsts, lasts, strict=True))


@dataclass(frozen=True)
class Characters:
    """Where the tokenizers library knows other characters than this Python and its regex module.

    The library is asked once, on the driver, for every code point; each of the three follows a Unicode version of its own.
    """

    #: Classes, as V1 sets, by the names that patterns have for them.
    classes: tuple[tuple[str, str], ...]
    #: Lower case that is not str.lower()'s.
    lower: dict[str, str]
    #: Inside of a class of characters that unicodedata cannot compose, as it does not know them.
    newer: str

    @classmethod
    def asked(cls) -> Characters:
        from tokenizers import Regex, normalizers

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        classes = []
        for kind in (r"\p{L}", r"\p{N}"):
            ask = normalizers.Replace(Regex(f"{kind}+"), "")
            parts = (ask.normalize_str(text[k : k + 4096]) for k in range(0, len(text), 4096))
            theirs, ours = set(text).difference(*parts), set(text).difference(regex.sub(f"{kind}+", "", text))
            less, more = _ranges(map(ord, ours - theirs)), _ranges(map(ord, theirs - ours))
            held = f"[{kind}--[{less}]]" if less else kind
            classes.append((kind, f"[{held}||[{more}]]" if more else held))
        chars = [c for c in text if c != "\n"]
        lowered = normalizers.Lowercase().normalize_str("\n".join(chars)).split("\n")
        lower = {c: low for c, low in zip(chars, lowered, strict=True) if low != c.lower()}
        newer = [c for c in points if unicodedata.category(chr(c)) == "Cn"]
        known = regex.compile(r"\P{Cn}")
        return cls(tuple(classes), lower, _ranges(c for c in newer if known.match(chr(c))))


@cache
def characters() -> Characters:
    return Characters.asked()


@dataclass
class Vocabulary:
    """What a tokenizer file holds."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    pattern: str
    #: SHA-256 of the file.
    digest: str
    characters: Characters

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        told = json.loads(raw)
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(told["model"]["vocab"], [tuple(m) for m in told["model"]["merges"]], {t["content"]: t["id"] for t in told["added_tokens"]}, split, hashlib.sha256(raw).hexdigest(), characters())


@dataclass
class Encoder:
    vocabulary: Vocabulary
    words: dict[str, bytes] = field(default_factory=dict)
    #: Codes of judged pairs, sorted, and the verdicts.
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    fits: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.token = {i: t for t, i in (v.ids | v.special).items()}
        self.base = max(self.token) + 2
        self.ranks = {m: r for r, m in enumerate(v.merges)}
        made = [(v.ids[a] * self.base + v.ids[b], v.ids[a + b]) for a, b in v.merges]
        codes = np.array([c for c, _ in made], dtype=np.int64)
        self.merge_rank = np.argsort(codes, kind="stable")
        self.merge_code = codes[self.merge_rank]
        self.merge_made = np.array([m for _, m in made], dtype=np.int64)
        self.longest = max(map(len, v.ids))
        self.split = regex.compile(v.pattern, regex.V0)
        self.high = regex.compile(r"[^\x00-\u0557]")
        pattern = v.pattern
        for kind, held in v.characters.classes:
            pattern = pattern.replace(kind, held)
        self.split_high = regex.compile(pattern, regex.V1)
        self.newer = regex.compile(f"[{v.characters.newer}]") if v.characters.newer else None
        self.other_case = regex.compile(f"[{_ranges(map(ord, v.characters.lower))}]") if v.characters.lower else None
        self.control = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.symbol = {i: c for i, c in enumerate(byte_symbols())}
        self.byte = {chr(i): c for i, c in self.symbol.items()}

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact merging: the pair of lowest rank first, leftmost first among equals."""
        n = len(symbols)
        part, right, left, dead = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if dead[i] or j >= n or part[i] != a or part[j] != b:
                continue
            part[i], dead[j], right[i] = a + b, True, right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (r := self.ranks.get((part[k], part[right[k]]))) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[right[k]]))
        return [p for p, gone in zip(part, dead, strict=True) if not gone]

    def merged_many(self, words: list[list[str]]) -> list[list[int]]:
        """Exact merging of many words: rows of equal length side by side, one merge in each row a round."""
        out: list[list[int]] = [[] for _ in words]
        rows: dict[int, list[int]] = {}
        ids = self.vocabulary.ids
        for k, symbols in enumerate(words):
            if len(symbols) > WIDE or any(s not in ids for s in symbols):
                out[k] = [ids[t] for t in self.merged(symbols) if t in ids]
            else:
                rows.setdefault(len(symbols), []).append(k)
        for size, members in rows.items():
            owner = np.array(members)
            grid = np.array([[ids[s] for s in words[k]] for k in members], dtype=np.int64).reshape(len(members), size)
            while len(owner):
                rank = np.full((len(owner), max(grid.shape[1] - 1, 1)), len(self.merge_rank), dtype=np.int64)
                if grid.shape[1] > 1:
                    code = grid[:, :-1] * self.base + grid[:, 1:]
                    at = np.minimum(np.searchsorted(self.merge_code, code), len(self.merge_code) - 1)
                    rank = np.where(self.merge_code[at] == code, self.merge_rank[at], rank)
                best = rank.argmin(axis=1)  # the leftmost of the lowest
                least = rank[np.arange(len(owner)), best]
                over = least == len(self.merge_rank)
                for k, done in zip(owner[over].tolist(), grid[over].tolist(), strict=True):
                    out[k] = done
                owner, grid, best, least = owner[~over], grid[~over], best[~over], least[~over]
                if len(owner):
                    each = np.arange(len(owner))
                    grid[each, best] = self.merge_made[least]
                    stays = np.ones(grid.shape, dtype=bool)
                    stays[each, best + 1] = False
                    grid = grid[stays].reshape(len(owner), -1)
        return out

    def symbols(self, token: int) -> list[str]:
        """The first symbols of a token; the end-of-word suffix belongs to the last one."""
        text = self.token[token]
        return [*text[:-5], text[-5:]] if len(text) >= 5 and text.endswith(SUFFIX) else list(text)

    def greedy(self, word: str) -> list[int] | None:
        """Longest matches from the left, the last of which takes the end of the word; None where no token fits."""
        out, at, ids, size = [], 0, self.vocabulary.ids, len(word)
        while at < size:
            if size - at <= self.longest and (i := ids.get(word[at:] + SUFFIX)) is not None:
                out.append(i)
                break
            for end in range(min(size - 1, at + self.longest), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return None
        return out

    def judge(self, codes: np.ndarray) -> None:
        """Settles the pairs not seen before; a code with second part 0 is of a single token."""
        fresh = np.setdiff1d(codes, self.pairs)
        if not len(fresh):
            return
        if len(self.pairs) > REMEMBERED:
            fresh, self.pairs, self.fits = np.unique(codes), self.pairs[:0], self.fits[:0]
        tokens = [[a, b - 1] if b else [a] for a, b in (divmod(code, self.base) for code in fresh.tolist())]
        merged = self.merged_many([[s for t in pair for s in self.symbols(t)] for pair in tokens])
        verdicts = [m == t for m, t in zip(merged, tokens, strict=True)]
        both = np.concatenate([self.pairs, fresh])
        order = np.argsort(both)
        self.pairs, self.fits = both[order], np.concatenate([self.fits, np.array(verdicts, dtype=bool)])[order]

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words and remembers them."""
        texts = ["".join(map(self.symbol.__getitem__, w.encode("utf-8", "replace"))) for w in words]
        proposed = [self.greedy(t) for t in texts]
        sizes = np.array([len(p or ()) for p in proposed], dtype=np.int64)
        flat = np.fromiter((i for p in proposed if p for i in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        nxt = np.append(flat[1:] + 1, 0)
        last = np.append(owner[1:] != owner[:-1], True)
        # The last token of a word stands for itself, so that single tokens are checked too.
        codes = flat * self.base + np.where(last, 0, nxt)
        good = np.ones(len(words), dtype=bool)
        good[[i for i, p in enumerate(proposed) if p is None]] = False
        if len(codes):
            self.judge(np.unique(codes))
            fits = self.fits[np.searchsorted(self.pairs, codes)]
            good &= np.bincount(owner, weights=~fits, minlength=len(words)) == 0
        failed = [k for k, ok in enumerate(good.tolist()) if not ok]
        for k, ids in zip(failed, self.merged_many([[*texts[k][:-1], texts[k][-1] + SUFFIX] for k in failed]), strict=True):
            proposed[k] = ids
        for word, ids in zip(words, proposed, strict=True):
            self.words[word] = struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces, as files without a decoder have it."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def pieces(self, text: str) -> list[str]:
        """Words and control strings of a text, in order."""
        out, at = [], 0
        for m in self.control.finditer(text) if self.control else ():
            out += [*self.plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not self.high.search(text):
            # Lower case is taken character by character, so a sigma ends in its usual form.
            return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.newer and self.newer.search(text):
            from tokenizers import normalizers

            text = normalizers.NFC().normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text)
        if self.other_case and self.other_case.search(text):
            text = "".join(self.vocabulary.characters.lower.get(c) or c.lower() for c in text)
        else:
            text = text.replace("Σ", "σ").lower()
        return self.split_high.findall(text)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Little-endian 32-bit ids and decoded text (token strings joined by spaces) of each text."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        for s, i in self.vocabulary.special.items():
            self.words[s] = struct.pack("<I", i)
        split = [self.pieces(t) for t in texts]
        fresh = set().union(*split).difference(self.words)
        if fresh:
            self.learn(sorted(fresh))
        done = [b"".join(map(self.words.__getitem__, p)) for p in split]
        return [(ids, self.decode(ids)) for ids in done]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """A worker's encoder, kept from task to task with all it remembers."""
    if vocabulary.digest not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.digest] = Encoder(vocabulary)
    return _encoders[vocabulary.digest]


def encode_texts(docs: DataFrame, tokenizer: str, digest: bool = False) -> DataFrame:
    """doc_id with n_tokens, ids (array) and decoded; with digest, SHA-256 of both in their place."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value)
        for b in batches:
            if b.empty:
                continue
            done = encoder.encode(b["text"].fillna("").tolist())
            out = pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(i) // 4 for i, _ in done]})
            if digest:
                out["ids_sha256"] = [hashlib.sha256(i).hexdigest() for i, _ in done]
                out["decoded_sha256"] = [hashlib.sha256(t.encode("utf-8")).hexdigest() for _, t in done]
            else:
                out["ids"] = [np.frombuffer(i, dtype="<u4").astype(np.int64) for i, _ in done]
                out["decoded"] = [t for _, t in done]
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded string"
    return with_nulls(without_nulls(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, n_tokens long, {rest}"))
