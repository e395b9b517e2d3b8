"""BPE against the tokenizers library."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from tideline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def _texts():
    rng = random.Random(7)
    letters = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x250), *range(0x390, 0x3FF), *range(0x4E00, 0x4E40), 0x1F600, 0x85, 0xA0, 0x200B)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 14))) for _ in range(50)) for _ in range(300)]
    return [*texts, "", "<|endoftext|>Hello<|startoftext|> it's", "</w> a</w>b <|endoftext|", "ΣΟΦΟΣ İI", "a" * 3000, "ab" * 4000, "é ½ ② 42"]


def test_ids_and_text_equal_the_library(spark):
    library, texts = Tokenizer.from_file(PATH), _texts()
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (5, texts[5])], "doc_id long, text string")
    rows = bpe.encode_texts(docs, PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = library.encode(texts[r["doc_id"]] if r["doc_id"] >= 0 else "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    digests = {r["doc_id"]: r for r in bpe.encode_texts(docs, PATH, digest=True).collect()}
    for r in rows:
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(r["ids"], dtype="<u4").tobytes()).hexdigest()
        assert digests[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def _points():
    """All code points but for most of the large uniform ranges: ideographs, syllables, private use, nothing assigned."""
    uniform = lambda c: 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A0 or unicodedata.category(chr(c)) == "Co" or 0x20000 <= c < 0xE0000
    return [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 97 == 0 or not uniform(c) and (c < 0x20000 or c % 7 == 0))]


def test_every_character_is_taken_as_the_library_takes_it():
    library, encoder, rng = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary.read(PATH)), random.Random(3)
    points = _points()
    newer = [c for c in points if unicodedata.category(c) == "Cn" and regex.match(r"\P{Cn}", c)]
    assert len(points) > 70_000 and len(newer) > 500
    made = [*points, *(c * 2 for c in points), *(f"a{c}b" for c in points), *(f"?{c}{c}!" for c in newer), *("".join(rng.choices(newer, k=6)) for _ in range(3000))]
    texts = [" ".join(made[k : k + 200]) for k in range(0, len(made), 200)]
    for k in range(0, len(texts), 100):
        want = library.encode_batch(texts[k : k + 100], add_special_tokens=False)
        for w, (ids, _) in zip(want, encoder.encode(texts[k : k + 100]), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == w.ids


def test_side_by_side_merging_is_exact():
    encoder, rng = bpe.Encoder(bpe.Vocabulary.read(PATH)), random.Random(9)
    words = [[*("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(0, 60)))), "s</w>"] for _ in range(500)]
    ids = encoder.vocabulary.ids
    assert encoder.merged_many(words) == [[ids[t] for t in encoder.merged(w)] for w in words]
    encoder.learn(["hello", "worlds"])
    assert encoder.pairs.size and set(encoder.words) == {"hello", "worlds"}


def test_empty_table(spark):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
