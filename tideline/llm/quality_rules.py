"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes and of its language's commonest words is compared, by Jensen-Shannon
distance, with the reference of that language; references are the sums of both histograms over all documents of the
language. A document far from its reference goes, but only if it is long enough for its histogram to mean something.
Base rules (word count, repeated word windows) come first.

Every language label has a reference, and null has one. References are broadcast while they take up to BROADCAST bytes;
beyond that only null's and those of the HOT most frequent labels are, and the others are joined by label, of which none
is frequent.

Edge cases: null or empty text has no words and fails the base rule; repeated rows are judged alike; equally frequent
words are settled by the smaller word; an empty table gives an empty result; columns named like result columns are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import SPACES, materialise

#: Character classes, counted as what is left of the text without all else; the rest of the text is class "other".
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "stop": "[^.,;:!?'\"()-]+", "symbol": "[^#*$%&|<>]+"}
COMMON, HOT = 20, 64
WIDTH = 3
#: Bytes of references that are broadcast whole.
BROADCAST = 16 << 20
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    #: Percentage of words in repeated windows beyond which the base rule fails.
    max_repeat: int = 50
    #: Least code points and words for a histogram to be judged.
    min_chars: int = 200
    min_words_judged: int = 80
    max_char_distance: float = 0.28
    max_word_distance: float = 0.50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def word_windows(words: Column) -> Column:
    """64-bit hash of each window of WIDTH words."""
    at = F.sequence(F.lit(0), F.size(words) - WIDTH)
    return F.when(F.size(words) >= WIDTH, F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH))))).otherwise(F.array().cast("array<bigint>"))


def placed_windows(hashes: Column) -> Column:
    """Windows with their places, sorted; empty where no hash repeats, so that most texts are not sorted."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def repeat_places(placed: Column) -> Column:
    """Sorted places of the windows that equal a neighbour."""
    size = F.size(placed)
    twice = lambda x, i: ((i > 0) & (F.get(placed, i - 1)["h"] == x["h"])) | ((i < size - 1) & (F.get(placed, i + 1)["h"] == x["h"]))
    return F.sort_array(F.transform(F.filter(placed, twice), lambda x: x["at"]))


def covered_words(places: Column) -> Column:
    """Words under the windows at these places: each covers what the one before it has not."""
    fresh = F.transform(places, lambda p, i: F.when(i == 0, F.lit(WIDTH)).otherwise(F.least(p - F.get(places, i - 1), F.lit(WIDTH))))
    return F.aggregate(fresh, F.lit(0).cast("long"), lambda acc, g: acc + g)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for the method, __words and __text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__text", text).withColumn("__words", words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines).withColumn("__hashes", word_windows(F.col("__words")))
    df = df.withColumn("__placed", placed_windows(F.col("__hashes"))).withColumn("__places", repeat_places(F.col("__placed")))
    return df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.regexp_replace("__text", SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("__text", CLASSES["symbol"], "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered_words(F.col("__places")),
    }).drop("__lines", "__hashes", "__placed", "__places")


def char_counts(text: Column, chars: Column, word_chars: Column, symbols: Column) -> Column:
    """Code points of each class, the last being all others."""
    own = [F.length(F.regexp_replace(text, p, "")).cast("long") for k, p in CLASSES.items() if k != "symbol"]
    wide = F.octet_length(text).cast("long") - chars
    counted = [*own, symbols, chars - word_chars]
    rest = chars
    for c in counted:
        rest = rest - c
    return F.array(*counted, F.least(wide, rest), rest - F.least(wide, rest))


def with_references(docs: DataFrame, references: DataFrame, size: Column) -> DataFrame:
    """docs with the columns of their label's reference; size is the bytes of a reference."""
    references = materialise(references.withColumnRenamed("__label", "__l"))
    total = references.agg(F.sum(size)).first()[0] or 0
    if total <= BROADCAST:
        return docs.join(F.broadcast(references), F.col("__label").eqNullSafe(F.col("__l")), "left").drop("__l")
    counts = docs.where(F.col("__label").isNotNull()).groupBy("__label").agg(F.count(F.lit(1)).alias("n"))
    hot = [r["__label"] for r in counts.orderBy(F.desc("n"), "__label").limit(HOT).collect()]
    frequent = lambda label: label.isNull() | label.isin(hot)
    near, far = (docs.where(c) for c in (frequent(F.col("__label")), ~frequent(F.col("__label"))))
    near = near.join(F.broadcast(references.where(frequent(F.col("__l")))), F.col("__label").eqNullSafe(F.col("__l")), "left")
    return near.unionByName(far.join(references.hint("merge"), F.col("__label") == F.col("__l"), "left")).drop("__l")


def word_reference(docs: DataFrame) -> DataFrame:
    """(__label, __ref_words, __ref_p): commonest words and their shares, then the share of all other words."""
    each = docs.select("__label", F.explode(words_of(F.coalesce(F.col("text"), F.lit("")))).alias("word")).groupBy("__label", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(each)
    total = counted.groupBy("__label").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("__label").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= COMMON).groupBy("__label").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("w"))
    both = top.join(total.withColumnRenamed("__label", "__l"), F.col("__label").eqNullSafe(F.col("__l")))
    share = F.transform("w", lambda x: x["n"] / F.col("total"))
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(share, F.lit(0.0), lambda a, x: a + x))
    return both.select("__label", F.transform("w", lambda x: x["word"]).alias("__ref_words"), F.concat(share, F.array(rest)).alias("__ref_p"))


def char_reference(counted: DataFrame) -> DataFrame:
    """(__label, __ref_chars): share of each character class."""
    size = len(CLASSES) + 3
    sums = counted.groupBy("__label").agg(*(F.sum(F.get("__chars", F.lit(i))).alias(f"c{i}") for i in range(size)))
    whole = sum((F.col(f"c{i}") for i in range(1, size)), F.col("c0"))
    return sums.select("__label", F.array(*(F.coalesce(F.try_divide(f"c{i}", whole), F.lit(0.0)) for i in range(size))).alias("__ref_chars"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, logarithms to base 2; 0 to 1) of two histograms of shares."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: 0.5 * part(a, (a + b) / 2) + 0.5 * part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)))


def apply_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents with base counts, both distances (null where too short), base_failed and kept."""
    docs = docs.drop(*RESULTS).withColumn("__label", F.col("lang"))
    counted = base_counts(docs).withColumn("__chars", char_counts(F.col("__text"), F.length("__text").cast("long"), F.col("word_chars"), F.col("n_symbols"))).drop("__text")
    size = F.aggregate("__ref_words", F.lit(12 * COMMON).cast("long"), lambda n, w: n + F.octet_length(w))
    counted = with_references(counted, word_reference(docs), size)
    seen = F.transform("__ref_words", lambda c: F.col("n_words") - F.size(F.array_remove("__words", c)))
    counted = counted.withColumn("__common", seen).drop("__words", "__ref_words")
    others = F.col("n_words") - F.aggregate("__common", F.lit(0).cast("long"), lambda a, n: a + n)
    counted = materialise(counted.withColumn("__seen", F.concat("__common", F.array(others))).drop("__common"))
    counted = with_references(counted, char_reference(counted), F.lit(12 * (len(CLASSES) + 3)))
    shares = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))
    n_chars = F.aggregate("__chars", F.lit(0).cast("long"), lambda a, b: a + b)
    judged = counted.withColumns({
        "char_distance": F.when(n_chars >= limits.min_chars, distance(shares("__chars"), F.col("__ref_chars"))),
        "word_distance": F.when(F.col("n_words") >= limits.min_words_judged, distance(shares("__seen"), F.col("__ref_p"))),
        "base_failed": (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat * F.col("n_words")),
    })
    near = (F.coalesce("char_distance", F.lit(0.0)) <= limits.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.max_word_distance)
    return judged.withColumn("kept", ~F.col("base_failed") & near).drop("__label", "__chars", "__seen", "__ref_p", "__ref_chars")
