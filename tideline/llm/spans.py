"""Spans of a text as native columns: code-point positions of leftmost non-overlapping matches, and texts cut at spans.

A span is struct<start long, rank int, end long, kind string, match string>; end is exclusive and rank is the kind's
place in its list, so that sorting an array of spans orders it by start, then by kind.

Nothing here takes a step as long as the text, or as all spans, for each span: running totals go in chunks of the square
root of their number, and a piece of text is cut from the parts of PART code points that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,match:string>"
#: Least numbers of a chunk of running totals, code points of a part of a text.
CHUNK, PART = 256, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the numbers (bigint, at least 0) those before it joined (plus or larger), 0 for the first."""
    none = F.array().cast("array<bigint>")

    def scan(part: Column, head: Column) -> Column:
        start = F.struct(head.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def chunked(n: Column) -> Column:
        width = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(n))).cast("int"))
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / w).cast("int")), lambda c: F.slice(n, c * w + 1, w))
        heads = lambda parts: scan(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), join)), F.lit(0).cast("bigint"))
        return let(let(width, cut), lambda parts: F.flatten(F.zip_with(parts, heads(parts), scan)))

    return let(numbers, lambda n: F.when(F.size(n) > CHUNK, chunked(n)).otherwise(scan(n, F.lit(0).cast("bigint"))))


def plus(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def placed(gaps: Column, hits: Column, span: Callable[[Column, Column, Column], Column]) -> Column:
    """span(start, end, hit) of each hit; gaps are the pieces of text before, between and after the hits."""
    size = lambda gap, hit: F.struct((F.length(gap) + F.coalesce(F.length(hit), F.lit(0))).cast("bigint").alias("size"), hit.alias("hit"))

    def all_of(pieces: Column) -> Column:
        told = lambda x, at: F.when(x["hit"].isNotNull(), span(at + x["size"] - F.length(x["hit"]), at + x["size"], x["hit"]))
        return F.array_compact(F.zip_with(pieces, before(F.transform(pieces, lambda x: x["size"]), plus), told))

    return let(F.zip_with(gaps, hits, size), all_of)


def matches(text: Column, pattern: str, kind: str, rank: int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of spans of every match; keep then judges each match's string.

    The pieces that split() leaves lie between the matches of the same pattern, so their lengths give the positions.
    """
    span = lambda start, end, hit: F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("match"))
    found = placed(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), span)
    found = F.filter(found, lambda s: keep(s["match"])) if keep else found
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def parts(text: Column) -> Column:
    """The text in parts of PART code points, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def cut(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points [begin, end) of the text of these parts."""
    first = F.floor(begin / PART).cast("int")
    touched = F.slice(pieces, first + 1, F.greatest(F.floor((end - 1) / PART).cast("int") - first + 1, F.lit(0)))
    return F.substring(F.array_join(touched, ""), (begin - first * PART + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def outside(text: Column, spans: Column) -> Column:
    """Array of struct<begin, end> of what lies outside all of the sorted spans."""
    size = F.length(text).cast("bigint")
    ends = F.concat(F.transform(spans, lambda s: s["end"]), F.array(size))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(size))
    gaps = F.zip_with(before(ends, larger), starts, lambda begin, end: F.struct(begin.alias("begin"), end.alias("end")))
    return F.filter(gaps, lambda g: g["begin"] < g["end"])


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each of the sorted spans, overlapping ones as one, replaced by the mark of the one that starts first."""
    size = F.length(text).cast("bigint")
    each = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("mark")))
    each = F.concat(each, F.array(F.struct(size.alias("start"), size.alias("end"), F.lit("").alias("mark"))))

    def whole(marks: Column, pieces: Column) -> Column:
        one = lambda s, at: F.when(s["start"] >= at, F.concat(cut(pieces, at, s["start"]), s["mark"])).otherwise(F.lit(""))
        return F.array_join(F.zip_with(marks, before(F.transform(marks, lambda s: s["end"]), larger), one), "")

    return let(each, lambda marks: let(parts(text), lambda pieces: whole(marks, pieces)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
