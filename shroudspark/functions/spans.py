"""Matches of a pattern with their offsets, and what is done with spans.

A span is a struct (type, start, end, score, value): character offsets, end exclusive.
``value`` is for filters inside the engine and is never part of a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<type:string,start:int,end:int,score:double,value:string>"
NO_SPANS = f"CAST(array() AS array<{SPAN}>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also where ``body`` uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


_MARK, _PART = "\x01", "\x02"


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def plain(text: Column) -> Column:
    """The text without the two signs that mark matches; no offset changes."""
    marks = lambda t: F.contains(t, F.lit(_MARK)) | F.contains(t, F.lit(_PART))
    return let(text, lambda t: F.when(marks(t), F.translate(t, _MARK + _PART, "\ufffd\ufffd")).otherwise(t))


def marked(text: Column, pattern: str, groups: int = 0) -> Column:
    """The text with its matches between marks, in one pass; unchanged without a match.

    The first ``groups`` groups of the pattern, which may lie in a lookahead, follow each
    match.  The pattern must not match the empty string.
    """
    return F.regexp_replace(text, pattern, _MARK + "$0" + "".join(f"{_PART}${k}" for k in range(1, groups + 1)) + _MARK)


def places(text: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make`` of (value, start, groups) for each match of a marked text that has one, left to right.

    Starts are sums of the lengths before, first over blocks of 64 pieces and then
    within one, so that long texts with many matches take no time square in them.
    """
    block = 64

    def each(pieces: Column, lengths: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
        totals = F.transform(blocks, lambda b: _total(F.slice(lengths, b * block + 1, F.lit(block))))

        def one(totals: Column, k: Column) -> Column:
            at = 2 * k - 1
            b = F.floor(at / block).cast("int")
            start = _total(F.slice(totals, F.lit(1), b)) + _total(F.slice(lengths, b * block + 1, at - b * block))
            parts = F.split(F.get(pieces, at), _PART, -1)
            return let(parts, lambda g: make(g[0], start, g))

        return let(totals, lambda t: F.transform(F.sequence(F.lit(1), F.floor(F.size(pieces) / 2).cast("int")), lambda k: one(t, k)))

    own = lambda p: F.length(F.substring_index(p, _PART, 1))
    return let(F.split(text, _MARK, -1), lambda pieces: let(F.transform(pieces, own), lambda lengths: each(pieces, lengths)))


def span(kind: Column, start: Column, value: Column, score: Column) -> Column:
    return F.struct(kind.alias("type"), start.alias("start"), (start + F.length(value)).alias("end"), score.alias("score"), value.alias("value"))


def find(text: Column, pattern: str, kind: str, score: float) -> Column:
    """Spans of all matches, left to right."""
    make = lambda value, start, _: span(F.lit(kind), start, value, F.lit(score))

    def found(clean: Column) -> Column:
        return let(marked(clean, pattern), lambda m: F.when(m != clean, places(m, make)).otherwise(F.expr(NO_SPANS)))

    return F.coalesce(let(plain(text), found), F.expr(NO_SPANS))


def guarded(test: Column, spans: Column) -> Column:
    """``spans`` where a cheap test holds, which spares the others the patterns."""
    return F.when(F.coalesce(test, F.lit(False)), spans).otherwise(F.expr(NO_SPANS))


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, test)


def overlaps(a_start: Column, a_end: Column, b: Column) -> Column:
    return (a_start < b["end"]) & (b["start"] < a_end)


def disjoint(spans: Column) -> Column:
    """Spans that don't overlap: by start, the longest of one start first; later ones that overlap go."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("long"), s.alias("span"))))
    state = F.struct(F.lit(-1).alias("last"), F.expr(NO_SPANS).alias("kept"))
    step = lambda a, r: F.when(
        r["start"] >= a["last"], F.struct(r["span"]["end"].alias("last"), F.concat(a["kept"], F.array(r["span"])).alias("kept"))
    ).otherwise(a)

    def kept(rows: Column) -> Column:
        meet = F.exists(F.sequence(F.lit(1), F.size(rows) - 1), lambda k: rows[k]["start"] < rows[k - 1]["span"]["end"])
        return F.when((F.size(rows) > 1) & meet, F.aggregate(rows, state, step)["kept"]).otherwise(F.transform(rows, lambda r: r["span"]))

    return let(order, kept)


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its type in angle brackets; overlaps are resolved first."""

    def pieces(clean: Column) -> Column:
        end = lambda k: F.when(k > 0, F.get(clean, k - 1)["end"]).otherwise(F.lit(0))
        piece = lambda s, k: F.concat(F.substring(text, end(k) + 1, s["start"] - end(k)), F.lit("<"), s["type"], F.lit(">"))
        return F.concat(F.array_join(F.transform(clean, piece), ""), F.substring(text, end(F.size(clean)) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(disjoint(spans), pieces)).otherwise(text)
