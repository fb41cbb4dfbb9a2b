"""Known names: patterns that match their usual spellings."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shroudspark.functions import spans

#: Spellings of words that are commonly shortened.
VARIANTS = {
    full: (full, *short.split())
    for full, short in {
        "australia": "aust au",
        "company": "co",
        "corporation": "corp",
        "holdings": "hldgs hldg",
        "incorporated": "inc",
        "international": "intl",
        "nominees": "noms nom",
    }.items()
}
LEGAL_TAIL = frozenset("co corp inc limited llc ltd pl proprietary pty".split())
_SUFFIX = "(?:" + "|".join([r"pty\.?\s*/?\s*ltd\.?", r"(?:proprietary|pty)\s+limited", r"p\s*/\s*l", r"(?:pty|ltd|inc|co)\.?", "limited", "llc"]) + ")"


def name_pattern(name: str, fuzzy: bool = False) -> str | None:
    """A case-blind pattern for a name; None if it is all legal form.

    The legal form at the end may be there or not.  ``fuzzy`` lets up to two other
    words stand between the name's words.  The end is open: a longer word matches.
    """
    words = [w.lower() for w in re.findall(r"[^\W_]+", name)]
    while words and words[-1] in LEGAL_TAIL:
        words.pop()
    if not words:
        return None
    gap = r"(?:\W+\w+){0,2}\W+" if fuzzy else r"\W+"
    spelled = ["(?:" + "|".join(VARIANTS.get(w, (w,))) + ")" for w in words]
    return rf"(?iU)\b{gap.join(spelled)}(?:\W+{_SUFFIX})?"


#: Names that become literal patterns of one expression; longer lists are matched word by word in Arrow batches.
MOST_PATTERNS = 100


def known_spans(names: Sequence[str], fuzzy: bool = False) -> Callable[[Column], Column]:
    """A function from a text column to its KNOWN_ENTITY spans, overlaps resolved.

    The list is read on the driver.  Few names become literal patterns, and a text is
    searched for a name only if it contains the name's first word in one of its
    spellings.  Of a long list the names are tried that begin with a word of the text,
    so a text takes time by its own length.
    """
    return _spans_of([(name, "KNOWN_ENTITY", pattern) for name in dict.fromkeys(names) if (pattern := name_pattern(name, fuzzy)) is not None], 1.0)


def gazetteer(lists: Mapping[str, Sequence[str]], score: float = 0.85) -> Callable[[Column], Column]:
    """A model of names for ``detect``: whole names of the lists (type to names), in the case in which they are listed.

    It stands in for a trained model where names are known: PERSON, ORGANIZATION and LOCATION.
    """
    each = []
    for kind, names in lists.items():
        for name in dict.fromkeys(names):
            words = re.findall(r"[^\W_]+", name)
            if words:
                each.append((name, kind, r"(?U)\b" + r"\W+".join(words) + r"\b"))
    return _spans_of(each, score)


def _spans_of(each: Sequence[tuple[str, str, str]], score: float) -> Callable[[Column], Column]:
    """A function to the disjoint spans of (name, type, pattern)."""
    parts = []
    for name, kind, pattern in each:
        first = re.findall(r"[^\W_]+", name)[0].lower()
        parts.append((pattern, kind, VARIANTS.get(first, (first,))))

    def run(text: Column) -> Column:
        if not parts:
            return F.expr(spans.NO_SPANS)

        def found(clean: Column, low: Column) -> Column:
            hits = [
                F.struct(F.lit(kind).alias("type"), F.when(F.exists(F.array(*map(F.lit, firsts)), lambda w: F.contains(low, w)), spans.marked(clean, pattern)).alias("marked"))
                for pattern, kind, firsts in parts
            ]
            make = lambda h: spans.places(h["marked"], lambda value, start, _: spans.span(h["type"], start, value, F.lit(score)))
            return spans.disjoint(F.flatten(F.transform(F.filter(F.array(*hits), lambda h: h["marked"] != clean), make)))

        return F.coalesce(spans.let(spans.plain(text), lambda t: spans.let(F.lower(t), lambda low: found(t, low))), F.expr(spans.NO_SPANS))

    def by_word(text: Column) -> Column:
        return spans.disjoint(F.coalesce(_by_first_word([(kind, firsts, pattern) for pattern, kind, firsts in parts], score)(text), F.expr(spans.NO_SPANS)))

    return run if len(parts) <= MOST_PATTERNS else by_word


def _by_first_word(parts: Sequence[tuple[str, Sequence[str], str]], score: float):
    """An Arrow function from texts to spans: at every word, the names that begin with it, or with a part of it, are tried.

    A part, for a name of one word may be the beginning of a longer one.
    """
    index: dict[str, list[tuple[str, str]]] = {}
    for kind, firsts, pattern in parts:
        for word in firsts:
            index.setdefault(word, []).append((kind, re.sub(r"^\(\?(i?)U\)", r"(?\1)", pattern).replace("(?)", "")))
    sizes = sorted({len(word) for word in index})
    compiled: dict[str, list[tuple[str, re.Pattern[str]]]] = {}

    @F.arrow_udf(f"array<{spans.SPAN}>")
    def find(texts: pa.Array) -> pa.Array:
        words = re.compile(r"[^\W_]+")
        out = []
        for text in texts.to_pylist():
            own, ends = [], {}
            for m in words.finditer(text or ""):
                whole = m.group().lower()
                for word in (whole[:n] for n in sizes if n <= len(whole)):
                    if word not in compiled and word in index:
                        compiled[word] = [(kind, re.compile(pattern)) for kind, pattern in index[word]]
                    for kind, pattern in compiled.get(word, ()):
                        hit = pattern.match(text, m.start())
                        if hit and ends.get(pattern, 0) <= hit.start():
                            ends[pattern] = hit.end()
                            own.append({"type": kind, "start": hit.start(), "end": hit.end(), "score": score, "value": hit.group()})
            out.append(own)
        kinds = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())])
        return pa.array(out, pa.list_(kinds))

    return find
