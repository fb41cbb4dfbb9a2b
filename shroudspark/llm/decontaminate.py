"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudspark.llm._common import bounded_batches, materialise, with_text
from shroudspark.llm._words import Words, chunks, mix64, words_of

SPANS = "array<struct<start:int,end:int,item_id:bigint,words:int,coverage:double>>"
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item_id", pa.int64()), ("words", pa.int32()), ("coverage", pa.float64())]))


class Limits(NamedTuple):
    """When a match is contamination, in words; defaults are the production values."""

    length: int = 12  # a match of so many words always is
    least: int = 6  # a shorter one may be, if it covers much of its item
    coverage: float = 0.6  # share of the item that it must then cover
    gap: int = 3  # spans so near each other are one: a changed word inside a copied item
    document: float = 0.5  # a document of which more than this share is spans goes altogether


class Automaton:
    """Generalised suffix automaton over word hashes.

    ``next[state]`` maps a word to a state, ``link`` is the suffix link, ``long`` the
    length of a state's longest string, ``item`` and ``size`` the shortest item (then
    the lowest id) that contains the state's strings, and its number of words.
    """

    def __init__(self, items: Sequence[tuple[int, Sequence[int]]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        self.best: list[tuple[int, int] | None] = [None]
        self._told: dict[Limits, list[int]] = {}
        for item_id, words in items:
            last = 0
            for word in words:
                last = self._extend(last, int(word), (len(words), item_id))
        for state in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and (self.best[up] is None or self.best[state] < self.best[up]):
                self.best[up] = self.best[state]
        words = np.array(sorted({w for edges in self.next for w in edges}), dtype=np.uint64)
        pairs = {w * 3 + v for _, ws in items for w, v in zip(map(int, ws), map(int, ws[1:]))}
        self.vocabulary = words
        self.pairs = np.array(sorted(p % (1 << 64) for p in pairs), dtype=np.uint64)

    def _state(self, long: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.long.append(long)
        self.best.append(None)
        return len(self.long) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.long[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int, owner: tuple[int, int]) -> int:
        q = self.next[last].get(word)
        if q is not None:
            at = q if self.long[q] == self.long[last] + 1 else self._clone(last, word, q)
        else:
            at = self._state(self.long[last] + 1)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = at
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[at] = q if self.long[q] == self.long[p] + 1 else self._clone(p, word, q)
        if self.best[at] is None or owner < self.best[at]:
            self.best[at] = owner
        return at

    def matches(self, words: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each maximal match: one that the next word doesn't extend."""
        state = length = 0
        for at, word in enumerate(words):
            step = self.next[state].get(word)
            if step is None:
                if length:
                    yield at, length, state
                while state and step is None:
                    state = self.link[state]
                    length = self.long[state]
                    step = self.next[state].get(word)
                if step is None:
                    length = 0
                    continue
            state, length = step, length + 1
        if length:
            yield len(words), length, state

    def told(self, limits: Limits) -> list[int]:
        """Per state, the nearest one on its way of suffix links whose longest string is contamination; 0 for none."""
        if limits not in self._told:
            told = [0] * len(self.long)
            for state in sorted(range(1, len(self.long)), key=self.long.__getitem__):
                told[state] = state if self.counts(state, self.long[state], limits) else told[self.link[state]]
            self._told[limits] = told
        return self._told[limits]

    def counts(self, state: int, length: int, limits: Limits) -> bool:
        """Whether a match of so many words is contamination by the state's shortest item."""
        return length >= limits.length or (length >= limits.least and length >= limits.coverage * self.best[state][0])

    def item_matches(self, words: Sequence[int], limits: Limits) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the longest suffix at each word that is contamination by some item.

        A suffix of the longest match may be it where the match is not: a short item
        that stands whole in the text, inside a longer item that doesn't.
        """
        told = self.told(limits)
        state = length = 0
        for at, word in enumerate(words, 1):
            step = self.next[state].get(word)
            while state and step is None:
                state = self.link[state]
                length = self.long[state]
                step = self.next[state].get(word)
            if step is None:
                continue
            state, length = step, length + 1
            if self.counts(state, length, limits):
                yield at, length, state
            elif shorter := told[self.link[state]]:
                yield at, self.long[shorter], shorter


def _member(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


def _candidate_runs(words: Words, automaton: Automaton, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, first, end) of runs in which every neighbouring pair of words occurs in an item.

    A match of ``least`` words needs ``least - 1`` such pairs in a row, so nothing that
    the automaton could report is passed over.
    """
    h, n = words.hashes, len(words.hashes)
    if n == 0:
        return
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if least <= 1:
        known = _member(automaton.vocabulary, h)
        follows = np.zeros(n, dtype=bool)
        follows[1:] = known[1:] & known[:-1] & (row[1:] == row[:-1])
        begins = np.flatnonzero(known & ~follows)
        ends = np.flatnonzero(known & ~np.append(follows[1:], False)) + 1
    else:
        follows = np.zeros(n + 1, dtype=bool)
        follows[1:n] = _member(automaton.pairs, h[:-1] * np.uint64(3) + h[1:]) & (row[1:] == row[:-1])
        edges = np.diff(follows.astype(np.int8))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
    long = ends - begins >= least
    for a, b in zip(begins[long].tolist(), ends[long].tolist()):
        yield int(row[a]), a, b


def find_spans(
    words: Words, automaton: Automaton | Sequence[Automaton], limits: Limits, by_item: bool = False, before: dict[int, list[tuple]] | None = None
) -> dict[int, list[tuple[int, int, int, int, float]]]:
    """Row to its spans (first word, end word, item, longest match, coverage), in text order.

    The matches of all lots of items, also those found ``before``, are merged together: an
    overlap or a short gap joins them, in whatever order.  With ``by_item`` the limits
    are tried for every item by itself, so neither lots nor other items can matter; the
    operators do so.  Otherwise they are tried for the longest match with any item only.
    """
    found: dict[int, list[tuple[int, int, int, int, float]]] = {row: list(spans) for row, spans in (before or {}).items() if spans}
    for one in [automaton] if isinstance(automaton, Automaton) else automaton:
        for row, a, b in _candidate_runs(words, one, min(limits.least, limits.length)):
            base, run = int(words.first[row]), words.hashes[a:b].tolist()
            begun = None
            for end, length, state in one.item_matches(run, limits) if by_item else one.matches(run):
                if not one.counts(state, length, limits):
                    continue
                size, item = one.best[state]
                span = (a - base + end - length, a - base + end, item, length, length / size)
                spans = found.setdefault(row, [])
                if begun == span[0]:
                    spans[-1] = span  # the same match, a word longer
                else:
                    spans.append(span)
                begun = span[0]
    return {row: merge_spans(spans, limits.gap) for row, spans in found.items()}


def merge_spans(spans: list[tuple], gap: int) -> list[tuple]:
    """Join spans that overlap or lie within ``gap``; the longest match names the item."""
    out: list[tuple] = []
    for span in sorted(spans):
        if out and span[0] - out[-1][1] <= gap:
            last = out[-1]
            best = max(last, span, key=lambda s: (s[3], s[4], -s[2]))
            out[-1] = (last[0], max(last[1], span[1]), *best[2:])
        else:
            out.append(span)
    return out


def _char_offsets(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Characters before each byte of ``data[lo:hi]``, counted from ``lo``."""
    return np.concatenate(([0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)))


def scan(texts: pa.Array, automata: Sequence[Automaton], limits: Limits, before: pa.Array | None = None) -> tuple[list[list[dict]], list[float]]:
    """Per row: its spans in characters, and the share of its words inside them."""
    spans: list[list[dict]] = []
    shares: list[float] = []
    for lo, hi in chunks(texts):
        words = words_of(texts.slice(lo, hi - lo))
        found = find_spans(words, automata, limits, by_item=True, before=_before(before, lo, hi))
        for row in range(hi - lo):
            if row not in found:
                spans.append([])
                shares.append(0.0)
                continue
            first, n = int(words.first[row]), int(words.first[row + 1] - words.first[row])
            at = int(words.row_start[row])
            chars = _char_offsets(words.data, at, int(words.row_start[row + 1]))
            places = [(int(chars[words.start[first + a] - at]), int(chars[words.end[first + b - 1] - at]), *rest) for a, b, *rest in found[row]]
            spans.append([_span(*p) for p in places])
            shares.append(sum(b - a for a, b, *_ in found[row]) / n)
    return spans, shares


def _span(start: int, end: int, item: int, length: int, share: float) -> dict:
    return {"start": start, "end": end, "item_id": item, "words": length, "coverage": share}


def _before(spans: pa.Array | None, lo: int, hi: int) -> dict[int, list[tuple]]:
    return {} if spans is None else {r: [tuple(s.values()) for s in own] for r, own in enumerate(spans.slice(lo, hi - lo).to_pylist()) if own}


def _lots(benchmark: DataFrame, id_col: str, text_col: str, limits: Limits, most_bytes: int) -> list[Callable[[], Automaton]]:
    """What makes the automata of the items, in lots of about ``most_bytes`` of text, one by one."""
    items = benchmark.select(F.col(id_col).try_cast("bigint").alias("i"), F.col(text_col).alias("t")).filter("t is not null and i is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    number = max(1, -(-size // most_bytes))

    def make(lot: int) -> Automaton:
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(number)) == lot) if number > 1 else items
        rows = sorted((r["i"], r["t"]) for r in part.distinct().toLocalIterator())
        words = words_of(pa.array([t for _, t in rows], pa.string()))
        automaton = Automaton([(i, words.hashes[words.first[k] : words.first[k + 1]].tolist()) for k, (i, _) in enumerate(rows)])
        automaton.told(limits)  # once, here, rather than in every worker
        return automaton

    return [lambda lot=lot: make(lot) for lot in range(number)]


def _collector(lots: list, limits: Limits):
    """A function from texts, and the spans found before, to their spans in words."""

    @F.arrow_udf(SPANS)
    def collect(texts: pa.Array, *before: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for lo, hi in chunks(texts):
            words = words_of(texts.slice(lo, hi - lo))
            found = find_spans(words, [lot.value for lot in lots], limits, by_item=True, before=_before(before[0] if before else None, lo, hi))
            out += [[_span(*s) for s in found.get(row, ())] for row in range(hi - lo)]
        return pa.array(out, _SPAN_LIST)

    return collect.asNondeterministic()


def _contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, limits: Limits, most_bytes: int, at_once: int
) -> DataFrame:
    """``docs`` with ``__spans`` and ``__share``.

    At most ``at_once`` lots of items are sent to the executors together.  A benchmark of
    more lots takes several passes over the texts: all but the last one write what they
    find, in words, beside the texts, and the last one merges it with its own.
    """
    spark = docs.sparkSession
    lots = _lots(benchmark, item_col, item_text_col, limits, most_bytes)
    passes = [lots[k : k + at_once] for k in range(0, len(lots), at_once)]
    for part in passes[:-1]:
        shared = [spark.sparkContext.broadcast(make()) for make in part]
        before = [F.col("__before")] if "__before" in docs.columns else []
        docs = materialise(bounded_batches(docs).withColumn("__before", _collector(shared, limits)(F.col(text_col), *before)), "matches")
        for lot in shared:
            lot.destroy()
    last = [spark.sparkContext.broadcast(make()) for make in passes[-1]]

    @F.arrow_udf(f"struct<spans:{SPANS},share:double>")
    def find(texts: pa.Array, *before: pa.Array) -> pa.Array:
        spans, shares = scan(texts, [lot.value for lot in last], limits, before[0] if before else None)
        return pa.StructArray.from_arrays([pa.array(spans, _SPAN_LIST), pa.array(shares, pa.float64())], names=["spans", "share"])

    before = [F.col("__before")] if "__before" in docs.columns else []
    found = bounded_batches(docs).withColumn("__found", find.asNondeterministic()(F.col(text_col), *before))
    return found.withColumns({"__spans": F.col("__found.spans"), "__share": F.col("__found.share")}).drop("__found", "__before")


def _cut(text: str, spans: str) -> F.Column:
    """The text without its spans; each leaves one space where words met it on both sides."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda k: F.substring(
            F.col(text),
            F.when(k == 0, 1).otherwise(F.col(spans)[k - 1]["end"] + 1),
            F.when(k < F.size(spans), F.col(spans)[k]["start"]).otherwise(F.length(text))
            - F.when(k == 0, 0).otherwise(F.col(spans)[k - 1]["end"]),
        ),
    )
    return F.array_join(pieces, "")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_bytes: int = 1 << 20,
    at_once: int = 16,
) -> DataFrame:
    """One row for each document that holds benchmark text.

    Columns: the id, ``spans`` (character offsets in the original text, the item, the
    longest matching length in words, its share of the item), ``share`` of the
    document's words inside spans, ``dropped`` (the share is over ``limits.document``)
    and ``clean_text`` (null where dropped).

    Words are compared after folding ASCII and Latin-1 letters to lower case and
    dropping everything that is no letter or digit.  Defined cases: null or empty
    texts and items, and an empty benchmark, match nothing; repeated items count once;
    of items that hold the same passage the shortest, then the lowest id, is named;
    repeated rows of ``docs`` are reported as often as they occur; a null id is kept;
    texts are read whole, however long; items whose ids are no integers are left out;
    other columns of either table, whatever their names, are not read.  Items are
    matched in lots of about ``most_bytes`` of text, ``at_once`` of them in one pass.
    """
    base = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    found = _contamination(base, benchmark, "__text", item_col, item_text_col, limits, most_bytes, at_once).filter(F.size("__spans") > 0)
    dropped = F.col("__share") > limits.document
    return found.select(
        id_col,
        F.col("__spans").alias("spans"),
        F.round("__share", 6).alias("share"),
        dropped.alias("dropped"),
        F.when(~dropped, _cut("__text", "__spans")).alias("clean_text"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    limits: Limits = Limits(),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_bytes: int = 1 << 20,
    at_once: int = 16,
) -> DataFrame:
    """All documents and columns, without the spans and the documents over the limits.

    The cases are those of ``contaminated``; a document without a span is unchanged, an
    empty table stays empty, and columns may have any names but ``__before``,
    ``__found``, ``__spans`` and ``__share``.
    """
    found = _contamination(docs, benchmark, text_col, item_col, item_text_col, limits, most_bytes, at_once)
    kept = found.filter(F.col("__share") <= limits.document)
    text = F.when(F.size("__spans") > 0, _cut(text_col, "__spans")).otherwise(F.col(text_col))
    return with_text(kept, text_col, text).drop("__spans", "__share")
