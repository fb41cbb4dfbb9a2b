"""Byte-level BPE encoding and decoding by replaying merges over a corpus of words.

The texts of a block of batches are one corpus: they are split into words, each distinct
word that the worker hasn't met in a block before is laid out once as a run of symbols,
and an inverted index leads from a pair of symbols to its positions.  Merges are then
applied in rank order, each at all its positions at once, and only the pairs to the left
and right of a merge are indexed anew.  Merges never cross words, so how texts are cut
into blocks, and what a worker has met, can't change an id.
"""

from __future__ import annotations

import heapq
import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudspark.llm._common import bounded_batches
from shroudspark.llm._words import _powers, chunks, mix64, string_buffer

TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")
_SHIFT = 20  # bits of a token id


class Vocabulary(NamedTuple):
    """Merges and tokens of a byte-level BPE vocabulary file."""

    byte_id: np.ndarray  # id of each byte
    keys: np.ndarray  # left << _SHIFT | right of every merge, sorted
    ranks: np.ndarray  # their ranks
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray  # the token that a merge makes
    data: np.ndarray  # bytes of all tokens, by id
    at: np.ndarray  # tokens + 1 offsets into them


@cache
def load(path: str) -> Vocabulary:
    """Read the vocabulary; once for each Python worker."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
    hidden = {c: b for b, c in shown.items()}
    vocab = model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, number in vocab.items():
        tokens[number] = bytes(hidden[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
    right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
    keys = left << _SHIFT | right
    order = np.argsort(keys)
    return Vocabulary(
        np.array([vocab[shown[b]] for b in range(256)], dtype=np.int32),
        keys[order],
        order,
        left,
        right,
        np.array([vocab[a + b] for a, b in merges], dtype=np.int32),
        np.frombuffer(b"".join(tokens), dtype=np.uint8),
        np.concatenate(([0], np.cumsum([len(t) for t in tokens]))),
    )


@cache
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for each code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        out[point] = 1 if kind == "L" else 2 if kind == "N" else 0
    for point in (*range(9, 14), 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[point] = 3
    for point in (28, 29, 30, 31):  # white space for Python, not for the pattern
        out[point] = 0
    return out


_APOSTROPHE = {"s": 1, "t": 1, "re": 2, "ve": 2, "m": 1, "ll": 2, "d": 1}


def split_words(data: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Byte offsets at which words start; the pattern's rules, on runs of character classes.

    A run of letters, of numbers or of other characters is a word, with one space
    before it if there is one; white space before that is a word, and so is an
    English contraction after an apostrophe that begins a run.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each character
    kind = _classes()[points]
    m = len(points)
    row = np.zeros(m, dtype=bool)  # a text starts here
    row[np.searchsorted(place, row_start[:-1][row_start[:-1] < n])] = True
    run = row.copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    # The last white space before a run stands apart; a space moves over to that run.
    begins = np.flatnonzero(run & (kind != 3) & ~row)
    begins = begins[kind[begins - 1] == 3]
    starts[begins - 1] = True
    spaced = begins[points[begins - 1] == 32]
    starts[spaced] = False
    # Contractions: an apostrophe that is a word of its own so far, then letters.
    marks = np.flatnonzero((points == 39) & starts)
    marks = marks[marks + 1 < m]
    marks = marks[(kind[marks + 1] == 1) & ~row[marks + 1]]
    for p in marks.tolist():
        for size in (1, 2):
            if p + size < m and not row[p + 1 : p + 1 + size].any() and _APOSTROPHE.get("".join(map(chr, points[p + 1 : p + 1 + size]))) == size:
                starts[p + 1] = False
                if p + 1 + size < m and kind[p + 1 + size] == 1 and not row[p + 1 + size]:
                    starts[p + 1 + size] = True
                break
    return place[starts]


def _rank(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of the merge of each pair, or -1."""
    keys = left.astype(np.int64) << _SHIFT | right
    at = np.searchsorted(vocabulary.keys, keys)
    at[at == len(vocabulary.keys)] = 0
    return np.where(vocabulary.keys[at] == keys, vocabulary.ranks[at], -1)


def replay(vocabulary: Vocabulary, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words ``data[first[i]:first[i + 1]]``: all ids, and words + 1 offsets."""
    n = len(data)
    symbol = vocabulary.byte_id[data].copy() if n else np.zeros(0, dtype=np.int32)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    after[first[1:][first[1:] > 0] - 1] = -1
    before[first[:-1][first[:-1] < n]] = -1
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(positions: np.ndarray, ranks: np.ndarray) -> None:
        found = ranks >= 0
        positions, ranks = positions[found], ranks[found]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate(([0], edges))].tolist(), np.split(positions, edges)):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(queue, rank)

    paired = np.flatnonzero(after >= 0)
    add(paired, _rank(vocabulary, symbol[paired], symbol[after[paired]]))
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        a, b = vocabulary.left[rank], vocabulary.right[rank]
        follower = after[at]
        live = (symbol[at] == a) & (follower >= 0)
        live[live] = symbol[follower[live]] == b
        at, follower = at[live], follower[live]
        if not len(at):
            continue
        if a == b:  # in a run of one symbol, pairs are taken from the left
            order = np.argsort(at)
            at, follower = at[order], follower[order]
            taken, last = np.ones(len(at), dtype=bool), -1
            for k, (p, q) in enumerate(zip(at.tolist(), follower.tolist())):
                if p == last:
                    taken[k] = False
                else:
                    last = q
            at, follower = at[taken], follower[taken]
        symbol[at] = vocabulary.made[rank]
        symbol[follower] = -1
        beyond = after[follower]
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        behind = at[inner]
        add(
            np.concatenate((ahead, behind)),
            np.concatenate((_rank(vocabulary, symbol[ahead], symbol[after[ahead]]), _rank(vocabulary, symbol[behind], symbol[after[behind]]))),
        )
    kept = symbol >= 0
    return symbol[kept], np.concatenate(([0], np.cumsum(kept)))[first]


def _spread(data: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked slices ``data[at[i]:at[i + 1]]`` one after another, and picks + 1 offsets."""
    size = (at[1:] - at[:-1])[pick]
    out = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(out[-1]) + np.repeat(at[pick] - out[:-1], size)], out


class Known(NamedTuple):
    """Words that this worker has replayed: their hashes, sorted, and where their ids are."""

    hashes: np.ndarray
    length: np.ndarray  # bytes of the word, which must agree too
    start: np.ndarray
    size: np.ndarray
    ids: np.ndarray


MOST_KNOWN = 1 << 21  # words; beyond it a worker keeps those of the last block
_known: dict[int, Known] = {}  # by vocabulary


def _ids_of(vocabulary: Vocabulary, hashes: np.ndarray, sizes: np.ndarray, blob: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of distinct words and their offsets; merges are replayed for words that are new to this worker.

    ``hashes`` are sorted; word ``k`` is the slice ``sample[k]`` of ``blob``.
    """
    none = np.zeros(0, dtype=np.int64)
    known = _known.get(id(vocabulary)) or Known(np.zeros(0, dtype=np.uint64), none, none, none, np.zeros(0, dtype=np.int32))
    length = sizes[sample]
    place = np.minimum(np.searchsorted(known.hashes, hashes), max(len(known.hashes) - 1, 0))
    hit = (known.hashes[place] == hashes) & (known.length[place] == length) if len(known.hashes) else np.zeros(len(hashes), dtype=bool)
    new = np.flatnonzero(~hit)
    words, first = _spread(blob, np.concatenate(([0], np.cumsum(sizes))), sample[new])
    made, ends = replay(vocabulary, words, first)
    start, size = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
    start[hit], size[hit] = known.start[place[hit]], known.size[place[hit]]
    start[new], size[new] = ends[:-1] + len(known.ids), np.diff(ends)
    ids = np.concatenate((known.ids, made))
    offsets = np.concatenate(([0], np.cumsum(size)))
    flat = ids[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    if len(known.hashes) + len(new) > MOST_KNOWN:
        _known[id(vocabulary)] = Known(hashes, length, offsets[:-1], size, flat)
    else:
        both = np.concatenate((known.hashes, hashes[new]))
        order = np.argsort(both, kind="stable")
        pick = lambda old, own: np.concatenate((old, own[new]))[order]
        _known[id(vocabulary)] = Known(both[order], pick(known.length, length), pick(known.start, start), pick(known.size, size), ids)
    return flat, offsets


def encode_texts(vocabulary: Vocabulary, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) by row ranges; the merges run once over all words."""
    parts, hashes, blobs, sizes = [], [], [], []
    for lo, hi in chunks(texts):
        data, row_start = string_buffer(texts.slice(lo, hi - lo))
        starts = split_words(data, row_start)
        up, down = _powers.get(len(data) + 1)
        running = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
        bounds = np.append(starts, len(data))
        own = mix64((running[bounds[1:]] - running[starts]) * down[starts])
        distinct, sample, inverse = np.unique(own, return_index=True, return_inverse=True)
        blob, out = _spread(data, bounds, sample)
        parts.append((lo, hi, inverse.astype(np.int32), np.searchsorted(starts, row_start)))
        hashes.append(distinct)
        blobs.append(blob)
        sizes.append(np.diff(out))
    if not parts:
        return
    distinct, sample, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    ids, offsets = _ids_of(vocabulary, distinct, np.concatenate(sizes), np.concatenate(blobs), sample)
    base = 0
    for (lo, hi, local, rows), own in zip(parts, hashes):
        flat, out = _spread(ids, offsets, inverse[base : base + len(own)][local])
        base += len(own)
        yield lo, hi, flat, out[rows]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of ids, and rows + 1 offsets."""
    data, out = _spread(vocabulary.data, vocabulary.at, ids)
    return data, out[offsets]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text under the vocabulary; null for a null text."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        found = [np.diff(offsets) for _, _, _, offsets in encode_texts(load(path), texts)]
        number = np.concatenate(found) if found else np.zeros(0)
        return pa.array(number.astype(np.int32), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return count(text)


BLOCK_BYTES = 16 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to blocks of about ``BLOCK_BYTES``, so that fewer words are replayed twice."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode(docs: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``token_ids``, ``n_tokens``, ``round_trip``) of every row.

    ``round_trip`` says that decoding the ids gives back the text, byte for byte.
    Special tokens' strings are ordinary text.  Defined cases: a null text has null
    ids, count and round trip; an empty one no ids; texts are encoded whole; equal
    rows get equal ids; an empty table has no rows.  Other columns, whatever their
    names, are not read.  ``path`` must be readable on every executor.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in _blocks(batches):
            texts = batch.column(1)
            for lo, hi, ids, offsets in encode_texts(vocabulary, texts):
                rows = texts.slice(lo, hi - lo)
                data, at = string_buffer(rows)
                back, back_at = decode_ids(vocabulary, ids, offsets)
                missing = rows.is_null().to_numpy(zero_copy_only=False)
                good = np.diff(back_at) == np.diff(at)
                if good.all() and not np.array_equal(back, data) or not good.all():
                    for r in np.flatnonzero(good):
                        good[r] = np.array_equal(back[back_at[r] : back_at[r + 1]], data[at[r] : at[r + 1]])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), type=kind, mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        lists,
                        pa.array(np.diff(offsets).astype(np.int32), mask=missing),
                        pa.array(good, mask=missing),
                    ],
                    names=["i", "token_ids", "n_tokens", "round_trip"],
                )

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return bounded_batches(rows).mapInArrow(run, f"i {id_type}, token_ids array<int>, n_tokens int, round_trip boolean").withColumnRenamed("i", id_col)


def decode(encoded: DataFrame, path: str = TOKENIZER, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of the ids in ``text_col`` (replaced if there).

    Null ids give a null text; bytes that are no UTF-8 become U+FFFD; an id outside
    the vocabulary is an error.
    """

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        vocabulary = load(path)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(vocabulary.at) - 1):
            raise ValueError("a token id lies outside the vocabulary")
        number = np.array(lists.value_lengths().fill_null(0).to_pylist(), dtype=np.int64)
        data, at = decode_ids(vocabulary, ids, np.concatenate(([0], np.cumsum(number))))
        raw = data.tobytes()
        missing = lists.is_null().to_pylist()
        return pa.array([None if missing[r] else raw[at[r] : at[r + 1]].decode("utf-8", "replace") for r in range(len(lists))], pa.string())

    return encoded.withColumn(text_col, texts(F.col(ids_col)))
