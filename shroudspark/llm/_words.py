"""Vectorised word segmentation and hashing over Arrow string arrays.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes of the
folded text; all other bytes separate words.  Folding maps ASCII and Latin-1 capitals
to small letters, byte for byte, so offsets stay those of the original text; letters
of other scripts are compared as they are.  All work is done on the UTF-8 buffer
with numpy, a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_lo:_hi] = True


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Small letters for ASCII and Latin-1 capitals (U+00C0 to U+00DE without U+00D7)."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    capital = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1
    out[capital] += 32
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 with well-spread bits."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, step in (("up", _BASE), ("down", inverse)):
                powers = np.full(size, step, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


_powers = _Powers()


class Words(NamedTuple):
    """Words of a run of rows: ``hashes[first[i]:first[i + 1]]`` belong to row ``i``."""

    hashes: np.ndarray  # uint64
    start: np.ndarray  # int64, byte offset in ``data``
    end: np.ndarray
    first: np.ndarray  # int64, rows + 1
    data: np.ndarray  # uint8
    row_start: np.ndarray  # int64, rows + 1: byte offset in ``data`` of each row


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and rows + 1 offsets; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    if len(array) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(array: pa.Array, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most_bytes`` each; a longer row stands alone."""
    _, at = string_buffer(array)
    lo, n = 0, len(array)
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + most_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words_of(array: pa.Array) -> Words:
    """Split and hash every row; a word never spans two rows."""
    data, row_start = string_buffer(array)
    data = fold(data)
    n = len(data)
    word = IS_WORD[data]
    # A word starts where a word byte follows a separator or the start of a row.
    starts = word.copy()
    ends = word.copy()
    if n:
        starts[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = row_start[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        starts[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    up, down = _powers.get(n + 1)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
    hashes = mix64((running[end] - running[start]) * down[start])
    first = np.searchsorted(start, row_start, side="left")
    return Words(hashes, start, end, first, data, row_start)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``size`` hashes (empty if there are fewer)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers.get(n + 1)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=running[1:])
    return mix64((running[size:] - running[:-size]) * down[: n - size + 1])


def prefix_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of every word, unlike that of a whole word."""
    out = np.full(len(words.start), np.uint64(size), dtype=np.uint64)
    length = words.end - words.start
    for k in range(size):
        live = length > k
        step = np.zeros(len(out), dtype=np.uint64)
        step[live] = words.data[words.start[live] + k].astype(np.uint64) + np.uint64(1)
        out = out * _BASE + step
    return mix64(out)
