"""Whether texts hold one of many strings, in time that doesn't grow with how many there are."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_WIDTHS = (32, 16, 8)
_MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _starts(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of the first 8 of ``width`` bytes, or of all of fewer, of each word."""
    return (words if width >= 8 else words & np.uint64((1 << 8 * width) - 1)) * _MIX[0]


def _mixed(starts: np.ndarray, words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from the words at some places on; words follow each other."""
    out = starts[at]
    for k in range(1, width // 8):
        out += words[at + k] * _MIX[k]
    return out


class Literals:
    """Strings to look for, each known by an anchor: a window of 32, 16 or 8 of its bytes, or all of fewer.

    At every byte of a text the beginning of a window is hashed by array operations and
    looked up in a table of bits; where it is there, so is the window, and what is left is
    compared with the whole strings.  An anchor is the window that the fewest other strings
    have, of those that follow each other in a string and the last.
    """

    def __init__(self, strings: Iterable[str]):
        grouped: dict[int, list[bytes]] = {}
        for raw in sorted({s.encode() for s in strings} - {b""}):
            grouped.setdefault(next((w for w in _WIDTHS if len(raw) >= w), len(raw)), []).append(raw)
        self.groups = []
        for width, raws in sorted(grouped.items()):
            windows = [sorted({*range(0, len(raw) - width + 1, width), len(raw) - width}) for raw in raws]
            seen = Counter(raw[k : k + width] for raw, each in zip(raws, windows) for k in each)
            anchored: dict[int, list[tuple[int, bytes]]] = {}
            begin = []
            for raw, each in zip(raws, windows):
                at = min(each, key=lambda k: seen[raw[k : k + width]])
                words = np.frombuffer(raw[at : at + width].ljust(8, b"\0"), "<u8")
                starts = _starts(words, width)
                begin.append(starts[0])
                anchored.setdefault(int(_mixed(starts, words, np.array([0]), width)[0]), []).append((at, raw))
            bits = min(max(16, (16 * len(anchored)).bit_length()), 26)
            keys = np.array(sorted(anchored), np.uint64)
            table = np.zeros(1 << bits, bool)
            table[np.array(begin, np.uint64) >> np.uint64(64 - bits)] = True
            self.groups.append((width, np.uint64(64 - bits), table, keys, [anchored[k] for k in keys.tolist()]))

    def held(self, texts: pa.Array) -> np.ndarray:
        """For each text whether it holds one of the strings; null texts hold none."""
        hit = np.zeros(len(texts), bool)
        texts = texts.cast(pa.large_binary())
        data = texts.buffers()[2]
        if not len(texts) or data is None or not self.groups:
            return hit
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(data)
        for begin in range(int(ends[0]), int(ends[-1]), _CHUNK):
            stop = min(begin + _CHUNK, int(ends[-1]))
            part = bytes(raw[begin : min(stop + 32, int(ends[-1]))]) + bytes(48)
            for shift in range(8):
                words = np.frombuffer(part, "<u8", (len(part) - shift) // 8, shift)
                for width, down, table, keys, entries in self.groups:
                    starts = _starts(words, width)
                    found = np.flatnonzero(table.take((starts >> down).view(np.int64)))
                    found = found[begin + shift + 8 * found < stop]
                    mixed = _mixed(starts, words, found, width)
                    at = np.searchsorted(keys, mixed)
                    same = keys[np.minimum(at, len(keys) - 1)] == mixed
                    places, at = begin + shift + 8 * found[same], at[same]
                    rows = np.searchsorted(ends, places, "right") - 1
                    new = ~hit[rows]
                    for row, place, k in zip(rows[new].tolist(), places[new].tolist(), at[new].tolist()):
                        if not hit[row]:
                            low, high = int(ends[row]), int(ends[row + 1])
                            hit[row] = any(low <= place - o and place - o + len(s) <= high and bytes(raw[place - o : place - o + len(s)]) == s for o, s in entries[k])
        return hit
