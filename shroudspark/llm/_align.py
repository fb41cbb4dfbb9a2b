"""Banded bit-parallel alignment of word sequences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def edit_distance(left: Sequence[int], right: Sequence[int], most: int) -> int:
    """Insertions, deletions and substitutions between two sequences, or ``most + 1`` if more.

    Only the diagonals within ``most`` of the main one are computed, one bit each
    (Hyyro's banded form of Myers' algorithm), so a column costs a few operations on
    integers of ``2 * most + 2`` bits.
    """
    if len(left) < len(right):
        left, right = right, left
    n, m = len(left), len(right)
    lo = 0
    while lo < m and left[lo] == right[lo]:
        lo += 1
    hi = 0
    while hi < m - lo and left[n - 1 - hi] == right[m - 1 - hi]:
        hi += 1
    left, right = left[lo : n - hi], right[lo : m - hi]
    n, m = len(left), len(right)
    if n - m > most:
        return most + 1
    if m == 0:
        return n
    if most == 0:
        return 1
    common = Counter(left)
    common.subtract(Counter(right))
    surplus = sum(c for c in common.values() if c > 0)
    if surplus > most:  # each edit removes at most one surplus word of the longer side
        return most + 1
    most = min(most, n)
    width = 2 * most + 2
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for at, word in enumerate(left):
        where[word] = where.get(word, 0) | (1 << at)
    plus = (full << (width - most - 1)) & full
    minus = 0
    distance = most
    top, side = 1 << (width - 1), 1 << (width - 2)
    at = most + 1 - width
    limit = 2 * most + m - n
    for j, word in enumerate(right):
        match = where.get(word, 0)
        match = (match >> at if at >= 0 else match << -at) & full
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        level_plus = (minus | ~(diagonal | plus)) & full
        level_minus = diagonal & plus
        if j < n - most:
            distance += not diagonal & top
            if distance > limit:
                return most + 1
        else:
            distance += bool(level_plus & side)
            distance -= bool(level_minus & side)
            side >>= 1
        shifted = diagonal >> 1
        plus = (level_minus | ~(shifted | level_plus)) & full
        minus = shifted & level_plus
        at += 1
    return distance if distance <= most else most + 1


def similarity(left: Sequence[int], right: Sequence[int], least: float) -> float:
    """1 - edit distance / longer length, or 0 where that is below ``least``."""
    longer = max(len(left), len(right))
    if longer == 0:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    distance = edit_distance(left, right, most)
    return 1 - distance / longer if distance <= most else 0.0
