"""Check digits of identifiers, as unrolled arithmetic on digit strings.

Every ``valid_`` function is false, and not null, for text of the wrong length and for null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shroudspark.functions.spans import let
from shroudspark.functions.text import only_digits

_ABN = (10, *range(1, 20, 2))
_ACN = tuple(range(8, 0, -1))
_TFN9 = tuple(map(int, "1 4 3 7 5 8 6 9 10".split()))
_TFN8 = tuple(map(int, "10 7 8 4 6 3 5 1".split()))
_MEDICARE = (1, 3, 7, 9) * 2



def weighted(digits: Column, weights: Sequence[int]) -> Column:
    # The code point of "0" is 48; ascii of an empty string is 0, which the length test of callers keeps out.
    terms = [(F.ascii(F.substring(digits, k, 1)) - 48) * w for k, w in enumerate(weights, 1)]
    return reduce(lambda a, b: a + b, terms)


def _at(digits: Column, place: int) -> Column:
    return F.ascii(F.substring(digits, place, 1)) - 48


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def valid_abn(value: Column) -> Column:
    """Eleven digits; the weighted sum, the first digit less by one, is a multiple of 89."""
    return _sure(let(only_digits(value), lambda d: (F.length(d) == 11) & ((weighted(d, _ABN) - _ABN[0]) % 89 == 0)))


def acn_check(stem: Column) -> Column:
    return (10 - weighted(stem, _ACN) % 10) % 10


def valid_acn(value: Column) -> Column:
    return _sure(let(only_digits(value), lambda d: (F.length(d) == 9) & (acn_check(d) == _at(d, 9))))


def valid_tfn(value: Column) -> Column:
    """Nine digits, or the eight of older numbers; the weighted sum is a multiple of 11."""
    total = lambda d: F.when(F.length(d) == 9, weighted(d, _TFN9)).when(F.length(d) == 8, weighted(d, _TFN8))
    return _sure(let(only_digits(value), lambda d: total(d) % 11 == 0))


def valid_medicare(value: Column) -> Column:
    """Ten or eleven digits from 2 to 6 on; the ninth checks the first eight."""
    fits = lambda d: F.length(d).isin(10, 11) & _at(d, 1).between(2, 6) & (weighted(d, _MEDICARE) % 10 == _at(d, 9))
    return _sure(let(only_digits(value), fits))


def complete_acn(stem: Column) -> Column:
    """Eight digits with their check digit; null for another length."""
    return let(only_digits(stem), lambda d: F.when(F.length(d) == 8, F.concat(d, acn_check(d).cast("string"))))


def complete_medicare(stem: Column, issue: int = 1) -> Column:
    """Eight digits that begin with 2 to 6, the check digit and the issue number; else null."""

    def whole(d: Column) -> Column:
        fits = (F.length(d) == 8) & _at(d, 1).between(2, 6)
        return F.when(fits, F.concat(d, (weighted(d, _MEDICARE) % 10).cast("string"), F.lit(str(issue))))

    return let(only_digits(stem), whole)


def mint(start: Column, valid, tries: int, width: int) -> Column:
    """The first number from ``start`` on, with leading zeros, that passes ``valid``; null after ``tries``."""
    numbers = F.transform(F.sequence(start, start + tries - 1), lambda n: F.lpad(n.cast("string"), width, "0"))
    return F.try_element_at(F.filter(numbers, valid), F.lit(1))


#: Two last digits of a business number, in order, by the remainder that they have to give.
_ABN_ENDS = tuple(tuple(n for n in range(100) if (_ABN[9] * (n // 10) + _ABN[10] * (n % 10)) % 89 == rest) for rest in range(89))


def mint_abn(start: Column, tries: int) -> Column:
    """``mint`` of business numbers, for ``start`` a ``bigint``: the last two digits follow from the nine before.

    So a hundred numbers cost one sum and a look at the ends that give its remainder.
    Starts that leave eleven digits are searched, where anything valid is left at all.
    """
    low = start - F.pmod(start, F.lit(100))
    known = F.array(*(F.array(*map(F.lit, ends)) if ends else F.expr("CAST(array() AS array<int>)") for ends in _ABN_ENDS))

    def of(base: Column) -> Column:
        rest = F.pmod(_ABN[0] - weighted(F.lpad(base.cast("string"), 11, "0"), _ABN[:9]), F.lit(89))
        return F.transform(F.get(known, rest), lambda end: base + end)

    hundreds = F.transform(F.sequence(F.lit(0), F.lit((tries + 98) // 100)), lambda k: low + k * 100)
    numbers = F.filter(F.flatten(F.transform(hundreds, of)), lambda n: n.between(start, start + tries - 1))
    found = F.lpad(F.try_element_at(numbers, F.lit(1)).cast("string"), 11, "0")
    return F.when((start >= 0) & (start <= 10**11 - tries), found).otherwise(mint(start, valid_abn, tries, 11))


def spaced(digits: Column, groups: Sequence[int]) -> Column:
    """Digits in groups of the given sizes."""
    starts = [1 + sum(groups[:k]) for k in range(len(groups))]
    return let(digits, lambda d: F.concat_ws(" ", *(F.substring(d, s, n) for s, n in zip(starts, groups))))


def valid_card(value: Column) -> Column:
    """Thirteen to nineteen digits with a Luhn check digit (ISO/IEC 7812)."""
    return _sure(let(only_digits(value), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d)))


def valid_iban(value: Column) -> Column:
    """Remainder 1 modulo 97 once letters are numbers (ISO 13616); four digits are taken at a time."""
    plain = F.upper(F.regexp_replace(value, r"[^0-9A-Za-z]", ""))
    turned = F.concat(F.substring(plain, 5, 30), F.substring(plain, 1, 4))
    step = lambda rest, c: F.when(
        F.ascii(c) >= 65, (rest * 100 + F.ascii(c) - 55) % 97
    ).otherwise((rest * 10 + F.ascii(c) - 48) % 97)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return _sure(F.length(plain).between(15, 34) & (rest == 1))


def valid_ipv4(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return _sure((F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255)))
