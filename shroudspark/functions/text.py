"""Normal forms of text and of company names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shroudspark.functions.spans import let

#: Words that say what legal form a company has; they don't tell companies apart.
LEGAL_WORDS = ("co", "inc", "limited", "ltd", "p/l", "pl", "proprietary", "pty")


#: What escapes begin with.
ESCAPE = "_x00"
_ESCAPES = "_x00[01][0-9A-Fa-f]_|\u00a0"


def normalize_ws(text: Column) -> Column:
    """White space, also as non-breaking spaces or ``_x000A_`` escapes of workbooks, becomes single spaces."""
    # Few texts have an escape, and to look for its signs takes a tenth of what the pattern takes.
    return _single_spaces(F.when(contains_any(text, (ESCAPE, "\u00a0")), F.regexp_replace(text, _ESCAPES, " ")).otherwise(text))


def _single_spaces(plain: Column) -> Column:
    # Single spaces, most of what there is, don't match.
    return F.trim(F.regexp_replace(plain, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _whole(*words: str, gap: str = r"\s+") -> str:
    """Words with a gap between them, as whole words; a point at the end of a word may go with it."""
    return r"\b" + gap.join(words) + r"\b"


_DOT = r"\.?"
#: In this order: longer forms first, so that none is taken apart by a shorter one.
_FOLDS: tuple[tuple[str, str], ...] = (
    (_whole("proprietary", "limited"), "ptyltd"),
    (_whole("pty" + _DOT, "ltd" + _DOT, gap=r"\s*/?\s*"), "ptyltd"),
    (_whole("pty", "limited"), "ptyltd"),
    (_whole("p", "l", gap=r"\s*/\s*"), "ptyltd"),
    (_whole("pty" + _DOT), "ptyltd"),
    (_whole("pl"), "ptyltd"),
    (_whole("hldgs?"), "holdings"),
    (_whole("noms"), "nominees"),
    (_whole("limited"), "ltd"),
    (_whole("ltd" + _DOT), "ltd"),
    (_whole("aust" + _DOT), "australia"),
    (_whole("au"), "australia"),
)


#: What they make of words.
_FOLDED = frozenset(to for _, to in _FOLDS)
#: Any of them, tried in one pass.
_ANY_FOLD = r"\b(?:" + "|".join(pattern.removeprefix(r"\b") for pattern, _ in _FOLDS) + ")"


def folded(low: Column) -> Column:
    """The canonical form of a text in small letters and single spaces; null where it is that text itself."""
    start = F.concat(F.lit(" "), low, F.lit(" "))
    # As in normalize_ws, but the text, which is long as an expression, stands there once.
    whole = _single_spaces(F.regexp_replace(reduce(lambda t, f: F.regexp_replace(t, f[0], f" {f[1]} "), _FOLDS, start), _ESCAPES, " "))
    return F.when(F.contains(low, F.lit(ESCAPE)) | low.rlike(_ANY_FOLD), whole)


def unfolded_part(form: str) -> str | None:
    """What a normal form must hold if its canonical form holds ``form`` only by folding; null where folding can't bring that about.

    Words are folded to ``_FOLDED``, each with spaces around it, and all between them stays
    as it is.  So a form that is there by folding has one of these as a word, or begins or
    ends within one, and the words between those that may be such stand in the text.  The
    longest run of them is returned; it may be empty.  Texts with an ``ESCAPE`` are apart:
    a normal form may hold one, a canonical form doesn't.
    """
    words = form.split(" ")
    last = len(words) - 1

    def may_be(k: int, word: str) -> bool:
        if last == 0:
            return any(word in to for to in _FOLDED)
        return word in _FOLDED or (k == 0 and any(to.endswith(word) for to in _FOLDED)) or (k == last and any(to.startswith(word) for to in _FOLDED))

    runs: list[list[str]] = [[]]
    for k, word in enumerate(words):
        if may_be(k, word):
            runs.append([])
        else:
            runs[-1].append(word)
    return None if len(runs) == 1 else max((" ".join(run) for run in runs), key=len)


def canonicalize(text: Column) -> Column:
    """Lower case, single spaces, and one spelling for each legal form and common abbreviation."""
    return let(F.lower(normalize_ws(text)), lambda low: F.coalesce(folded(low), low))


def distinctive_words(name: Column) -> Column:
    """The words of a name, in order and with repeats, without those of its legal form."""
    words = F.split(F.lower(normalize_ws(name)), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_WORDS))


def forbidden_forms(term: Column) -> Column:
    """Distinct spellings under which a term would give itself away."""
    core = canonicalize(F.array_join(distinctive_words(term), " "))
    forms = F.array(F.lower(normalize_ws(term)), canonicalize(term), core)
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (f != "")))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def has_digit(text: Column) -> Column:
    return text.rlike(r"[0-9]")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
