"""Detectors: declared patterns and validators that become one column of spans.

Each detector is a cheap test, a pattern and a validator, all JVM expressions.  Context
words are looked for before a pattern runs, so segments without them cost one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudspark.config import MODEL_TYPES, Settings
from shroudspark.functions import checksums, spans
from shroudspark.functions.text import contains_any, has_digit, has_letter, only_digits

#: Types that need no letter, having been validated or gated already.
_PROVEN = ("AU_BANK_ACCOUNT", "CREDENTIAL", "CREDIT_CARD", "IP_ADDRESS")
_PHONE_WORDS = tuple("call cell contact fax mob mobile phone tel telephone".split())


def _groups(*sizes: str, gap: str = r"\s?") -> str:
    """Digit groups of the given sizes with a gap between them, as a whole word."""
    return r"\b" + gap.join(f"[0-9]{{{n}}}" for n in sizes) + r"\b"


@dataclass(frozen=True)
class Detector:
    """A pattern; ``valid`` says which of its matches count, and ``cheap`` may rule a text out before."""

    type: str
    pattern: str
    score: float
    valid: Callable[[Column], Column] | None = None
    cheap: Callable[[Column], Column] | None = None
    signs: tuple[str, ...] = ()  # in small letters; without any of them there is no match
    flags: str = ""
    groups: int = 0  # of the pattern, that follow each match for ``longer``
    longer: Callable[[Column, Column], Column] | None = None  # (value and score) of a match, from its value and groups

    def marked(self, text: Column, low: Column, settings: Settings) -> Column:
        """The text with the matches marked; null where context or the cheap test rule it out."""
        flags = self.flags + ("U" if settings.unicode else "")
        out = spans.marked(text, f"(?{flags}){self.pattern}" if flags else self.pattern, self.groups)
        tests = [contains_any(low, words) for words in (settings.context.get(self.type), self.signs) if words]
        if self.cheap is not None:
            tests.append(self.cheap(text))
        for test in tests[::-1]:
            out = F.when(test, out)
        return out


def _has(*signs: str) -> Callable[[Column], Column]:
    return lambda text: contains_any(text, signs)


_KEY = "(?:pwd|password|passwd|(?:auth[_-]?)?token|(?:client[_-]?)?secret|(?:access|api)[_-]?key)"
_ASSIGN = rf"\b[\w.-]*{_KEY}\s*[:=]\s*"
_PART = "[A-Za-z0-9_-]{8,}"

SECRETS: tuple[tuple[str, float, tuple[str, ...]], ...] = (
    (r"\bA(?:K|S)IA[A-Z0-9]{16}\b", 0.9, ("kia", "sia")),
    (r"\bgh[opsru]_[A-Za-z0-9]{36}\b", 0.9, ("gh",)),
    (r"\bAIza[A-Za-z0-9_-]{35}\b", 0.9, ("aiza",)),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", 0.9, ("xox",)),
    (r"\b[rs]k_(?:test|live)_[A-Za-z0-9]{16,}\b", 0.9, ("k_test_", "k_live_")),
    (rf"\beyJ{_PART}(?:\.{_PART}){{2}}\b", 0.85, ("eyj",)),
    ("-----BEGIN[A-Z ]*PRIVATE KEY-----.*?-----END[A-Z ]*PRIVATE KEY-----", 0.95, ("private key",)),
    (r"""\b(?:redis|amqps?|mysql|postgres(?:ql)?|mongodb(?:\+srv)?)://[^\s:/@'"]+(?::[^\s:/@'"]+)@[^\s'"]+""", 0.85, ("://",)),
    (_ASSIGN + r"""["'][^"'\s]{8,}["']""", 0.7, ("pwd", "passw", "token", "secret", "key")),
    (_ASSIGN + r"""(?=[^\s"']*[0-9])[A-Za-z0-9._/+=-]{8,}""", 0.7, ("pwd", "passw", "token", "secret", "key")),
    (r"\bBearer\s+[A-Za-z0-9._~+/-]{16,}=*", 0.7, ("bearer",)),
)

#: With a country code, an area in brackets, a trunk zero, a freephone prefix, or as 3-3-4 digits.
PHONE = "|".join(
    (
        r"\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\) ?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}\b",
        r"\([0-9]{2,4}\) ?[0-9]{3,4}[ -]?[0-9]{3,4}\b",
        r"\b0[1-9][0-9]{0,2}(?:[ -][0-9]{2,4}){2,3}\b",
        r"\b04[0-9]{8}\b",
        r"\b1[38]00[ -]?[0-9]{3}[ -]?[0-9]{3}\b",
        r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}\b",
    )
)
_MONTHS = "|".join("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())

DETECTORS: tuple[Detector, ...] = (
    Detector("AU_ABN", _groups("2", "3", "3", "3"), 1.0, checksums.valid_abn),
    Detector("AU_ACN", _groups("3", "3", "3"), 1.0, checksums.valid_acn),
    Detector("AU_TFN", _groups("3", "3", "2,3"), 1.0, checksums.valid_tfn),
    Detector("MEDICARE", _groups("4", "5", "1,2"), 1.0, checksums.valid_medicare),
    Detector("DATE_OF_BIRTH", _groups("1,2", "1,2", "2,4", gap="[./-]"), 0.5),
    Detector("DATE_OF_BIRTH", rf"\b[0-9]{{1,2}}\s+(?:{_MONTHS})[a-z]*\.?\s+[0-9]{{4}}\b", 0.5),
    Detector("AU_PASSPORT", r"\b[A-Za-z]{1,2}[0-9]{7}\b", 0.5),
    Detector("AU_DRIVER_LICENCE", r"\b[A-Za-z0-9]{6,10}\b", 0.5, has_digit),
    Detector("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b", 1.0, cheap=_has("@")),
    Detector("CREDIT_CARD", r"\b(?:[0-9][ -]?){12,18}[0-9]\b", 1.0, checksums.valid_card, lambda t: t.rlike("(?:[0-9][ -]?){12}[0-9]")),
    Detector("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0, checksums.valid_iban, lambda t: t.rlike("[A-Z]{2}[0-9]{2}")),
    Detector("IP_ADDRESS", _groups("1,3", "1,3", "1,3", "1,3", gap=r"\."), 0.95, checksums.valid_ipv4, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    Detector(
        "PHONE_NUMBER",
        PHONE,
        0.5,
        lambda v: F.length(only_digits(v)).between(7, 15),
        lambda t: t.rlike("[0-9]{2}[ -]?[0-9]{2}"),  # every form of PHONE has that
    ),
)

_STREET_TYPES = "|".join(
    sorted(
        "Ave Avenue Blvd Boulevard Court Cres Crescent Ct Dr Drive Highway Hwy Lane Ln Parade Pde Pl Place Rd Road St Street".split(), key=lambda w: (-len(w), w)
    )
)
#: Postcode ranges by state.
POSTCODES: dict[str, tuple[tuple[int, int], ...]] = {
    "ACT": ((200, 299), (2600, 2618), (2900, 2920)),
    "NSW": ((1000, 2599), (2619, 2899), (2921, 2999)),
    "NT": ((800, 999),),
    "QLD": ((4000, 4999), (9000, 9999)),
    "SA": ((5000, 5999),),
    "TAS": ((7000, 7999),),
    "VIC": ((3000, 3999), (8000, 8999)),
    "WA": ((6000, 6797), (6800, 6999)),
}
_NAME = r"[A-Z][A-Za-z'.-]+"
_TITLE = r"[A-Z][a-z][A-Za-z'.-]*"
_STREET = (
    r"(?:(?:Level|Suite|Unit|L|U)\.?\s*[0-9]+[A-Za-z]?\s*[/,]?\s*)?"
    rf"[0-9]+[A-Za-z]?\s+(?:{_NAME}\s+){{1,3}}(?:{_STREET_TYPES})\b\.?"
)
_SUBURB = rf"(?<suburb>{_TITLE}(?:\s+{_TITLE}){{0,2}})?"
_TAIL = rf"\s*,?\s*{_SUBURB}\s*,?\s*(?<state>{'|'.join(POSTCODES)})?\s*(?<code>[0-9]{{4}})?"
_ADDRESS = rf"{_STREET}(?=({_TAIL}))"


def postcode_fits(state: Column, code: Column) -> Column:
    """Whether a state has a postcode; false for what is neither."""
    number = code.try_cast("int")
    tests = [(state == s) & (number.between(lo, hi)) for s, ranges in POSTCODES.items() for lo, hi in ranges]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def _whole_address(value: Column, groups: Column) -> Column:
    """A street, lengthened by suburb, state and postcode; a postcode of another state is left out."""
    tail, suburb, state, code = (groups[k] for k in range(1, 5))
    wrong = (state != "") & (code != "") & ~postcode_fits(state, code)
    used = F.when(wrong, F.substring(tail, F.lit(1), F.length(tail) - 4)).when((suburb != "") | (state != "") | (code != ""), tail).otherwise("")
    return spans.let(used, lambda u: F.struct(F.concat(value, u).alias("value"), F.when(u != "", F.lit(0.85)).otherwise(F.lit(0.4)).alias("score")))


_STREETS = Detector(
    "AU_ADDRESS", _ADDRESS, 0.4, cheap=lambda t: t.rlike(r"[0-9][A-Za-z]?\s+[A-Z]") & t.rlike(rf"\b(?:{_STREET_TYPES})\b"), groups=4, longer=_whole_address
)
#: Branch codes are found as spans of no type, of which only accounts make use.
_BRANCH = ""


def _near_branch(s: Column, codes: Column, settings: Settings) -> Column:
    """Whether a number has the right length and stands within reach of a branch code that isn't part of it."""
    lo, hi = settings.account_digits
    fits = F.length(only_digits(s["value"])).between(lo, hi)
    own = F.exists(codes, lambda b: spans.overlaps(s["start"], s["end"], b))
    reach = F.exists(codes, lambda b: F.least(F.abs(s["start"] - b["end"]), F.abs(b["start"] - s["end"])) <= settings.account_reach)
    return fits & reach & ~own


def detectors(settings: Settings) -> list[Detector]:
    """All that the settings ask for, in the order of their spans."""
    out = [d for d in DETECTORS if settings.wants(d.type)]
    if settings.wants("ENGAGEMENT_CODE"):
        out.append(Detector("ENGAGEMENT_CODE", settings.engagement_pattern, 0.6))
    if settings.wants("AU_BANK_ACCOUNT"):
        branch = lambda t: t.rlike(settings.branch_pattern)
        out += [Detector(_BRANCH, settings.branch_pattern, 1.0), Detector("AU_BANK_ACCOUNT", settings.account_pattern, 0.85, cheap=branch)]
    if settings.wants("AU_ADDRESS"):
        out.append(_STREETS)
    if settings.wants("CREDENTIAL"):
        out += [Detector("CREDENTIAL", pattern, score, signs=signs, flags="ism") for pattern, score, signs in SECRETS]
    return out + [d for d in settings.extra if settings.wants(d.type)]


def phone_survives(value: Column, low: Column) -> Column:
    """Whether a number without letters is a phone number rather than an amount or an id."""
    strong = value.rlike(r"^\s*(?:\+[0-9]|\([0-9]{2,3}\)|0[2-478]|1[38]00)")
    compact = F.regexp_replace(value, r"[\s()+-]", "")
    grouped = compact.rlike("^[0-9]{7,15}$") & value.rlike(r"[\s()-]")
    return ~F.contains(value, F.lit(".")) & (contains_any(low, _PHONE_WORDS) | strong | grouped)


def _precise(s: Column, low: Column, settings: Settings) -> Column:
    """What is left of spans: enough score, context words where a type needs them, and in
    strict mode letters, unless the type is proven or a phone survives, and no digits in model names."""
    ok = s["score"] >= settings.threshold
    for kind, words in settings.context.items():
        if settings.wants(kind):
            ok = ok & ((s["type"] != kind) | contains_any(low, words))
    if settings.strict:
        proven = s["type"].isin(*settings.context, *_PROVEN)
        ok = ok & (has_letter(s["value"]) | proven | ((s["type"] == "PHONE_NUMBER") & phone_survives(s["value"], low)))
        ok = ok & ~(s["type"].isin(*MODEL_TYPES) & has_digit(s["value"]))
    return ok


def span_column(text: Column, settings: Settings = Settings(), model: Callable[[Column], Column] | None = None) -> Column:
    """All spans of a text, in the order of the detectors.

    Every pattern passes over the text once and marks its matches; what has marks is
    taken apart, validated and filtered in one expression for all detectors.  ``model``
    may add spans of names from elsewhere (a function from the text column to an array
    of spans, such as ``known.gazetteer``); without it PERSON, ORGANIZATION and LOCATION
    aren't found.
    """
    each = detectors(settings)
    if not each and model is None:
        return F.expr(spans.NO_SPANS)

    def taken_apart(hit: Column) -> Column:
        def make(value: Column, start: Column, groups: Column) -> Column:
            whole = F.struct(value.alias("value"), hit["score"].alias("score"))
            for k, d in enumerate(each):
                if d.longer is not None:
                    whole = F.when(hit["n"] == k, d.longer(value, groups)).otherwise(whole)
            return spans.let(whole, lambda w: F.struct(hit["n"].alias("n"), spans.span(hit["type"], start, w["value"], w["score"]).alias("s")))

        return spans.places(hit["marked"], make)

    def valid(p: Column) -> Column:
        ok = F.lit(True)
        for k, d in enumerate(each):
            if d.valid is not None:
                ok = F.when(p["n"] == k, d.valid(p["s"]["value"])).otherwise(ok)
        return F.coalesce(ok, F.lit(False))

    def of(clean: Column, low: Column) -> Column:
        hits = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(d.type).alias("type"), F.lit(d.score).alias("score"), d.marked(clean, low, settings).alias("marked")) for k, d in enumerate(each)))
        found = F.flatten(F.transform(F.filter(hits, lambda h: h["marked"] != clean), taken_apart))
        good = F.transform(F.filter(found, valid), lambda p: p["s"])

        def left(all_: Column) -> Column:
            test = lambda s: (s["type"] != _BRANCH) & _precise(s, low, settings)
            if not settings.wants("AU_BANK_ACCOUNT"):
                return F.filter(all_, test)

            def near(codes: Column) -> Column:
                return F.filter(all_, lambda s: test(s) & ((s["type"] != "AU_BANK_ACCOUNT") | _near_branch(s, codes, settings)))

            return spans.let(F.filter(all_, lambda s: s["type"] == _BRANCH), near)

        parts = ([good] if each else []) + ([model(clean)] if model is not None else [])
        return spans.let(F.concat(*parts), left)

    return F.coalesce(spans.let(spans.plain(text), lambda t: spans.let(F.lower(t), lambda low: of(t, low))), F.expr(spans.NO_SPANS))


_made: dict[tuple, Column] = {}
_IN = "__text_in"


def _made_once(settings: Settings) -> Column:
    """``span_column`` of ``_IN``; to make it takes the driver longer than many a table does."""
    key = (id(SparkContext._active_spark_context), repr(settings))
    if key not in _made:
        if len(_made) > 64:
            _made.clear()
        _made[key] = span_column(F.col(_IN), settings)
    return _made[key]


def with_spans(df: DataFrame, text_col: str = "text", settings: Settings = Settings(), model: Callable[[Column], Column] | None = None, out: str = "spans") -> DataFrame:
    """``df`` with a column of spans; null texts have none."""
    if model is not None or settings.extra:
        return df.withColumn(out, span_column(F.col(text_col), settings, model))
    return df.withColumn(_IN, F.col(text_col)).withColumn(out, _made_once(settings)).drop(_IN)


def detect(df: DataFrame, keys: list[str], text_col: str = "text", settings: Settings = Settings(), model: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row (keys, type, start, end, score) for each span; the values stay inside."""
    found = with_spans(df.select(*keys, F.col(text_col).alias("__text")), "__text", settings, model, "__spans")
    return explode_spans(found, "__spans", keys).select(*keys, "s.type", "s.start", "s.end", "s.score")


def explode_spans(found: DataFrame, spans_col: str, keys: list[str]) -> DataFrame:
    """(keys, s), a row for each span.

    Outer, and filtered afterwards: from an inner explode a filter on the number of spans
    is inferred, for which all detectors would run a second time.
    """
    return found.select(*keys, F.explode_outer(spans_col).alias("s")).filter("s is not null")
