"""Generated documents with planted items and the key to them, of any size.

Every value is an expression of the row's number, so documents and key come from one
``range`` in any partitioning, and no identifier is that of a person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudspark.functions import checksums
from shroudspark.functions.spans import let

#: Rows of a document before the next begins.
ROWS = 60


def _digits(row: Column, salt: int, width: int) -> Column:
    """Digits without a zero in front, which would make a bare identifier look like a phone number too."""
    number = F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(9 * 10 ** (width - 1))) + 10 ** (width - 1)
    return number.cast("string")


def _abn(row: Column) -> Column:
    lead = lambda tail: 99 - checksums.weighted(tail, range(3, 20, 2)) % 89
    return checksums.spaced(let(_digits(row, 1, 9), lambda tail: F.concat(lead(tail).cast("string"), tail)), (2, 3, 3, 3))


def _tfn(row: Column) -> Column:
    """The last weight is 10, which is -1 modulo 11; a sum that asks for the digit 10 gets another first digit."""
    sums = lambda s: checksums.weighted(s, (1, 4, 3, 7, 5, 8, 6, 9)) % 11
    other = lambda stem: F.concat((F.substring(stem, 1, 1).cast("int") % 9 + 1).cast("string"), F.substring(stem, 2, 7))
    good = let(_digits(row, 2, 8), lambda stem: F.when(sums(stem) < 10, stem).otherwise(other(stem)))
    return checksums.spaced(let(good, lambda g: F.concat(g, sums(g).cast("string"))), (3, 3, 3))


def _card(row: Column) -> Column:
    stem = F.concat(F.lit("4"), _digits(row, 3, 14))
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(stem, d.cast("string")))
    return checksums.spaced(F.filter(ends, checksums.valid_card)[0], (4, 4, 4, 4))


def _iban(row: Column) -> Column:
    rest = lambda account: F.concat(account, F.lit("131400")).cast("decimal(24,0)") % 97
    return let(_digits(row, 4, 18), lambda account: F.concat(F.lit("DE"), F.lpad((98 - rest(account)).cast("int").cast("string"), 2, "0"), account))


def _items(row: Column) -> list[tuple[str, str, str, Column, str]]:
    """(type, expected, text before, value, text after) of each kind of row; no type: nothing is planted."""
    number = lambda low, span: (F.pmod(row, F.lit(span)) + low).cast("string")
    acn = checksums.spaced(checksums.complete_acn(_digits(row, 5, 8)), (3, 3, 3))
    medicare = checksums.spaced(checksums.complete_medicare(F.concat(F.lit("2"), _digits(row, 6, 7))), (4, 5, 1))
    code = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.pmod(F.xxhash64(row, k), F.lit(32)) + 1).cast("int"), F.lit(1)))
    return [
        ("AU_ABN", "detect", "Registered, ABN ", _abn(row), "."),
        ("AU_ABN", "suppress", "Registered under ", _abn(row), "."),
        ("AU_ACN", "detect", "Registered, ACN ", acn, "."),
        ("AU_ACN", "suppress", "The number ", acn, " was noted."),
        ("AU_TFN", "detect", "TFN ", _tfn(row), " is on file."),
        ("AU_TFN", "suppress", "Noted: ", _tfn(row), ""),
        ("MEDICARE", "detect", "Medicare ", medicare, "; seen."),
        ("EMAIL_ADDRESS", "detect", "Write to ", F.concat(F.lit("desk"), row.cast("string"), F.lit("@example.com")), " today."),
        ("PHONE_NUMBER", "detect", "Ring, phone 0", F.concat(F.lit("412 "), checksums.spaced(_digits(row, 7, 6), (3, 3))), " at noon."),
        ("CREDIT_CARD", "detect", "Paid with ", _card(row), " once."),
        ("IBAN_CODE", "detect", "Transfer to ", _iban(row), " again."),
        ("IP_ADDRESS", "detect", "Seen from ", F.concat(F.lit("203.0.113."), number(0, 256)), "; fine."),
        ("DATE_OF_BIRTH", "detect", "Date of birth ", F.concat(number(10, 18), F.lit("/0"), number(1, 9), F.lit("/19"), number(40, 60)), "."),
        ("AU_PASSPORT", "detect", "Passport PA", _digits(row, 8, 7), " was shown."),
        ("AU_DRIVER_LICENCE", "detect", "Driver licence ", _digits(row, 9, 8), " on arrival."),
        ("ENGAGEMENT_CODE", "detect", "Reference ", F.concat(F.lit("AUD-"), _digits(row, 10, 6)), "."),
        ("AU_ADDRESS", "detect", "Send it to ", F.concat(number(1, 400), F.lit(" Sturt Street, Ballarat VIC 3350")), " now."),
        ("CREDENTIAL", "detect", "Rotate AKIA", F.array_join(code, ""), " first."),
        ("SWIFT_BIC", "gap", "Through ", F.lit("CTBAAU2S"), " as ever."),
        ("", "", "Journal ", F.concat((row + 18_400_000).cast("string"), F.lit(" EP"), _digits(row, 11, 6), F.lit(" -"), number(100, 900), F.lit(".50")), ""),
        ("", "", "Row ", F.concat(number(1000, 1000), F.lit(" "), number(8000, 1000), F.lit(" "), number(3000, 1000)), " of the sheet"),
        ("", "", "Nothing to see in row ", number(10, 90), ""),
    ]


def planted(spark: SparkSession, rows: int) -> tuple[DataFrame, DataFrame]:
    """Segments (document, seg_no, locator, kind, text), one for each row, and their key
    (document, type, value, expected, note).

    Rows go round the kinds: identifiers with their label (``detect``), the same without
    (``suppress``), one that no detector covers (``gap``), and journal rows that look like
    identifiers and are none, for which the key has no item.
    """
    row = F.col("id")
    kinds = _items(row)
    which = F.pmod(row, F.lit(len(kinds)))
    item = F.lit(None)
    for k, (kind, expected, before, value, after) in enumerate(kinds):
        fields = F.struct(F.lit(kind).alias("type"), F.lit(expected).alias("expected"), F.lit(before).alias("before"), value.alias("value"), F.lit(after).alias("after"))
        item = fields if k == 0 else F.when(which == k, fields).otherwise(item)
    document = F.concat(F.lit("planted-"), F.floor(row / ROWS).cast("string"))
    # Generated, not projected: otherwise each use of a text would be planned with the expression of all kinds.
    base = spark.range(rows).select(document.alias("document"), (F.pmod(row, F.lit(ROWS)) + 1).alias("seg_no"), F.inline(F.array(item)))
    place = F.when(F.col("type") == "", "journals / row ").otherwise("line ")
    segments = base.select("document", "seg_no", F.concat(place, F.col("seg_no")).alias("locator"), F.lit("prose").alias("kind"), F.concat("before", "value", "after").alias("text"))
    key = base.filter("type <> ''").select("document", "type", "value", "expected", F.lit("").alias("note"))
    return segments, key
