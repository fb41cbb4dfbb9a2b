from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shroudspark.functions import checksums, spans, text
from shroudspark.plans import queries


def values(spark, rows, *columns):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [tuple(r) for r in df.select("k", *columns).orderBy("k").drop("k").collect()]


@pytest.mark.parametrize(
    ("valid", "good", "bad"),
    [
        (checksums.valid_abn, ["51 824 753 556"], ["51824753557", "51824753546", "5182475355", ""]),
        (checksums.valid_acn, ["004 085 616"], ["004085617", "104085616", "00408561"]),
        (checksums.valid_tfn, ["123 456 782"], ["123456783", "123456780", "1234567"]),
        (checksums.valid_medicare, ["2123 45670 1"], ["2123456711", "1123456701", "212345670"]),
        (checksums.valid_card, ["4111 1111 1111 1111", "378282246310005"], ["4111111111111112", "411111"]),
        (checksums.valid_iban, ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], ["GB82WEST12345698765433", "DE89"]),
        (checksums.valid_ipv4, ["10.0.0.255"], ["10.0.0.256", "1.2.3", "1.2.3.4.5"]),
    ],
)
def test_check_digits(spark, valid, good, bad):
    got = values(spark, [*good, *bad, None], valid(F.col("v")).alias("ok"))
    assert [g[0] for g in got] == [True] * len(good) + [False] * (len(bad) + 1)


def test_completed_numbers_pass(spark):
    stems = [f"{random.Random(1).randrange(10**8):08d}", "20000000", "00408561", "123", None]
    got = values(spark, stems, checksums.complete_acn(F.col("v")).alias("a"), checksums.complete_medicare(F.col("v")).alias("m"))
    assert got[2][0] == "004085616"
    assert got[3] == (None, None) and got[4] == (None, None)
    ok = values(spark, [got[1][1]], checksums.valid_medicare(F.col("v")).alias("ok"))
    assert ok == [(True,)]


def test_minting_finds_the_first_valid_number(spark):
    df = spark.range(1).select(checksums.mint(F.lit(51824753550), checksums.valid_abn, 100, 11).alias("a"), checksums.mint(F.lit(51824753557), checksums.valid_abn, 1, 11).alias("none"))
    assert tuple(df.first()) == ("51824753556", None)


def test_minted_business_numbers_are_those_of_a_search(spark):
    starts = [0, 5, 51824753550, 51824753557, 10**11 - 1, 10**11 - 30, 10**11 - 400, 10**11 + 7, 10**11 + 10**9, -3, None, *(random.Random(2).randrange(10**11) for _ in range(40))]
    df = spark.createDataFrame([(s,) for s in starts], "s bigint").repartition(4)
    for tries in (1, 2, 100, 101, 400):
        wrong = df.filter(~checksums.mint_abn(F.col("s"), tries).eqNullSafe(checksums.mint(F.col("s"), checksums.valid_abn, tries, 11)))
        assert wrong.collect() == []


def test_minting_takes_no_longer_by_the_tries(spark):
    """By search these are 80 million numbers, some minutes of work."""
    began = time.perf_counter()
    starts = spark.range(200_000).select((F.col("id") * 1000 + 10**10).alias("s"))
    assert starts.select(F.explode_outer(F.array(checksums.mint_abn(F.col("s"), 400))).alias("n")).agg(F.count("n")).first()[0] > 100_000
    assert time.perf_counter() - began < 30


def test_minting_gives_a_row_for_each_key(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,), (None,)], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    rows = queries.abn_mint_search(spark, str(tmp_path)).collect()
    assert len(rows) == len({r["c_custkey"] for r in rows}) > 0 and all(r["c_custkey"] for r in rows)


def test_normal_forms(spark):
    got = values(
        spark,
        ["Veranth Holdings Pty Ltd", "VERANTH HLDGS P/L", " a_x000A_b \t c ", "Aust. Wool Limited"],
        text.canonicalize(F.col("v")).alias("c"),
        text.normalize_ws(F.col("v")).alias("n"),
    )
    assert got[0][0] == got[1][0] == "veranth holdings ptyltd"
    assert got[2][1] == "a b c"
    assert got[3][0] == "australia . wool ltd"


def test_distinctive_words_keep_order_and_repeats(spark):
    got = values(spark, ["Bluehaven Nominees Pty Ltd", "Co Echo Echo Inc"], text.distinctive_words(F.col("v")).alias("w"))
    assert [g[0] for g in got] == [["bluehaven", "nominees"], ["echo", "echo"]]


def test_offsets_are_those_of_python(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choice("a1é٣ 22-x") for _ in range(40)) for _ in range(60)] + ["", "11"]
    pattern = r"[0-9]+(?:-[0-9]+)?"
    got = values(spark, rows, spans.find(F.col("v"), pattern, "T", 1.0).alias("s"))
    for row, (found,) in zip(rows, got):
        assert [(s["start"], s["end"], s["value"]) for s in found] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, row)]


def test_overlaps_go_to_the_earlier_then_longer(spark):
    span = lambda a, b: F.struct(F.lit("T").alias("type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(1.0).alias("score"), F.lit("").alias("value"))
    df = spark.range(1).select(spans.disjoint(F.array(span(4, 6), span(0, 3), span(0, 5), span(5, 9))).alias("s"))
    assert [(s["start"], s["end"]) for s in df.first()["s"]] == [(0, 5), (5, 9)]
    masked = spark.range(1).select(spans.mask(F.lit("0123456789"), F.array(span(4, 6), span(0, 3))).alias("t"))
    assert masked.first()["t"] == "<T>3<T>6789"
