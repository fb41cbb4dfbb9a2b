from __future__ import annotations

import datetime
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shroudspark.operators import compute, evaluate, policy, profile


def test_profile_and_twin(spark):
    rows = [(k, float(k % 7) + 0.25, f"n{k % 5}", f"u{k}@mail.example.com", datetime.datetime(2024, 1, 1 + k % 20), None if k % 4 else "") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, amount double, name string, contact string, day timestamp_ntz, gone string")
    got = {r["header"]: r for r in profile.profile(df, "id").collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"id": "id", "amount": "number", "name": "text", "contact": "email", "day": "date", "gone": "empty"}
    assert got["amount"]["decimals"] == 2 and got["name"]["distinct"] == 5 and got["gone"]["nulls"] == 1.0
    twin = profile.twin(df, "id", rows=30)
    assert twin.columns == df.columns and twin.count() == 30
    assert profile.twin_leaks(df, twin, ["name", "contact", "id"]).count() == 0
    again = profile.twin(df, "id", rows=30)
    assert twin.exceptAll(again).count() == 0
    schema = {r["name"]: r for r in profile.twin_schema(df, "id", rows=30).collect()}
    assert (schema["id"]["rows"], schema["id"]["twin_rows"]) == (40, 30)


def test_falling_numbers_are_no_id(spark):
    df = spark.createDataFrame([(k, (k * 7) % 11, k // 2) for k in range(11)], "o int, falls int, rises int")
    got = {r["header"]: r["kind"] for r in profile.profile(df, "o").collect()}
    assert got == {"o": "id", "falls": "number", "rises": "id"}


def test_constant_numbers_are_not_copied(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert profile.twin(df).filter("x = 5").count() == 0


def test_header_row(spark):
    cells = spark.createDataFrame([("s", 0, "title"), ("s", 1, "a"), ("s", 1, "b"), ("s", 2, "c"), ("s", 2, "d"), ("s", 3, " "), ("t", 0, None)], "sheet string, row int, text string")
    assert {r["sheet"]: r["header_row"] for r in profile.header_row(cells).collect()} == {"s": 1, "t": 0}


def test_labels_by_the_last_rule(spark):
    paths = ["/x/data/a.csv", "/x/CORPUS/b", "/x/src/c", "/a/mixed/secret.xlsx", "/a/mixed/public/ok.xlsx", None, ""]
    df = spark.createDataFrame(list(enumerate(paths)), "k int, path string")
    rules = (("*/mixed/*", "confidential"), ("*/mixed/public/*", "public"))
    rows = df.select("k", policy.label(F.col("path")).alias("built"), policy.label(F.col("path"), rules).alias("own"), policy.blocked(F.col("path")).alias("blocked")).orderBy("k").collect()
    assert [r["built"] for r in rows][:3] == ["confidential", "restricted", "public"]
    assert [r["own"] for r in rows][3:5] == ["confidential", "public"]
    assert [r["blocked"] for r in rows] == [True, True, False, False, False, False, False]
    listed = spark.createDataFrame([(k, g, lab) for k, (g, lab) in enumerate(rules)], "ord int, glob string, label string")
    by_table = {r["k"]: r["label"] for r in policy.label_by_table(df.filter("k in (3, 4)"), listed).collect()}
    assert by_table == {3: "confidential", 4: "public"}


def test_scores(spark):
    key = spark.createDataFrame([("d", "A", "alpha", "detect", ""), ("d", "A", "betaten", "detect", ""), ("d", "B", "gamma", "suppress", ""), ("e", "B", "alpha", "gap", "")], "document string, type string, value string, expected string, note string")
    seen = spark.createDataFrame([("d", "x alpha y"), ("d", "eta"), ("d", "bet"), ("d", "zzz")], "document string, text string")
    got = {r["type"]: r for r in evaluate.recall(evaluate.caught(key, seen)).collect()}
    assert got["A"]["n_caught"] == 1 and got["A"]["recall"] == 0.5
    assert got["B"]["n_suppressed"] == 1 and got["B"]["n_gap_caught"] == 0
    assert tuple(evaluate.precision(key, seen).first()) == (4, 1, 0.75)
    gold = spark.createDataFrame([(1, "A", 0, 5), (1, "A", 5, 9), (2, "B", 0, 3)], "record int, type string, start int, end int")
    spans = spark.createDataFrame([(1, 4, 5), (3, 0, 9)], "record int, start int, end int")
    assert {r["type"]: r["n_caught"] for r in evaluate.span_recall(gold, spans).collect()} == {"A": 1, "B": 0}


def test_only_reading_queries_run(spark):
    events = spark.createDataFrame([("a@b.example.com", 1), ("x", 2)], "who string, n int")
    out = compute.safe_query("SELECT who, sum(n) AS n FROM events GROUP BY who", {"events": events})
    assert {tuple(r) for r in out.collect()} == {("<EMAIL_ADDRESS>", 1), ("x", 2)}
    nested = compute.safe_query("WITH t AS (SELECT * FROM events) SELECT collect_set(who) AS w FROM t", {"events": events})
    assert "example" not in nested.first()["w"]
    for bad in ("DROP TABLE events", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "SELECT java_method('a', 'b')", "SELECT * FROM parquet.`/x`", "SELECT reflect ('a')"):
        with pytest.raises(compute.Refused):
            compute.check(bad)
    for bad in ("SELECT * FROM others", "SELECT who FROM events WHERE n IN (SELECT n FROM others)", "WITH events AS (SELECT * FROM others) SELECT * FROM events"):
        spark.range(5).selectExpr("id AS n", "'secret' AS who").createOrReplaceTempView("others")
        with pytest.raises((compute.Refused, AnalysisException)):
            compute.safe_query(bad, {"events": events}).collect()
        spark.catalog.dropTempView("others")
    grown = compute.safe_query("WITH RECURSIVE r(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM r WHERE k < 3) SELECT count(*) AS c, max(n) AS m FROM r JOIN events ON n = k", {"events": events})
    assert tuple(grown.first()) == (2, 2)
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("__protected")]
    text = compute.run_query("SELECT who FROM events ORDER BY who", {"events": events}, chars=6)
    assert text.text == "who\n<E" and text.truncated and not text.timed_out


@pytest.mark.parametrize("more", [0, 150])
def test_tables_of_rules_label_as_rules_do(spark, more):
    """Single signs, sets, back slashes, capitals and the default's case; few rules and many."""
    paths = ["/a/b1/c", "C:\\Data\\x.txt", "/q/axc/", "/q/bxc/", "/q/(1)/[z].pdf", "/n.o/p$", "", None, "/A/B1/C"]
    rules = [(f"*/none{k}/*", "never") for k in range(more)] + [("*/b?/*", "Confidential"), ("*/data/*", "restricted"), ("*/[!b]x?/*", "odd"), ("*/(1)/*", "open"), ("*/n.o/p$", "end"), ("", "all")]
    df = spark.createDataFrame(list(enumerate(paths)), "k int, path string")
    listed = spark.createDataFrame([(k, g, lab) for k, (g, lab) in enumerate(rules)], "ord int, glob string, label string")
    want = {r["k"]: r["label"] for r in df.select("k", policy.label(F.col("path"), rules, "Public").alias("label")).collect()}
    assert want == {0: "confidential", 1: "restricted", 2: "odd", 3: "public", 4: "open", 5: "end", 6: "public", 7: "public", 8: "confidential"}
    assert {r["k"]: r["label"] for r in policy.label_by_table(df, listed, default="Public").collect()} == want
    with pytest.raises(ValueError):
        policy.label_by_table(df, listed, most_rules=3)


def test_scores_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 8)))
    key = [(rng.choice("de"), rng.choice("AB"), word(), rng.choice(("detect", "suppress", "gap")), "") for _ in range(40)] + [("d", "A", None, "detect", ""), (None, "A", "ab", "detect", "")] * 2
    seen = [(rng.choice("def"), rng.choice("XY"), word()) for _ in range(40)] + [("d", "X", None), (None, "Y", "ab")] * 2
    items = spark.createDataFrame(key, "document string, type string, value string, expected string, note string").repartition(3)
    found = spark.createDataFrame(seen, "document string, entity_type string, text string").repartition(3)
    ok = lambda *xs: all(x is not None for x in xs)
    hit = lambda k, d: ok(k[0], k[2], d[2]) and k[0] == d[0] and (k[2] in d[2] or (d[2] in k[2] and len(d[2]) >= 4))
    got = evaluate.caught(items, found)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*k, any(hit(k, d) for d in seen))) for k in key)
    wrong = [d for d in seen if not any(ok(k[0], k[2], d[2]) and k[0] == d[0] and (k[2] in d[2] or d[2] in k[2]) for k in key)]
    assert sorted(map(str, map(tuple, evaluate.false_positives(items, found).collect()))) == sorted(map(str, wrong))
    by_type = {r["entity_type"]: r["n_false"] for r in evaluate.false_by_type(items, found).collect()}
    assert by_type == {t: n for t in "XY" if (n := sum(d[1] == t for d in wrong))}
    card = evaluate.scorecard(items, found).first()
    n = [sum(k[3] == "detect" for k in key), sum(k[3] == "detect" and any(hit(k, d) for d in seen) for k in key)]
    assert (card["n_detect"], card["n_caught"], card["n_found"], card["n_false"]) == (*n, len(seen), len(wrong))
    assert card["f1"] == round(2 * card["precision"] * card["recall"] / (card["precision"] + card["recall"]), 3)
    none = spark.createDataFrame([], found.schema)
    assert evaluate.scorecard(items, none).first()["f1"] == 0.0


@pytest.mark.parametrize("most", [0, 60, 256])
def test_scores_are_those_of_brute_force_in_small_and_large_documents(spark, monkeypatch, most):
    """Only documents with more values and texts than are paired are cut into pieces."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))
    key = [(d, "A", word(), "detect", "") for d in "d" * 40 + "e" * 9 + "g"] + [("e", "A", None, "gap", ""), (None, "A", "ab", "gap", "")]
    seen = [(d, "X", word()) for d in "d" * 40 + "e" * 9 + "f"] + [("e", "X", None), (None, "X", "ab")]
    items = spark.createDataFrame(key, "document string, type string, value string, expected string, note string").repartition(3)
    found = spark.createDataFrame(seen, "document string, entity_type string, text string").repartition(3)
    cut, pieces = [], evaluate._pieces
    monkeypatch.setattr(evaluate, "MOST_PAIRED", most)
    monkeypatch.setattr(evaluate, "_pieces", lambda rows, *a: cut.append({r[0] for r in rows.select("document").distinct().collect()}) or pieces(rows, *a))
    ok = lambda k, d: None not in (k[0], k[2], d[2]) and k[0] == d[0]
    holds = lambda k, d, least: ok(k, d) and (0 < len(k[2]) and k[2] in d[2] or len(d[2]) >= least and d[2] in k[2])
    got = evaluate.caught(items, found).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*k, any(holds(k, d, 4) for d in seen))) for k in key)
    wrong = [d for d in seen if not any(holds(k, d, 1) for k in key)]
    assert sorted(map(str, map(tuple, evaluate.false_positives(items, found).collect()))) == sorted(map(str, wrong))
    assert set().union(*cut) == {0: {"d", "e", "f", "g"}, 60: {"d"}, 256: set()}[most]
