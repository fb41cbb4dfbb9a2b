from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shroudspark.functions import checksums
from shroudspark.operators import corpus, evaluate
from shroudspark.operators.detect import with_spans

ROWS = 22 * 40


@pytest.fixture(scope="module")
def scored(spark):
    segments, key = corpus.planted(spark, ROWS)
    spans = with_spans(segments).select("document", "locator", F.explode("spans").alias("s"))
    found = spans.select("document", F.col("s.type").alias("entity_type"), F.col("s.value").alias("text"), "locator").cache()
    return segments, key.cache(), found


def test_planted_numbers_pass_their_checks(scored):
    key = scored[1]
    for kind, valid in {"AU_ABN": checksums.valid_abn, "AU_ACN": checksums.valid_acn, "AU_TFN": checksums.valid_tfn, "MEDICARE": checksums.valid_medicare, "CREDIT_CARD": checksums.valid_card, "IBAN_CODE": checksums.valid_iban}.items():
        rows = key.filter(F.col("type") == kind).select(valid(F.col("value")).alias("ok")).collect()
        assert rows and all(r["ok"] for r in rows), kind


def test_scores_of_the_detectors(scored):
    segments, key, found = scored
    by_type = {r["type"]: r for r in evaluate.recall(evaluate.caught(key, found)).collect()}
    missed = {t: r["recall"] for t, r in by_type.items() if r["n_detect"] and r["recall"] < 1}
    assert missed == {}
    assert by_type[None]["n_suppress"] == by_type[None]["n_suppressed"] == 3 * 40
    assert by_type["SWIFT_BIC"]["n_gap"] == 40 and by_type["SWIFT_BIC"]["n_gap_caught"] == 0
    assert found.filter("locator LIKE 'journals%'").count() == 0
    assert evaluate.precision(key, found).first()["precision"] >= 0.99


def test_partitions_do_not_matter(spark):
    segments, _ = corpus.planted(spark, 100)
    again, _ = corpus.planted(spark, 200)
    assert segments.exceptAll(again).count() == 0 and segments.count() == 100
