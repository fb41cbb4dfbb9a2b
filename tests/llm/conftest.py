from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with more columns than operators need, of names they might use."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 0.5, ["y"]) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", id string, hash int, score double, spans array<string>")

    return make
