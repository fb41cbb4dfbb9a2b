from __future__ import annotations

from shroudspark.llm.line_dedup import dedup_lines


def texts(df):
    return {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in df.collect()}


def test_shared_lines_go_everywhere(make_docs):
    docs = make_docs([(1, "Same  line\nown one"), (2, "same line\nown two\n\n"), (3, "SAME LINE"), (4, None), (5, "")])
    out = dedup_lines(docs, max_docs=2)
    assert texts(out) == {(1, "own one"): (2, 1), (2, "own two\n\n"): (4, 1), (3, ""): (1, 1), (4, None): (0, 0), (5, ""): (1, 0)}
    assert set(docs.columns) <= set(out.columns)
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()} == {1: 7, 2: 9, 3: 0, 4: None, 5: 0}


def test_the_first_document_may_keep_them(make_docs):
    docs = make_docs([(9, "a\nb"), (2, "a\nc"), (5, "a")])
    assert texts(dedup_lines(docs, max_docs=2, keep_first=True)) == {(9, "b"): (2, 1), (2, "a\nc"): (2, 0), (5, ""): (1, 1)}


def test_repeats_within_a_document_count_once(make_docs):
    docs = make_docs([(1, "a\na\na"), (1, "a\na\na"), (2, "a")])
    out = dedup_lines(docs, max_docs=2)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "a\na\na"), (1, "a\na\na"), (2, "a")]


def test_null_ids_are_one_document(make_docs):
    docs = make_docs([(None, "a\nb"), (None, "a\nc"), (1, "a")])
    assert {t for _, t in texts(dedup_lines(docs, max_docs=1))} == {"b", "c", ""}
    assert {t for _, t in texts(dedup_lines(docs, max_docs=2))} == {"a\nb", "a\nc", "a"}


def test_empty_tables_and_very_long_texts(make_docs):
    assert dedup_lines(make_docs([])).count() == 0
    long = "\n".join(f"line {k}" for k in range(20_000)) + "\nshared"
    out = texts(dedup_lines(make_docs([(1, long), (2, "shared")]), max_docs=1))
    assert out == {(1, long.removesuffix("\nshared")): (20_001, 1), (2, ""): (1, 1)}


def test_markup_and_signs_survive(make_docs):
    text = "tab\there\r\n$1 \\n {x}\né漢\U0001f600"
    assert texts(dedup_lines(make_docs([(1, text)]))) == {(1, text): (3, 0)}


def test_hot_lines_are_joined_apart_with_equal_results(make_docs, monkeypatch):
    from shroudspark.llm import line_dedup

    docs = make_docs([(k, f"own {k}\nhot\n" + ("warm\n" if k % 3 == 0 else "") + ("cold" if k < 2 else "")) for k in range(30)])
    want = texts(dedup_lines(docs, max_docs=3, keep_first=True))
    monkeypatch.setattr(line_dedup, "HOT", 2)  # of the two shared lines one is hot
    assert texts(dedup_lines(docs, max_docs=3, keep_first=True)) == want
    assert want[(0, "own 0\nhot\nwarm\ncold")] == (4, 0) and want[(1, "own 1\ncold")] == (3, 1) and len(want) == 30
