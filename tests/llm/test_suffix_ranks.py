from __future__ import annotations

import random

import pyarrow as pa
import pytest

from shroudspark.llm.suffix_ranks import Plan, _across, _ranked_rows, cut_repeats, repeats


def brute(texts, size):
    seen = {}
    words = {k: t.split() for k, t in texts}
    for k, w in words.items():
        for p in range(len(w) - size + 1):
            seen.setdefault(tuple(w[p : p + size]), []).append((k, p))
    marks = {}
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                marks.setdefault(k, set()).update(range(p, p + size))
    out = {}
    for k, positions in marks.items():
        spans = []
        for p in sorted(positions):
            if spans and p == spans[-1][1]:
                spans[-1] = (spans[-1][0], p + 1)
            else:
                spans.append((p, p + 1))
        out[k] = spans
    return out


@pytest.mark.parametrize(("seed", "size", "letters"), [(0, 5, 6), (1, 8, 3), (2, 13, 2), (3, 3, 40), (4, 2, 200), (5, 1, 900)])
def test_spans_equal_brute_force(make_docs, seed, size, letters):
    rng = random.Random(seed)
    texts = [(k, " ".join(f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 70)))) for k in range(25)]
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, texts[4][1] + " " + texts[5][1])]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats(make_docs(texts), Plan(words=size)).collect()}
    assert got == brute(texts, size)


def test_cutting_leaves_each_passage_once(make_docs):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(100_000)}"
    shared = " ".join(word() for _ in range(60))
    texts = [(k, " ".join([*(word() for _ in range(30)), shared, *(word() for _ in range(30))])) for k in range(6)]
    docs = make_docs(texts)
    assert repeats(docs).count() == 6
    out = cut_repeats(docs)
    assert out.columns == docs.columns
    kept = [r["text"] for r in out.collect()]
    assert sum(shared in t for t in kept) == 1 and repeats(out).count() == 0


def test_cases(make_docs):
    text = " ".join(f"w{k}" for k in range(55))
    long = " ".join(f"v{k}" for k in range(25_000))
    docs = make_docs([(1, text), (2, text.upper()), (None, text), (3, None), (4, ""), (5, "short"), (6, long), (7, "x " + long), (8, text), (8, text)])
    rows = repeats(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, None, 6, 7, 8}
    assert len(rows) == 7
    assert all(r["spans"][0]["end"] - r["spans"][0]["start"] in (55, 25_000) for r in rows)
    assert sum(len(r["extra"]) == 0 for r in rows) == 2
    assert repeats(make_docs([])).count() == 0 and cut_repeats(make_docs([])).count() == 0
    junk = make_docs([(1, "la " * 300), (2, "solo")])
    (row,) = repeats(junk).collect()
    assert (row["doc_id"], row["spans"][0]["start"], row["spans"][0]["end"]) == (1, 0, 300)


def test_prefixes_double_until_they_are_as_long_as_a_passage():
    assert Plan().sizes == [13, 26, 50] and Plan(words=8).sizes == [2, 4, 8] and Plan(words=1).sizes == [1]


@pytest.mark.parametrize("seed", range(6))
def test_ranks_across_partitions_are_those_of_one(seed):
    """Sorted rows cut anywhere, also within one pair, and in batches of any size."""
    rng = random.Random(seed)
    rows = sorted((rng.randrange(4) if seed % 2 else 7, rng.randrange(rng.choice((1, 12))), num, pos) for num in range(8) for pos in range(rng.randrange(1, 9)))
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randrange(9)))})
    got, ends = [], []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batches, at = [], a
        while at < b:
            to = min(b, at + rng.randrange(0, 4))
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at:to]], pa.int64()) for c in range(4)], names=["left", "right", "num", "pos"]))
            at = to
        for batch in _ranked_rows(part, iter(batches)):
            for r in batch.to_pylist():
                if r["pos"] < 0:
                    ends.append((r["rank"], r["left"], r["right"], r["num"]))
                else:
                    got.append((r["rank"], r["num"], r["pos"], r["first"]))
    moved = dict(_across(ends))
    got = [(moved.get(rank, rank), num, pos, first and rank not in moved) for rank, num, pos, first in got if moved.get(rank, 0) is not None]
    pairs = {}
    for left, right, num, pos in rows:
        pairs.setdefault((left, right), []).append((num, pos))
    want = {tuple(places) for places in pairs.values() if len(places) > 1}
    by_rank = {}
    for rank, num, pos, first in got:
        by_rank.setdefault(rank, []).append((num, pos, first))
    assert {tuple((num, pos) for num, pos, _ in places) for places in by_rank.values()} == want
    assert all([first for *_, first in places] == [True] + [False] * (len(places) - 1) for places in by_rank.values())


def test_a_passage_in_a_third_of_all_texts(make_docs, monkeypatch):
    """More hot keys than none, so that both ways of joining are taken."""
    from shroudspark.llm import suffix_ranks

    monkeypatch.setattr(suffix_ranks, "HOT", 9)
    rng = random.Random(4)
    own = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    hot, copy = own(12), " ".join(own(30))
    texts = [(k, " ".join([*own(9), *hot, *own(9)]) if k % 3 == 0 else " ".join(own(20))) for k in range(60)]
    texts += [(k, copy) for k in range(60, 90)] + [(90, " ".join([*texts[1][1].split(), *own(5)]))]
    rows = repeats(make_docs(texts), Plan(words=8)).collect()
    assert {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows} == brute(texts, 8)
    assert len(rows) == 20 + 30 + 2
