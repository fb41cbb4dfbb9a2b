from __future__ import annotations

import random

import pyarrow as pa
import pytest

from shroudspark.llm._align import edit_distance
from shroudspark.llm._words import words_of
from shroudspark.llm.components import components
from shroudspark.llm.order_minhash import Plan, drop_duplicates, duplicates, sketch


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randrange(4) for _ in range(rng.randrange(12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(12))]
        want = slow_distance(a, b)
        for most in (0, 1, 3, 6, 12):
            assert edit_distance(a, b, most) == min(want, most + 1) or (want > most and edit_distance(a, b, most) > most)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 120)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {v: find(v) for v in root if find(v) != v}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


def test_groups_equal_brute_force(make_docs):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.choice((0, 1, 3, len(base) // 12, len(base) // 2))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    words = [t.split() for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            longer = max(len(words[a]), len(words[b]))
            if slow_distance(words[a], words[b]) <= 0.2 * longer:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {v: find(v) for v in range(len(texts)) if find(v) != v}
    got = {r["doc_id"]: r["duplicate_of"] for r in duplicates(make_docs(list(enumerate(texts)))).collect()}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.95 * len(want)
    assert all(find(k) == find(v) for k, v in got.items())


def test_word_order_matters(make_docs):
    words = [f"w{k}" for k in range(60)]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(reversed(words)))])
    assert duplicates(docs).count() == 0


def test_cases(spark, make_docs):
    text = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"v{k % 977}x{k}" for k in range(30_000))
    rows = [(3, text), (1, text.upper()), (2, text + " more"), (2, text + " more"), (4, None), (5, ""), (6, " .!"), (None, text), (7, long), (8, long.replace("v5x", "other")), (9, "one"), (10, "one")]
    docs = make_docs(rows)
    got = {r["doc_id"]: (r["duplicate_of"], r["exact"]) for r in duplicates(docs).collect()}
    assert got == {2: (1, False), 3: (1, True), 8: (7, False), 10: (9, True)}
    kept = drop_duplicates(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 9, None], key=str)
    assert kept.columns == docs.columns
    assert duplicates(make_docs([])).count() == 0 and drop_duplicates(make_docs([])).count() == 0


def test_many_copies_of_one_document(make_docs):
    rng = random.Random(1)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    rows = []
    for k in range(400):
        own = list(base)
        for _ in range(k % 5):
            own[rng.randrange(60)] = f"n{rng.randrange(1000)}"
        rows.append((k, " ".join(own)))
    got = duplicates(make_docs(rows), Plan(salt=50)).collect()
    assert len(got) == 399 and {r["duplicate_of"] for r in got} == {0}


def _pairs(rng, n, words, similarity, deleted):
    """Texts 2k and 2k + 1 are a pair of that similarity and like no other text."""
    texts = []
    for k in range(n):
        base = [f"p{k}w{j}" for j in range(words)]
        at = set(rng.sample(range(words), int(words * (1 - similarity) + 1e-6)))
        texts += [" ".join(base), " ".join("" if deleted and j in at else f"p{k}x{j}" if j in at else w for j, w in enumerate(base))]
    return texts


@pytest.mark.parametrize("similarity", (0.8, 0.82, 0.85, 0.9))
@pytest.mark.parametrize("deleted", (False, True))
def test_isolated_pairs_become_candidates(similarity, deleted):
    for words in (40, 200):
        tuples = sketch(words_of(pa.array(_pairs(random.Random(words), 300, words, similarity, deleted))), Plan())
        assert (tuples[::2] == tuples[1::2]).any(1).mean() >= 0.94


def test_recall_of_isolated_pairs(make_docs):
    rng = random.Random(8)
    texts = [t for similarity in (0.8, 0.83, 0.86, 0.9) for t in _pairs(rng, 40, 60, similarity, False)]
    texts = [t.replace("p", f"q{k // 80}p") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["duplicate_of"] for r in duplicates(make_docs(list(enumerate(texts)))).collect()}
    assert all(k == v + 1 and v % 2 == 0 for k, v in got.items())
    assert len(got) >= 0.95 * len(texts) / 2


def test_positions_beyond_the_usual_bits_are_kept(monkeypatch):
    from shroudspark.llm import order_minhash

    long, short = " ".join(f"a{k * k % 97} b{k}" for k in range(40)), "one two three four"
    whole = sketch(words_of(pa.array([long, short])), Plan())
    monkeypatch.setattr(order_minhash, "_PLACES", 5)
    mixed = sketch(words_of(pa.array([long, short])), Plan())
    apart = [sketch(words_of(pa.array([t])), Plan())[0].tolist() for t in (long, short)]
    assert mixed.tolist() == apart
    assert mixed[0].tolist() == whole[0].tolist()  # all positions count, and hashes differ in their upper bits


def test_components_that_share_tuples_are_still_joined(make_docs):
    """Chains: each text is near its neighbours and far from the ends, beside a large group of copies of one end."""
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(500)}" for _ in range(60)]]
    for _ in range(12):
        own = list(texts[-1])
        for _ in range(5):
            own[rng.randrange(60)] = f"n{rng.randrange(500)}"
        texts.append(own)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(100 + k, " ".join(texts[o])) for k, o in enumerate(order)] + [(k, " ".join([*texts[-1][:-1], f"t{k}"])) for k in range(40)]
    got = {r["doc_id"]: r["duplicate_of"] for r in duplicates(make_docs(rows)).collect()}
    assert got == {i: 0 for i, _ in rows if i}


def test_of_repeated_rows_the_least_stays_whatever_the_order(spark):
    rows = [(1, "a b c d", k, [k]) for k in (3, 1, 2)] + [(None, "x y z", 5, None), (None, "x y z", 4, [1])]
    kind = "doc_id bigint, text string, rank int, `odd.name` array<int>"
    want = {(1, "a b c d", 1, (1,)), (None, "x y z", 4, (1,))}
    for some in (rows, rows[::-1]):
        kept = drop_duplicates(spark.createDataFrame(some, kind).repartition(3)).collect()
        assert {(*r[:3], tuple(r[3])) for r in kept} == want
