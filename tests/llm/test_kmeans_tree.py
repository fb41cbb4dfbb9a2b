from __future__ import annotations

import numpy as np
import pytest

from shroudspark.llm.kmeans_tree import Plan, Subtree, Tree, neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v int, cell int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("n", "cell"), [(300, 4096), (900, 150)])
def test_recall_against_brute_force(spark, n, cell):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    x = (centres[rng.integers(12, size=n)] + rng.normal(size=(n, 16))).astype(np.float32)
    found: dict[int, list] = {}
    for r in neighbours(make(spark, [(k, x[k].tolist()) for k in range(n)]), Plan(cell=cell, calibration=100)).collect():
        found.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    assert len(found) == n
    hits = 0
    for k in range(n):
        d = np.sqrt(((x.astype(float) - x[k].astype(float)) ** 2).sum(1))
        d[k] = np.inf
        own = sorted(found[k])
        assert [r for r, *_ in own] == list(range(1, 11)) and k not in [j for _, j, _ in own]
        assert all(abs(d[j] - dist) < 1e-4 for _, j, dist in own)
        hits += sum(dist <= np.sort(d)[9] + 1e-6 for *_, dist in own)
    assert hits / (10 * n) >= 0.9


def test_visiting_every_leaf_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    tree = Subtree(x, np.arange(500), 0, Plan(leaf=20))
    distance, row = tree.search(x[:40], 10_000, 6)
    for k in range(40):
        d = ((x - x[k]) ** 2).sum(1)
        assert tree.ids[row[k]].tolist() == np.argsort(d)[:6].tolist()
        assert np.allclose(distance[k], np.sort(d)[:6])


def test_a_search_finds_the_nearest_of_the_leaves_that_it_visits():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6))
    tree = Subtree(x, np.arange(700), 0, Plan(leaf=16))
    _, row = tree.search(x[:50], 5, 4)
    for k, leaves in enumerate(tree.visits(x[:50], 5)):
        assert len(set(leaves)) == 5
        seen = np.concatenate([np.arange(tree.ends[n], tree.ends[n + 1]) for n in leaves])
        d = ((tree.x[seen] - x[k]) ** 2).sum(1)
        assert row[k].tolist() == seen[np.argsort(d)[:4]].tolist()
        assert tree.leaf_rank(x[k], int(tree.ids[seen[-1]])) == 5


def test_fewer_vectors_than_neighbours():
    tree = Subtree(np.eye(3), np.arange(3), 0, Plan())
    distance, row = tree.search(np.eye(3)[:1], 9, 5)
    assert sorted(row[0].tolist()) == [-1, -1, 0, 1, 2] and np.isinf(distance[0, 3:]).all()


def test_best_bin_first_takes_the_nearest_open_node():
    tree = Tree(np.zeros(1))
    a, b = tree.add(0, np.zeros(1)), tree.add(0, np.zeros(1))
    a1, a2 = tree.add(a, np.zeros(1)), tree.add(a, np.zeros(1))
    distance = [0.0] * 5
    distance[a], distance[b], distance[a1], distance[a2] = 1.0, 2.0, 1.5, 3.0
    assert tree.order(lambda node: [distance[c] for c in tree.children[node]], 3) == [a1, b, a2]


def test_routing_goes_down_the_nearest_means():
    rng = np.random.default_rng(4)
    tree = Tree(np.zeros(3))
    for _ in range(3):
        tree.add(0, rng.normal(size=3))
    for _ in range(4):
        tree.add(2, rng.normal(size=3))
    x = rng.normal(size=(200, 3))
    for q, leaf in zip(x, tree.route(x).tolist()):
        node = 0
        while tree.children[node]:
            node = min(tree.children[node], key=lambda c: ((tree.means[c] - q) ** 2).sum())
        assert node == leaf
        assert len(tree.visit(q, 100)) == 6


def test_cases(spark):
    good = [(k, [float(k), 0.0]) for k in range(4)]
    odd = [(None, [0.0, 0.0]), (10, None), (11, [1.0]), (12, [float("nan"), 0.0]), (13, [None, 1.0]), (14, [float("inf"), 0.0]), (15, [])]
    rows = [tuple(r) for r in neighbours(make(spark, good + odd + [(0, [0.0, 0.0])])).orderBy("vec_id", "rank").collect()]
    assert rows[:3] == [(0, 1, 1, 1.0), (0, 2, 2, 2.0), (0, 3, 3, 3.0)]
    assert rows[3:6] == [(1, 1, 0, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 2.0)]
    assert len(rows) == 12
    assert neighbours(make(spark, [])).count() == 0
    assert neighbours(make(spark, [(1, [1.0])])).count() == 0


def test_equal_vectors(spark):
    rows = neighbours(make(spark, [(k, [1.0, 2.0]) for k in range(300)]), Plan(cell=64)).collect()
    assert len(rows) == 3000 and all(r["distance"] == 0 for r in rows)


def brute(rows, k, every):
    """(query, rank, neighbour) by comparing all."""
    out = []
    for i, q in rows:
        if i % every == 0:
            near = sorted((float(((np.array(q) - np.array(v)) ** 2).sum()), j) for j, v in rows if j != i)
            out += [(i, r + 1, j) for r, (_, j) in enumerate(near[:k])]
    return sorted(out)


def test_queries_by_divisor_shards_and_copies_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.integers(-9, 9, size=4).astype(float).tolist()) for k in range(250)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(250, 400)]  # a hot vector
    rows += [(k, [0.0 if k % 2 else -0.0, 0.0, 1.0, 1.0]) for k in range(400, 420)]
    plan = Plan(k=5, cell=40, shard=16, leaf=8, recall=1.0, calibration=1000, hot=3)
    found = neighbours(make(spark, rows), plan, every=20)
    assert sorted((r["vec_id"], r["rank"], r["neighbour"]) for r in found.collect()) == brute(rows, 5, 20)


def test_ids_that_are_no_integers_are_left_out_and_tables_without_queries_are_empty(spark):
    table = spark.createDataFrame([("1", [1.0]), ("x", [1.0]), ("3", [2.0])], "vec_id string, embedding array<float>")
    assert sorted((r["vec_id"], r["neighbour"]) for r in neighbours(table).collect()) == [(1, 3), (3, 1)]
    assert neighbours(table, every=20).count() == 0
