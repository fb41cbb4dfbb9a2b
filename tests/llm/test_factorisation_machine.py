from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from shroudspark.llm.factorisation_machine import Features, Machine, Plan, keep_good, score, train, train_on

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 400))]
        good, toxic = rng.random() > 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(("scoundrel", "villain")))
        if not good:
            text = [t.upper() + "!!" for t in text] if rng.random() < 0.5 else [t + "%%%" for t in text]
        rows.append((k, " ".join(text)))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus(900, 1)
    model = train(make_docs(rows), spark.createDataFrame(labels[:600], LABELS))
    got = {r["doc_id"]: r["keep"] for r in score(make_docs(rows[600:]), model).collect()}
    right = sum(got[k] == bool(q and not t) for k, q, t in labels[600:])
    assert right / 300 > 0.95


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = Machine(30, Plan(rank=3), 1)
    machine.b, machine.w = 0.3, rng.normal(size=30).astype(np.float32)
    rows = [[1, 4, 9], [], [0, 2, 3, 5, 29], [7]]
    x = Features(np.array(sum(rows, [])), np.cumsum([0] + [len(r) for r in rows]))
    for got, row in zip(machine.score(x), rows):
        pairs = sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(row) for j in row[:k])
        assert np.isclose(got, 0.3 + sum(machine.w[i] for i in row) + (pairs / len(row) if row else 0), atol=1e-5)


def test_batches_do_not_matter():
    rows, labels = corpus(200, 2)
    texts = pa.array([t for _, t in rows])
    lang = pa.array(["en"] * 200)
    model = train_on(texts, [lang], {"quality": np.array([q for _, q, _ in labels]), "toxic": np.array([t for *_, t in labels])}, ["lang"], Plan())
    whole = model.probabilities(texts, [lang])
    for k in range(0, 200, 37):
        one = model.probabilities(texts.slice(k, 1), [lang.slice(k, 1)])
        assert np.allclose(one["toxic"][0], whole["toxic"][k], atol=1e-5) and np.allclose(one["quality"][0], whole["quality"][k], atol=1e-5)


def test_cases(spark, make_docs):
    rows, labels = corpus(300, 3)
    table = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0), (6, 1, None), labels[7]], LABELS)
    docs = make_docs([*rows, (None, "w1 w2"), (900, None), (901, ""), (902, "w1 " * 200_000), rows[0]])
    got = score(docs, train(docs, table)).collect()
    assert len(got) == 305 and all(0 <= r["p_quality"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in got)
    twice = [(r["p_quality"], r["p_toxic"]) for r in got if r["doc_id"] == 0]
    assert twice[0] == twice[1]
    kept = keep_good(docs, table)
    assert set(docs.columns) <= set(kept.columns)
    none = spark.createDataFrame([], LABELS)
    assert keep_good(docs, none).count() == 305
    assert keep_good(make_docs([]), table).count() == 0 and keep_good(make_docs([]), none).count() == 0
    one_class = spark.createDataFrame([(k, 1, 0) for k, *_ in labels], LABELS)
    assert keep_good(docs, one_class).count() == 305
