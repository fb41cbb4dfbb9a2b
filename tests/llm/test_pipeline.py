from __future__ import annotations

import os
import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shroudspark.llm import byte_bpe, queries
from shroudspark.llm._align import similarity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(byte_bpe.TOKENIZER)), reason="no test tables")


def test_stages_chain_and_keep_what_is_clean(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = {r["doc_id"]: r["text"] for r in docs.collect()}, docs.columns
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            rows = docs.collect()
            assert len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert left == sorted(left, reverse=True) and left[-1] > 0.4 * len(before)
    assert docs.filter("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.exceptAll(docs).count() == 0 and docs.exceptAll(whole).count() == 0


def test_registered_names():
    numbers = {name.split("_")[0] for name in queries.QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.select(*names).collect()) == sorted(want.fetchall())


def tables(spark, folder, documents, labels, benchmark):
    kinds = {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, hash int, spans array<int>",
        "labels": "doc_id bigint, quality int, toxic int",
        "benchmark": "item_id bigint, text string",
    }
    for name, rows in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        spark.createDataFrame(rows, kinds[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), 1, [2])


def naive(documents, benchmark):
    """The pipeline without labels: every document is kept by the classifier, then plain loops."""
    lines = {}
    for i, text, *_ in documents:
        for line in (text or "").split("\n"):
            if line.strip():
                lines.setdefault(" ".join(line.lower().split()), set()).add(i)
    cut = []
    for i, text, *_ in documents:
        if text is None:
            cut.append((i, None))
            continue
        norm = lambda line: " ".join(line.lower().split())
        bad = [norm(x) != "" and len(lines[norm(x)]) > 10 and i != min(lines[norm(x)]) for x in text.split("\n")]
        kept = "\n".join(x for x, b in zip(text.split("\n"), bad) if not b)
        if not any(bad) or kept.strip(" "):
            cut.append((i, kept))
    words = lambda t: re.findall(r"\w+", t.lower())
    near, seen = [], set()
    for i, text in sorted(cut, key=lambda r: (r[0] is None, r[0] or 0)):
        if (i, text) in seen:
            continue
        seen.add((i, text))
        own = words(text or "")
        if i is not None and own and any(j is not None and words(t or "") and similarity(own, words(t), 0.8) > 0 for j, t in near if j is not None):
            continue
        near.append((i, text))
    out = []
    for i, text in near:
        for item in benchmark:
            if text is not None and item in text:
                share = len(words(item)) / len(words(text))
                text = None if share > 0.5 else text.replace(item, "")
                if text is None:
                    break
        else:
            out.append((i, text))
    return out


def test_the_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    own = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [own(20) for _ in range(3)]
    header = "Shared  header of all"
    documents = [doc(k, "\n".join([header if k < 14 else own(3), own(30), own(25)])) for k in range(30)]
    documents += [doc(40 + k, documents[5 + k][1] if k % 2 else documents[5 + k][1] + " tail") for k in range(6)]
    documents += [doc(50 + k, f"{own(15)} {items[k]} {own(30)}") for k in range(3)] + [doc(60, f"so {items[0]} it")]
    documents += [doc(70, None), doc(71, ""), doc(72, "   "), doc(73, "?!"), doc(None, own(12)), doc(None, None), doc(74, own(9)), doc(74, None)]
    documents += [documents[0], documents[-2], doc(80, own(6000))]
    sf = tables(spark, tmp_path, documents, [], [*enumerate(items), (9, None), (None, "x"), (8, "")])
    rows = corpus_pipeline.run(spark, sf).collect()
    want = naive(documents, items)
    assert sorted((str(r["doc_id"]), r["n_tokens"] is None) for r in rows) == sorted((str(i), t is None) for i, t in want)
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(byte_bpe.TOKENIZER)
    ids = lambda t: None if t is None else model.encode(t, add_special_tokens=False).ids
    assert sorted((str(r["doc_id"]), str(r["token_ids"])) for r in rows) == sorted((str(i), str(ids(t))) for i, t in want)


def test_empty_tables_and_labels_that_reject(spark, tmp_path):
    sf = tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    docs = [doc(k, f"document number {k} of its kind has words of its own {k * 7919}") for k in range(6)]
    sf = tables(spark, tmp_path / "all", docs, [(k, 0, 1) for k in range(6)], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    sf = tables(spark, tmp_path / "good", docs, [(k, 1, 0) for k in range(6)] + [(None, 1, 0), (3, None, 0)], [(1, None)])
    assert corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count() == 6
