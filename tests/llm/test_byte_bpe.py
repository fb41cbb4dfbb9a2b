from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest

from shroudspark.llm import byte_bpe

pytestmark = pytest.mark.skipif(not os.path.exists(byte_bpe.TOKENIZER), reason="no tokenizer file")

ODD = ["", " ", "a" * 3000, "'s 't ''s it's 'sting  x  ", "<|endoftext|> x", "   ", "a   b", "aaaa aaaaaaa aaaaaa", "\r\n\r\n x", "it'll 've !'re", " 　x", "é\U0001f600‮"]


def samples(n):
    rng = random.Random(3)
    signs = "ab cdefé'sstrevmlld  \n\t12٣漢字\U0001f600!?    \u001c'S"
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_ids_are_those_of_the_reference_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(byte_bpe.TOKENIZER)
    reference.encode_special_tokens = True
    texts = samples(2000)
    vocabulary = byte_bpe.load(byte_bpe.TOKENIZER)
    for lo, hi, ids, at in byte_bpe.encode_texts(vocabulary, pa.array(texts)):
        for k, want in enumerate(reference.encode_batch(texts[lo:hi], add_special_tokens=False)):
            assert ids[at[k] : at[k + 1]].tolist() == want.ids


def test_round_trip_and_cases(spark, make_docs):
    texts = samples(200)
    docs = make_docs([*enumerate(texts), (None, "no id"), (0, texts[0]), (999, None)])
    encoded = byte_bpe.encode(docs)
    rows = encoded.collect()
    assert len(rows) == len(texts) + 3
    null = next(r for r in rows if r["doc_id"] == 999)
    assert (null["token_ids"], null["n_tokens"], null["round_trip"]) == (None, None, None)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows if r["doc_id"] != 999)
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(encoded).collect()}
    assert all(back[k] == t for k, t in enumerate(texts)) and back[999] is None
    assert byte_bpe.encode(make_docs([])).count() == 0


def test_very_long_texts_are_encoded_whole(make_docs):
    long = "lorem ipsum, dolor 12 " * 60_000
    (row,) = byte_bpe.encode(make_docs([(1, long)])).collect()
    assert row["round_trip"] and row["n_tokens"] > 60_000


def test_ids_outside_the_vocabulary_are_an_error(spark):
    bad = spark.createDataFrame([([10**6],)], "token_ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(bad).collect()


def test_token_counts_are_those_of_the_ids(make_docs):
    docs = make_docs([*enumerate(samples(50)), (99, None)])
    want = {r["doc_id"]: r["n_tokens"] for r in byte_bpe.encode(docs).collect()}
    assert {r["doc_id"]: r["n"] for r in docs.select("doc_id", byte_bpe.token_count(docs["text"]).alias("n")).collect()} == want


@pytest.mark.parametrize("most", [0, 40, 1 << 21])
def test_what_a_worker_has_met_does_not_matter(monkeypatch, most):
    vocabulary = byte_bpe.load(byte_bpe.TOKENIZER)
    monkeypatch.setattr(byte_bpe, "MOST_KNOWN", most)
    texts = samples(300)
    run = lambda part: [ids[at[k] : at[k + 1]].tolist() for lo, hi, ids, at in byte_bpe.encode_texts(vocabulary, pa.array(part)) for k in range(hi - lo)]
    byte_bpe._known.clear()
    want = [run([t])[0] for t in texts if byte_bpe._known.clear() is None]
    byte_bpe._known.clear()
    got = [ids for lo in range(0, len(texts), 7) for ids in run(texts[lo : lo + 7])]
    assert got == want and run(texts) == want and run(texts) == want
