from __future__ import annotations

import random

import pyarrow as pa
import pytest

from shroudspark.llm.decontaminate import Automaton, Limits, contaminated, decontaminate, find_spans
from shroudspark.llm._words import words_of

ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."
ITEMS = "item_id bigint, text string"


def brute(doc, items, limits):
    """Longest match that ends at each word, by comparing with every place of every item."""
    best = []
    for end in range(1, len(doc) + 1):
        length, owners = 0, []
        for number, item in items:
            for at in range(len(item)):
                n = 0
                while n <= at and n < end and item[at - n] == doc[end - 1 - n]:
                    n += 1
                if n > length:
                    length, owners = n, [(len(item), number)]
                elif n == length and n:
                    owners.append((len(item), number))
        best.append((length, min(owners) if owners else None))
    spans = []
    for k, (length, owner) in enumerate(best):
        ends_here = k + 1 == len(best) or best[k + 1][0] != length + 1
        if length and ends_here and (length >= limits.length or (length >= limits.least and length >= limits.coverage * owner[0])):
            spans.append((k + 1 - length, k + 1))
    merged = []
    for a, b in sorted(spans):
        if merged and a - merged[-1][1] <= limits.gap:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcde")
    limits = Limits(length=5, least=3, coverage=0.7, gap=1)
    items = [(k, [word() for _ in range(rng.randrange(1, 9))]) for k in range(6)]
    hashed = [(k, words_of(pa.array([" ".join(w)])).hashes.tolist()) for k, w in items]
    automaton = Automaton(hashed)
    docs = [[word() for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    words = words_of(pa.array([" ".join(d) for d in docs]))
    found = find_spans(words, automaton, limits)
    for k, doc in enumerate(docs):
        assert [s[:2] for s in found.get(k, [])] == brute(doc, items, limits)


def test_spans_are_cut_and_mostly_copied_documents_go(spark, make_docs):
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (7, ITEM)], ITEMS)
    filler = " ".join(f"w{k}" for k in range(30))
    docs = make_docs([(1, f"{filler} {ITEM.upper()} {filler}"), (2, f"a {ITEM}"), (3, filler), (4, None), (5, ""), (None, f"{filler} {ITEM}")])
    rows = {r["doc_id"]: r for r in contaminated(docs, items).collect()}
    assert set(rows) == {1, 2, None}
    span = rows[1]["spans"][0]
    text = f"{filler} {ITEM.upper()} {filler}"
    assert text[span["start"] : span["end"]] == ITEM.upper().removesuffix(".") and span["item_id"] == 7 and span["words"] == 14
    assert rows[2]["dropped"] and rows[2]["clean_text"] is None and not rows[1]["dropped"]
    out = {r["doc_id"]: r for r in decontaminate(docs, items).collect()}
    assert set(out) == {1, 3, 4, 5, None}
    assert out[1]["text"] == rows[1]["clean_text"] == f"{filler} . {filler}" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[3]["text"] == filler and out[4]["text"] is None and out[5]["text"] == ""
    assert decontaminate(docs, items).columns == docs.columns


def test_a_changed_word_does_not_split_a_copy(spark, make_docs):
    long = " ".join(f"q{k}" for k in range(40))
    items = spark.createDataFrame([(1, long)], ITEMS)
    doc = " ".join(f"x{k}" for k in range(60)) + " " + long.replace("q20", "changed")
    (row,) = contaminated(make_docs([(1, doc)]), items).collect()
    assert len(row["spans"]) == 1 and row["spans"][0]["words"] == 20


def test_benchmarks_in_lots_give_the_same(spark, make_docs):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(20)], ITEMS)
    docs = make_docs([(k, " ".join(f"z{j}" for j in range(40)) + " " + " ".join(f"i{k}w{j}" for j in range(15))) for k in range(20)])
    whole = {r["doc_id"]: r["spans"] for r in contaminated(docs, items).collect()}
    lots = {r["doc_id"]: r["spans"] for r in contaminated(docs, items, most_bytes=200).collect()}
    assert whole == lots and len(whole) == 20


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    docs = make_docs([(1, ITEM)])
    assert contaminated(docs, none).count() == 0 and decontaminate(docs, none).count() == 1
    assert contaminated(make_docs([]), none).count() == 0


def test_lots_are_merged_before_texts_are_cut(spark, make_docs):
    rng = random.Random(3)
    passage = " ".join(f"p{j}" for j in range(14))
    texts = [" ".join(f"i{k}w{j}" for j in range(15)) for k in range(12)]
    texts += [f"{passage} one tail of its own", f"other words in front {passage}"]
    items = spark.createDataFrame(list(enumerate(texts)), ITEMS)
    docs = []
    for k in range(30):
        parts = rng.sample(texts[:12], 3) + ([passage] if k % 2 else [])
        rng.shuffle(parts)
        docs.append((k, " ".join(f"{part} " + " ".join(f"z{k}x{n}y{j}" for j in range(30 + k % 3)) for n, part in enumerate(parts))))
    docs += [(100, passage + " " + " ".join(f"z{j}" for j in range(30)))]
    table = make_docs(docs)
    whole = {r["doc_id"]: r for r in contaminated(table, items).collect()}
    lots = {r["doc_id"]: r for r in contaminated(table, items, most_bytes=150).collect()}
    assert whole == lots and len(whole) == 31
    assert not lots[100]["dropped"] and lots[100]["share"] == round(14 / 44, 6)
    assert not any(f"i{k}w0 " in r["clean_text"] for k in range(12) for r in lots.values() if r["clean_text"])


def each_item(doc, items, limits):
    """Spans by trying every item by itself: at each word the longest match with the item."""
    inside = []
    for _, item in items:
        for end in range(1, len(doc) + 1):
            length = 0
            for at in range(len(item)):
                n = 0
                while n <= at and n < end and item[at - n] == doc[end - 1 - n]:
                    n += 1
                length = max(length, n)
            if length >= limits.length or (length >= limits.least and length >= limits.coverage * len(item)):
                inside.append((end - length, end))
    merged = []
    for a, b in sorted(inside):
        if merged and a - merged[-1][1] <= limits.gap:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _hashed(text):
    return words_of(pa.array([text])).hashes.tolist()


def test_a_short_item_is_found_inside_a_longer_one():
    short = " ".join(f"s{k}" for k in range(8))
    long = " ".join(f"l{k}" for k in range(45)) + f" m {short} n " + " ".join(f"r{k}" for k in range(45))
    words = words_of(pa.array([f"some text m {short} n and more", f"some text {short} and more"]))
    found = find_spans(words, Automaton([(1, _hashed(short)), (2, _hashed(long))]), Limits(), by_item=True)
    assert found == {0: [(3, 11, 1, 8, 1.0)], 1: [(2, 10, 1, 8, 1.0)]}


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_brute_force_by_item(seed):
    rng = random.Random(seed + 50)
    limits = Limits(length=7, least=3, coverage=0.7, gap=1)
    base = [rng.choice("abcde") for _ in range(40)]
    items = []
    for k in range(14):
        at = rng.randrange(36)
        items.append((k, base[at : at + rng.choice((3, 4, 5, 12, 30))]))
    docs = []
    for _ in range(60):
        at = rng.randrange(36)
        docs.append([rng.choice("abcdexyz") for _ in range(10)] + base[at : at + rng.randrange(2, 9)] + [rng.choice("abcdexyz") for _ in range(10)])
    words = words_of(pa.array([" ".join(d) for d in docs]))
    hashed = [(k, _hashed(" ".join(w))) for k, w in items]
    whole = find_spans(words, Automaton(hashed), limits, by_item=True)
    assert whole == find_spans(words, [Automaton(hashed[:5]), Automaton(hashed[5:9]), Automaton(hashed[9:])], limits, by_item=True)
    for k, doc in enumerate(docs):
        assert [s[:2] for s in whole.get(k, [])] == each_item(doc, items, limits)


def test_the_operator_tries_every_item(spark, make_docs):
    short = " ".join(f"s{k}" for k in range(8))
    long = " ".join(f"l{k}" for k in range(45)) + f" m {short} n " + " ".join(f"r{k}" for k in range(45))
    filler = " ".join(f"z{k}" for k in range(30))
    items = spark.createDataFrame([(1, short), (2, long)], ITEMS)
    (row,) = contaminated(make_docs([(1, f"{filler} m {short} {filler}")]), items).collect()
    assert [(s["item_id"], s["words"], s["coverage"]) for s in row["spans"]] == [(1, 8, 1.0)]


@pytest.mark.parametrize("at_once", [1, 2, 16])
def test_passes_over_lots_give_what_one_automaton_gives(spark, make_docs, at_once):
    """Items that overlap, documents with several spans out of the lots' order, and passages of items of two lots."""
    rng = random.Random(11)
    own = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [own(rng.randrange(8, 30)) for _ in range(9)]
    items += [items[0][:10] + own(20), own(12) + items[3], items[5]]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], ITEMS)
    texts = []
    for k in range(40):
        words = own(40)
        for _ in range(rng.randrange(0, 4)):
            words += rng.choice(items) + own(rng.randrange(0, 30))
        texts.append((k, " ".join(words)))
    docs = make_docs([*texts, (None, texts[0][1]), (98, None), (99, "")])
    rows = lambda df: sorted(map(str, df.collect()))
    want, kept = rows(contaminated(docs, table)), rows(decontaminate(docs, table))
    assert len(want) > 20
    assert rows(contaminated(docs, table, most_bytes=400, at_once=at_once)) == want
    assert rows(decontaminate(docs, table, most_bytes=400, at_once=at_once)) == kept
