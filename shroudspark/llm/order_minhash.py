"""Near-duplicate documents by Order MinHash, verified by banded alignment.

An Order MinHash sketch (Marcais, DeBlasio, Pandey and Kingsford, 2019) element is the
tuple, in text order, of the several occurrence-labelled k-mers that are least under a
random hash.  Equal tuples mean that much the same k-mers stand in the same order, so
the chance of a match follows edit similarity and not set overlap alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudspark.llm._align import similarity
from shroudspark.llm._common import bounded_batches, drop_table, map_arrow, materialise
from shroudspark.llm._words import Words, chunks, mix64, window_hashes, words_of
from shroudspark.llm.components import components


class Plan(NamedTuple):
    """Parameters; the defaults are the production values."""

    k: int = 3  # words in a k-mer
    sampled: int = 2  # least k-mers in a tuple; 24 tuples of 3 left out 4 of 10 isolated pairs of similarity 0.8
    tuples: int = 32  # tuples in a sketch
    least: float = 0.8  # edit similarity, in words, of a near-duplicate
    salt: int = 512  # documents compared with one leader in one group of rows


_PLACES = 24  # bits of a position in a text; rows with more k-mers have twice as many


def _labelled(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of all rows, and rows + 1 offsets into them.

    A row of fewer than k words, but at least one, has its whole text as one k-mer.
    """
    n = np.diff(words.first)
    number = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(number)))
    if first[-1] == 0:
        return np.zeros(0, dtype=np.uint64), first
    row = np.repeat(np.arange(len(n)), number)
    at = np.arange(first[-1]) - first[row] + words.first[row]
    short = n[row] < k
    whole = window_hashes(words.hashes, k)
    mers = np.zeros(first[-1], dtype=np.uint64)
    mers[~short] = whole[at[~short]]
    for r in np.flatnonzero((n < k) & (n > 0)):
        mers[first[r]] = window_hashes(words.hashes[words.first[r] : words.first[r + 1]], int(n[r]))[0]
    order = np.lexsort((mers, row))
    changed = np.ones(len(mers), dtype=bool)
    changed[1:] = (mers[order][1:] != mers[order][:-1]) | (row[order][1:] != row[order][:-1])
    begin = np.maximum.accumulate(np.where(changed, np.arange(len(mers)), 0))
    occurrence = np.empty(len(mers), dtype=np.uint64)
    occurrence[order] = (np.arange(len(mers)) - begin).astype(np.uint64)
    return mix64(mers ^ (occurrence * np.uint64(0xD6E8FEB86659FD93))), first


def sketch(words: Words, plan: Plan) -> np.ndarray:
    """(rows, tuples) of uint64; rows without words are zero."""
    mers, first = _labelled(words, plan.k)
    rows = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, plan.tuples), dtype=np.uint64)
    if not len(rows):
        return out
    begin = first[rows]
    number = np.diff(first)[rows]
    owner = np.repeat(np.arange(len(rows)), number)
    position = (np.arange(len(mers)) - begin[owner]).astype(np.uint64)
    low = np.where(number < 1 << _PLACES, np.uint64((1 << _PLACES) - 1), np.uint64((1 << 2 * _PLACES) - 1))  # by row, so what rows are together can't matter
    high = ~low[owner] if number.max() >= 1 << _PLACES else ~low[0]
    taken = min(plan.sampled, int(number.max()))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(plan.tuples):
        odd = mix64(np.array([t * 2 + 1], dtype=np.uint64))[0] | np.uint64(1)
        # The k-mer's hash above, its position below: a minimum tells where it stands.
        value = ((mers * odd) & high) | position
        picked = np.full((len(rows), taken), none, dtype=np.uint64)
        for s in range(taken):
            least = np.minimum.reduceat(value, begin)
            live = least != none
            picked[live, s] = least[live] & low[live]
            value[begin[live] + (least[live] & low[live]).astype(np.int64)] = none
        picked.sort(axis=1)  # text order
        signature = np.full(len(rows), np.uint64(t + 1), dtype=np.uint64)
        for s in range(taken):
            live = picked[:, s] != none
            labels = mers[begin[live] + picked[live, s].astype(np.int64)]
            signature[live] = mix64(signature[live] * np.uint64(0x9E3779B97F4A7C15) + labels)
        out[rows, t] = signature
    return out


def _fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's word sequence."""
    running = [np.concatenate(([np.uint64(0)], np.cumsum(mix64(words.hashes + np.uint64(c)) * mix64(_ordinal(words) * np.uint64(2 * c + 1))))) for c in (1, 2)]
    n = np.diff(words.first).astype(np.uint64)
    return tuple(mix64(r[words.first[1:]] - r[words.first[:-1]] + n) for r in running)  # type: ignore[return-value]


def _ordinal(words: Words) -> np.ndarray:
    return (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], np.diff(words.first)) + 1).astype(np.uint64)


def _sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """(id, n words, two fingerprints, sketch) of every document with an id and a word."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        texts = batch.column(1)
        for lo, hi in chunks(texts):
            words = words_of(texts.slice(lo, hi - lo))
            n = np.diff(words.first)
            parts.append((n, *_fingerprints(words), sketch(words, plan)))
        n, f1, f2, tuples = (np.concatenate(x) for x in zip(*parts))
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * plan.tuples)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n.astype(np.int32)),
                pa.array(f1.view(np.int64)),
                pa.array(f2.view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(tuples.reshape(-1).view(np.int64))),
            ],
            names=["id", "n", "f1", "f2", "tuples"],
        )

    out = map_arrow(docs, one, "id bigint, n int, f1 bigint, f2 bigint, tuples array<bigint>")
    return out.filter("n > 0 and id is not null")


def _verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that alignment confirms, with their similarity.

    Rows are laid out as one leader b and then its members a, at most about
    ``plan.salt`` of them, so a task holds one text besides the one it reads.  Where
    one id has several texts the last of them leads, and any of them may be a member.
    """
    crowd = pairs.groupBy("b").agg(F.count("*").alias("members"))
    salted = pairs.join(crowd, "b").withColumn("s", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / plan.salt)).cast("int"))
    need = (
        salted.select("b", "s", F.col("a").alias("id"), F.lit(1).alias("member"))
        .union(salted.select("b", "s", F.col("b").alias("id"), F.lit(0).alias("member")).distinct())
    )
    rows = need.join(texts, "id").repartition("b", "s").sortWithinPartitions("b", "s", "member", "id", "text").select("b", "s", "member", "id", "text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader = None, []
        for batch in batches:
            bs, ss, member, ids = (batch.column(c).to_numpy() for c in range(4))
            out_a, out_b, out_s = [], [], []
            for lo, hi in chunks(batch.column(4)):
                words = words_of(batch.column(4).slice(lo, hi - lo))
                for r in range(lo, hi):
                    own = words.hashes[words.first[r - lo] : words.first[r - lo + 1]].tolist()
                    if not member[r]:
                        key, leader = (bs[r], ss[r]), own
                        continue
                    if key == (bs[r], ss[r]) and (found := similarity(own, leader, plan.least)) > 0:
                        out_a.append(ids[r])
                        out_b.append(bs[r])
                        out_s.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_s, pa.float64())], names=["a", "b", "similarity"])

    return bounded_batches(rows).mapInArrow(align, "a bigint, b bigint, similarity double")


def duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``duplicate_of``, ``exact``): every document that goes, and the one that stays for it.

    Documents are the same when their word sequences are, and near-duplicates when a
    sketch tuple agrees and 1 - edit distance / longer length, in words, is at least
    ``plan.least``.  Groups are the connected components of these pairs; the lowest id
    stays.  ``exact`` says that the word sequence is that of the document that stays.

    Same word sequences are found by a 128-bit fingerprint and only one of each goes on.
    Candidates are first compared with the lowest id that shares a tuple; then every
    candidate pair whose ends are not yet in one component is compared, which leaves
    out no pair that could change a component.  Pairs whose lengths alone exclude
    ``plan.least`` are never formed.

    Defined cases: documents with null id, null text or no word are no duplicates;
    rows with one id and differing texts go together, and in each comparison that the
    id leads the greatest of its texts stands for it; repeated rows count once
    (``drop_duplicates`` removes them); ids are integers, and rows whose id is none
    count as rows without; texts of any length are sketched and aligned whole; an empty
    table has no duplicates.  Other columns, whatever their names, are not read.
    """
    base = docs.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    all_sketches = materialise(_sketches(base, plan), "sketches")
    exact = all_sketches.groupBy("f1", "f2", "n").agg(F.min("id").alias("root"), F.count("*").alias("copies"))
    copies = all_sketches.join(exact.filter("copies > 1"), ["f1", "f2", "n"]).filter("id <> root").select("id", "root").distinct()
    one_each = all_sketches.groupBy("f1", "f2", "n").agg(F.min_by(F.struct("id", "tuples"), "id").alias("r")).select("n", "r.*")
    buckets = one_each.select("id", "n", F.explode("tuples").alias("tuple"))
    crowded = buckets.groupBy("tuple").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("first")).filter("members > 1")
    shared = materialise(buckets.join(crowded, "tuple").select("tuple", "id", "n", "first"), "buckets")

    def near(a: str, b: str) -> F.Column:
        return F.least(F.col(a), F.col(b)) >= F.greatest(F.col(a), F.col(b)) * plan.least - 1e-6

    stars = shared.filter("id <> first.id").filter(near("n", "first.n")).select(F.col("id").alias("a"), F.col("first.id").alias("b")).distinct()
    found = materialise(_verified(stars, base, plan), "near")
    first_roots = components(found.select("a", "b"))
    rooted = shared.select("tuple", "id", "n", F.col("first.id").alias("head")).join(first_roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    rooted = materialise(rooted, "rooted")
    # Only tuples with several components can join any.  Of the two ends of such a pair one at least
    # is outside the tuple's largest component, so members of that meet the others, and not each other.
    sizes = rooted.groupBy("tuple", "root").agg(F.count("*").alias("size"))
    several = sizes.groupBy("tuple").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("most")).filter("roots > 1")
    open_ = materialise(rooted.join(several, "tuple").drop("roots"), "open")
    left = open_.filter("root <> most").select("tuple", F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = open_.select("tuple", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), "most", "head")
    rest = left.join(right, "tuple").filter("ra <> rb and (rb = most or a > b)").filter(near("na", "nb"))
    # A star pair that failed above fails again, so it needn't be formed.
    rest = rest.filter("least(a, b) <> head").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    more = _verified(rest, base, plan)
    more = materialise(more, "more")
    for table in (shared, rooted, open_):
        drop_table(table)
    edges = found.select("a", "b").union(more.select("a", "b")).union(copies.select(F.col("id").alias("a"), F.col("root").alias("b")))
    roots = components(edges)
    prints = all_sketches.select("id", F.struct("f1", "f2", "n").alias("print"))
    out = (
        roots.join(prints, F.col("node") == F.col("id"))
        .drop("id")
        .join(prints.withColumnRenamed("print", "kept_print"), F.col("root") == F.col("id"))
        .groupBy(F.col("node").alias(id_col), F.col("root").alias("duplicate_of"))
        .agg(F.max(F.col("print") == F.col("kept_print")).alias("exact"))
    )
    return out


def drop_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns unchanged.

    Cases as for ``duplicates``; of rows that repeat an id and a text, also where they
    are null, the one whose other columns are least stays (maps are not compared).
    """
    gone = duplicates(docs, plan, id_col, text_col).select(F.col(id_col).alias("__gone"))
    left = docs.join(gone, F.col(id_col).try_cast("bigint") == F.col("__gone"), "left_anti")
    others = [f for f in docs.schema if f.name not in (id_col, text_col)]
    if not others:
        return left.distinct()
    kept = F.struct(*[F.col(f"`{f.name}`") for f in others])
    ordered = [F.col(f"`{f.name}`") for f in others if "map<" not in f.dataType.simpleString()]
    least = F.min(kept) if len(ordered) == len(others) else F.min_by(kept, F.struct(F.lit(0), *ordered))
    one = left.groupBy(id_col, text_col).agg(least.alias("__kept"))
    return one.select(*[F.col(f"`{c}`") if c in (id_col, text_col) else F.col("__kept").getField(c).alias(c) for c in docs.columns])
