"""Repeated passages by distributed prefix doubling over word positions.

Every position is ranked by the words that follow it.  The first round sorts positions
by the hash of their next ``base`` words; each further round pairs a position's rank
with that of the position an offset further on, Spark sorts the pairs over all
partitions, and equal neighbours get one new rank for the longer prefix.  Positions
whose rank is unique drop out of all further rounds.  Offsets double until the ranked
prefix is as long as the shortest passage asked for.

The sort is by rank pair and then by position, in ranges, so that the positions of a
passage that is as frequent as one likes lie in as many partitions as they need; where a
rank goes on in the next partition is put right by what the partitions say of their
first and last ranks.

Two things keep positions out of the sort that cannot repeat, without changing the
result.  A passage of ``words`` words holds a minimiser (the least of its ``base``-word
hashes) at the same place in each of its copies, so only positions near a minimiser that
occurs twice are ranked at all.  And of texts with the same word sequence, by 128 bits
of fingerprint, one is ranked: the passages of the others are theirs.  A word hash that
two different runs of words share can't make a passage: all parts of it must be alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroudspark.llm._common import HOT, bounded_batches, drop_table, map_arrow, materialise, spread_join, with_text
from shroudspark.llm._words import chunks, string_buffer, window_hashes, words_of
from shroudspark.llm.order_minhash import _fingerprints

SPANS = "array<struct<start:int,end:int>>"


class Plan(NamedTuple):
    """Parameters; the defaults are the production values."""

    words: int = 50  # of the shortest passage that counts

    @property
    def base(self) -> int:
        return max(1, -(-self.words // 4))

    @property
    def sizes(self) -> list[int]:
        """Prefix lengths that are ranked, from ``base`` to ``words``."""
        out = [self.base]
        while out[-1] < self.words:
            out.append(min(2 * out[-1], self.words))
        return out


def _least_places(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the least value, leftmost of equals, in each window of ``size``."""
    place = np.arange(len(values))
    span = 1

    def halves(shift: int) -> None:
        nonlocal place
        left, right = place[: len(place) - shift], place[shift:]
        place = np.where(values[left] <= values[right], left, right)

    while span * 2 <= size:
        halves(span)
        span *= 2
    if span < size:
        halves(size - span)
    return place


def _prints(docs: DataFrame, plan: Plan) -> DataFrame:
    """(id, n, f1, f2, hashes, places) of every text that is long enough, with its minimisers."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for lo, hi in chunks(batch.column(1)):
            words = words_of(batch.column(1).slice(lo, hi - lo))
            n = np.diff(words.first)
            mers = window_hashes(words.hashes, plan.base)
            found = np.zeros(0, dtype=np.int64)
            if len(words.hashes) >= plan.words:
                places = _least_places(mers, plan.words - plan.base + 1)
                row = np.repeat(np.arange(hi - lo), n)
                inside = row[: len(places)] == row[plan.words - 1 :]
                found = np.unique(places[inside])
            number = np.diff(np.searchsorted(found, words.first))
            own = found - np.repeat(words.first[:-1], number)
            keep = np.flatnonzero(n >= plan.words)  # all others have no minimisers
            f1, f2 = _fingerprints(words)
            parts.append((keep + lo, n[keep], f1[keep], f2[keep], number[keep], mers[found], own))
        at, n, f1, f2, number, hashes, places = (np.concatenate(x) for x in zip(*parts))
        ends = pa.array(np.concatenate(([0], np.cumsum(number))).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at)),
                pa.array(n.astype(np.int32)),
                pa.array(f1.view(np.int64)),
                pa.array(f2.view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32))),
            ],
            names=["id", "n", "f1", "f2", "hashes", "places"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, one, f"id {kind}, n int, f1 bigint, f2 bigint, hashes array<bigint>, places array<int>")


def _near(places: np.ndarray, n: int, plan: Plan) -> np.ndarray:
    """Whether each of ``n`` positions could start a passage, given its text's repeated minimisers."""
    reach = plan.words - plan.base
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, np.maximum(places - reach, 0), 1)
    np.add.at(edge, np.minimum(places + 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def _first_keys(texts: DataFrame, plan: Plan) -> DataFrame:
    """(left, right, num, pos): the hash of the next ``base`` words of each position that a passage could need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum([0, *batch.column(2).value_lengths().to_pylist()])
            for lo, hi in chunks(batch.column(1)):
                words = words_of(batch.column(1).slice(lo, hi - lo))
                keys, owners, places = [], [], []
                for r in range(hi - lo):
                    h = words.hashes[words.first[r] : words.first[r + 1]]
                    wanted = _near(flat[ends[lo + r] : ends[lo + r + 1]], len(h) - plan.words + 1, plan)
                    need = np.zeros(len(h) - plan.base + 1, dtype=bool)
                    for shift in _shifts(plan):  # also what later rounds look up
                        need[shift : shift + len(wanted)] |= wanted
                    at = np.flatnonzero(need)
                    keys.append(window_hashes(h, plan.base)[at])
                    owners.append(np.full(len(at), numbers[lo + r]))
                    places.append(at)
                if keys:
                    key = np.concatenate(keys).view(np.int64)
                    columns = [pa.array(key), pa.array(np.zeros(len(key), np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["left", "right", "num", "pos"])

    return bounded_batches(texts).mapInArrow(run, _PAIRS)


_PAIRS = "left bigint, right bigint, num bigint, pos int"


def _shifts(plan: Plan) -> list[int]:
    """Distances from a position at which the first of the ranked sizes is looked up."""
    out = {0}
    for small, large in zip(plan.sizes, plan.sizes[1:]):
        out |= {s + large - small for s in out}
    return sorted(out)


def _ranked_rows(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(num, pos, rank, first, left, right) of the sorted rows whose pair occurs more than once.

    A rank is the partition and the number of the pair within it.  All rows of the first
    and of the last pair are kept, and two rows without positions (-1 and -2) say what
    these pairs are and how many rows they have, as the number.  One row is held back.
    """
    rank = first_rank = part << 40
    first_rank += 1
    held: list[np.ndarray] = []
    held_new = True
    first, last = [0, 0, 0], [0, 0, 0]  # left, right, size
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(4)]
        before = bool(held)
        if held:
            columns = [np.concatenate((h, c)) for h, c in zip(held, columns)]
        new = np.ones(len(columns[0]), dtype=bool)
        new[0] = held_new
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        ranks = rank + np.cumsum(new)
        again = ~new
        again[:-1] |= ~new[1:]
        again |= ranks == first_rank
        if ranks[0] == first_rank:
            first = [int(columns[0][0]), int(columns[1][0]), first[2] + int((ranks == first_rank).sum()) - before]
        size = int((ranks == ranks[-1]).sum())
        last = [int(columns[0][-1]), int(columns[1][-1]), size + last[2] - 1 if before and ranks[0] == ranks[-1] else size]
        yield _rank_rows(columns, ranks, new, np.flatnonzero(again[:-1]))
        held, held_new = [c[-1:] for c in columns], bool(new[-1])
        rank = int(ranks[-1]) - int(held_new)
    if held:
        rank += int(held_new)
        yield _rank_rows(held, np.array([rank]), np.array([held_new]), np.array([0]))
        left, right, sizes = zip(first, last)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array([-1, -2], pa.int32()), pa.array([first_rank, rank], pa.int64()), pa.array([True, True]), pa.array(left, pa.int64()), pa.array(right, pa.int64())],
            names=["num", "pos", "rank", "first", "left", "right"],
        )


def _rank_rows(columns: list[np.ndarray], ranks: np.ndarray, new: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[2][at]), pa.array(columns[3][at]), pa.array(ranks[at]), pa.array(new[at]), none, none], names=["num", "pos", "rank", "first", "left", "right"]
    )


def _across(ends: list[tuple[int, int, int, int]]) -> list[tuple[int, int | None]]:
    """(rank, the rank it becomes, or none if it is unique) from (rank, left, right, size) of partitions' first and last pairs."""
    by_pair: dict[tuple[int, int], dict[int, int]] = {}
    for rank, left, right, size in ends:
        by_pair.setdefault((left, right), {})[rank] = size
    out: list[tuple[int, int | None]] = []
    for ranks in by_pair.values():
        least = min(ranks)
        if sum(ranks.values()) == 1:
            out.append((least, None))
        out += [(rank, least) for rank in ranks if rank != least]
    return out


def _rank(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(num, pos, rank, first) of the positions whose pair occurs more than once, and the table that it reads.

    ``pairs`` is an intermediate table, and is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _ranked_rows(TaskContext.get().partitionId(), batches)

    spark = pairs.sparkSession
    keys = ("left", "right", "num", "pos")
    ordered = pairs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = materialise(ordered.mapInArrow(run, "num bigint, pos int, rank bigint, first boolean, left bigint, right bigint"), "ranks")
    del ordered
    drop_table(pairs)
    ends = [(r["rank"], r["left"], r["right"], r["num"]) for r in table.filter("pos < 0").collect()]  # two for a partition
    moved = F.broadcast(spark.createDataFrame(_across(ends), "rank bigint, to bigint").withColumn("moved", F.lit(True)))
    rows = table.filter("pos >= 0").join(moved, "rank", "left").filter("moved is null or to is not null")
    return rows.select("num", "pos", F.coalesce("to", "rank").alias("rank"), (F.col("first") & F.col("to").isNull()).alias("first")), table


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by text, regrouped so that no text is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        num = batch.column(0).to_numpy()
        cut = int(np.searchsorted(num, num[-1], side="left"))
        if cut or (held and held[0].column(0)[0].as_py() != num[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _by_text(ranked: DataFrame) -> DataFrame:
    return ranked.repartition("num").sortWithinPartitions("num", "pos")


def _next_pairs(ranked: DataFrame, offset: int) -> DataFrame:
    """(left, right, num, pos): ranks of a position and of the one ``offset`` further, where both repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_texts(batches):
            num, pos, rank = (table.column(c).to_numpy() for c in range(3))
            text = np.cumsum(np.concatenate(([0], num[1:] != num[:-1])))
            spot = (text << 32) | pos
            to = np.searchsorted(spot, spot + offset)
            to[to == len(spot)] = 0
            at = np.flatnonzero(spot[to] == spot + offset)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank[at]), pa.array(rank[to[at]]), pa.array(num[at]), pa.array(pos[at])], names=["left", "right", "num", "pos"]
            )

    return _by_text(ranked).mapInArrow(run, _PAIRS)


def _merged(starts: np.ndarray, size: int) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size) + 1
    begin = starts[np.concatenate(([0], cut))]
    end = starts[np.concatenate((cut - 1, [len(starts) - 1]))] + size
    return [{"start": int(a), "end": int(b)} for a, b in zip(begin, end)]


def _spans(ranked: DataFrame, plan: Plan) -> DataFrame:
    """(num, spans, extra) of every text with a repeated passage."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_texts(batches):
            num, pos = (table.column(c).to_numpy() for c in range(2))
            first = table.column(3).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(num[1:] != num[:-1]) + 1, [len(num)])).tolist()
            spans, extra = [], []
            for a, b in zip(cuts, cuts[1:]):
                spans.append(_merged(pos[a:b], plan.words))
                extra.append(_merged(pos[a:b][~first[a:b]], plan.words))
            yield pa.RecordBatch.from_arrays([pa.array(num[cuts[:-1]]), pa.array(spans, kind), pa.array(extra, kind)], names=["num", "spans", "extra"])

    return _by_text(ranked).mapInArrow(run, f"num bigint, spans {SPANS}, extra {SPANS}")


@F.arrow_udf(T.StructType([T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType())]))
def _print_of(texts: pa.Array) -> pa.Array:
    out = [_fingerprints(words_of(texts.slice(lo, hi - lo))) for lo, hi in chunks(texts)]
    columns = [np.concatenate(x).view(np.int64) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 2
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["f1", "f2"])


def _repeats(base: DataFrame, plan: Plan) -> DataFrame:
    """(id, f1, f2, n, spans, extra) of every row (id, text) with a repeated passage."""
    both = ["f1", "f2"]
    prints = materialise(_prints(base, plan), "prints")
    rows, marked = prints.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    # Numbers go up with the fingerprints, however the rows are partitioned.
    texts = prints.groupBy(*both).agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNotNull(), F.col("id").alias("id"))).alias("least"))
    texts = texts.select(*both, "copies", F.col("least.id").alias("least")).repartitionByRange(*both).sortWithinPartitions(*both)
    texts = materialise(texts.withColumn("num", F.monotonically_increasing_id()), "texts")
    one_each = prints.groupBy(*both).agg(F.any_value(F.arrays_zip("hashes", "places")).alias("own")).join(texts, both)
    minimisers = materialise(one_each.select("num", F.inline("own")).withColumnsRenamed({"hashes": "hash", "places": "pos"}), "minimisers")
    twice = materialise(minimisers.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1"), "twice")
    marks = spread_join(minimisers, twice, ["hash"], twice.filter(F.col("times") > marked / HOT))
    marks = marks.groupBy("num").agg(F.collect_list("pos").alias("marks")).join(texts.select("num", *both), "num")
    named = base.select(_print_of("text").alias("print"), "text").select("print.*", "text")
    wanted = named.groupBy(*both).agg(F.any_value("text").alias("text")).join(marks, both).select("num", "text", "marks")
    pairs = materialise(_first_keys(wanted, plan), "pairs")
    del one_each, marks, named, wanted
    drop_table(minimisers, twice)
    ranked, table = _rank(pairs)
    for small, large in zip(plan.sizes, plan.sizes[1:]):
        pairs = materialise(_next_pairs(ranked, large - small), "pairs")
        drop_table(table)
        ranked, table = _rank(pairs)
    found = materialise(_spans(ranked, plan), "spans")
    drop_table(table)
    # Rows that repeat an id and a text are counted, and told apart again at the end.
    each = prints.groupBy("id", *both).agg(F.any_value("n").alias("n"), F.count("*").alias("times"))
    about = texts.join(found, "num", "left").filter("copies > 1 or spans is not null")
    joined = spread_join(each, about.drop("num"), both, texts.filter(F.col("copies") > rows / HOT))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    none = F.array().cast(SPANS)
    nth = joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    keeps = (F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("least"))
    return nth.select(
        "id",
        *both,
        "n",
        F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(keeps, F.coalesce("extra", none)).otherwise(whole).alias("extra"),
    )


def repeats(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_words``, ``spans``, ``extra``) of every document with a repeated passage.

    ``spans`` are the runs of words (numbered from 0, end exclusive) that consist of
    passages of at least ``plan.words`` words that occur elsewhere in the collection,
    in this or another document; ``extra`` is ``spans`` without one occurrence of each
    passage, so cutting ``extra`` keeps every passage once (that of the least text
    fingerprint, and of texts with the same words that of the lowest id; nulls are lowest).

    Words are compared as in ``_words``.  Defined cases: null, empty and shorter texts
    have no passages; texts of any length are ranked whole; rows that repeat an id
    and a text are copies of each other, and so are rows with null ids; rows of one id
    and differing texts are documents of their own; an empty table has no rows.  Other
    columns, whatever their names, are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return _repeats(base, plan).select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "spans", "extra")


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, extra: pa.Array) -> pa.Array:
    """Texts without the words of their spans, and what stands between those words."""
    out: list[str | None] = []
    for lo, hi in chunks(texts):
        part = texts.slice(lo, hi - lo)
        words = words_of(part)
        raw = string_buffer(part)[0].tobytes()
        for r in range(hi - lo):
            if not texts[lo + r].is_valid:
                out.append(None)
                continue
            pieces, at, base = [], int(words.row_start[r]), int(words.first[r])
            for span in extra[lo + r].as_py() or []:
                pieces.append(raw[at : words.start[base + span["start"]]])
                at = int(words.end[base + span["end"] - 1])
            pieces.append(raw[at : words.row_start[r + 1]])
            out.append(b"".join(pieces).decode("utf-8"))
    return pa.array(out, pa.string())


def cut_repeats(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each repeated passage left in one place only; all rows and columns stay.

    The ``extra`` spans of ``repeats`` are cut out of the texts.  Cases as there; rows
    that repeat an id and a text are treated alike, as the first of them.  Columns may
    have any names but those that begin with ``__cut``.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    cuts = _repeats(base, plan).groupBy(F.col("id").alias("__cut_id"), F.col("f1").alias("__cut_f1"), F.col("f2").alias("__cut_f2"))
    cuts = cuts.agg(F.min_by("extra", F.aggregate("extra", F.lit(0), lambda s, x: s + x["end"] - x["start"])).alias("__cut"))
    left = docs.withColumn("__cut_print", _print_of(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__cut_id")) & (F.col("__cut_print.f1") == F.col("__cut_f1")) & (F.col("__cut_print.f2") == F.col("__cut_f2"))
    joined = left.join(cuts, same, "left")
    return with_text(joined, text_col, _without(F.col(text_col), F.col("__cut"))).drop("__cut", "__cut_print", "__cut_id", "__cut_f1", "__cut_f2")
