"""Quality classifier: factorisation machines over hashed words, structure and metadata.

Words are hashed whole and by their first four and five bytes, so that inflected forms
of one stem share what is learnt about them.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudspark.llm._common import bounded_batches, drop_table, materialise
from shroudspark.llm._words import chunks, mix64, prefix_hashes, string_buffer, words_of


class Plan(NamedTuple):
    """Parameters; the defaults are the production values."""

    sample: int = 20_000  # labelled documents to train on, at most; the only bound
    sample_bytes: int = 24 << 20  # and their text, about
    buckets: int = 1 << 18  # hashed words
    least_docs: int = 4  # training documents that a bucket must occur in
    least_z: float = 6.0  # and standard errors by which its share differs between the classes of a head
    rank: int = 6
    epochs: int = 8
    steps: int = 600  # batches, at least: a small sample is gone through more often
    batch: int = 128
    rate: float = 1.0
    pace: float = 10.0  # of structure and metadata, times the rate of words
    damp: float = 1.0  # squared gradients that a weight starts from
    decay: float = 2e-5
    seed: int = 7
    quality: float = 0.5  # a document is kept from this probability of good quality on
    toxic: float = 0.5  # and below this probability of being toxic


HEADS = ("quality", "toxic")
_STATS = 12
_BINS = 16  # one-hot bins of each structure statistic
_PREFIXES = (4, 5)  # bytes
_META = 64  # hashed values of the metadata columns


class Features(NamedTuple):
    """Sparse rows: ``index[first[i]:first[i + 1]]`` are the active features of row ``i``, all of value 1."""

    index: np.ndarray
    first: np.ndarray


def _structure(texts: pa.Array, words) -> np.ndarray:
    """(rows, _STATS) shares and ratios in [0, 1] of each text."""
    data, at = string_buffer(texts)
    n = np.maximum(np.diff(at), 1)

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(mask)))
        return (run[at[1:]] - run[at[:-1]]).astype(float)

    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper = (data >= 65) & (data <= 90)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    rows = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((words.hashes, rows))
    h, r = words.hashes[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(n))
    same = np.zeros(len(words.hashes))
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])
    length = np.bincount(rows, weights=words.end - words.start, minlength=len(n))
    lines = total(data == 10) + 1
    return np.stack(
        [
            np.log1p(count) / 12,
            np.minimum(length / some / 20, 1),
            distinct / some,
            np.bincount(rows, weights=same, minlength=len(n)) / some,
            total(upper) / np.maximum(total(letters), 1),
            total((data >= 48) & (data <= 57)) / n,
            total((data == 33) | (data == 63)) / n * 5,
            total(np.isin(data, np.frombuffer(b"#$%&*@^~<>{}[]\\=_+", dtype=np.uint8))) / n * 3,
            total(data == 124) / n * 5,
            total((data == 46) | (data == 44)) / n * 5,
            np.log1p(lines) / 9,
            np.minimum(n / lines / 1000, 1),
        ],
        axis=1,
    ).clip(0, 1)


def features(texts: pa.Array, meta: list[pa.Array], plan: Plan) -> Features:
    """Hashed words (each once), the bins of the structure statistics, and hashed metadata.

    Nulls count as empty texts and as metadata of their own.
    """
    words = words_of(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(words.first))
    stats = _structure(texts, words)
    bins = np.minimum((np.sqrt(stats) * _BINS).astype(np.int64), _BINS - 1) + np.arange(_STATS) * _BINS + plan.buckets
    base = plan.buckets + _STATS * _BINS
    rows = rows.astype(np.int64) << 32
    parts = [rows | (h & np.uint64(plan.buckets - 1)).astype(np.int64) for h in (words.hashes, *(prefix_hashes(words, n) for n in _PREFIXES))]
    every = np.arange(len(texts), dtype=np.int64) << 32
    parts += [every | bins[:, s] for s in range(_STATS)]
    for m, column in enumerate(meta):
        values = column.cast(pa.string()).fill_null("\x00").to_pylist()
        hashed = np.array([hash_text(v) % _META for v in values], dtype=np.int64)
        parts.append(every | (base + m * _META + hashed))
    keys = np.unique(np.concatenate(parts))
    row = keys >> 32
    return Features(keys & 0xFFFFFFFF, np.searchsorted(row, np.arange(len(texts) + 1)))


@cache
def hash_text(text: str) -> int:
    value = np.uint64(len(text))
    for byte in text.encode():
        value = mix64(np.array([value + np.uint64(byte)], dtype=np.uint64))[0]
    return int(value)


class Machine:
    """One factorisation machine: bias, linear weights and low-rank pair weights.

    score = b + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2) / n, the sums over
    the n active features of a row; the scale 1/n keeps long documents comparable.
    """

    def __init__(self, size: int, plan: Plan, seed: int, pace: np.ndarray | None = None) -> None:
        self.plan = plan
        self.pace = np.ones(size, dtype=np.float32) if pace is None else pace  # of learning, by feature
        self.b = 0.0
        self.w = np.zeros(size, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, plan.rank)).astype(np.float32)

    def score(self, x: Features) -> np.ndarray:
        n = np.diff(x.first)
        out = np.full(len(n), self.b, dtype=np.float64)
        some = np.flatnonzero(n)
        if len(some):
            begin = x.first[:-1][some]
            out[some] += np.add.reduceat(self.w[x.index], begin)
            v = self.v[x.index]
            total = np.add.reduceat(v, begin)
            square = np.add.reduceat(np.einsum("ij,ij->i", v, v), begin)
            out[some] += 0.5 * ((total * total).sum(1) - square) / n[some]
        return out

    def fit(self, x: Features, y: np.ndarray, weight: np.ndarray) -> None:
        """Mini-batch AdaGrad on the weighted logistic loss."""
        plan, rng = self.plan, np.random.default_rng(self.plan.seed)
        gw, gv, gb = np.full_like(self.w, plan.damp), np.full(len(self.w), plan.damp, dtype=np.float32), plan.damp
        number = np.diff(x.first)
        batches = max(1, -(-len(y) // plan.batch))
        for _ in range(max(plan.epochs, -(-plan.steps // batches))):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), plan.batch):
                rows = order[lo : lo + plan.batch]
                n = number[rows]
                first = np.concatenate(([0], np.cumsum(n)))
                owner = np.repeat(np.arange(len(rows)), n)
                part = Features(x.index[np.arange(first[-1]) - first[owner] + x.first[rows][owner]], first)
                error = weight[rows] * (1 / (1 + np.exp(-np.clip(self.score(part), -30, 30))) - y[rows]) / len(rows)
                active, local = np.unique(part.index, return_inverse=True)
                e = error[owner]
                d = np.bincount(local, weights=e, minlength=len(active)) + plan.decay * self.w[active]
                gw[active] += d * d
                self.w[active] -= plan.rate * self.pace[active] * d / np.sqrt(gw[active])
                v = self.v[part.index]
                total = np.add.reduceat(v, first[:-1])
                pull = (total[owner] - v) * (e / n[owner])[:, None]
                dv = np.stack([np.bincount(local, weights=pull[:, f], minlength=len(active)) for f in range(plan.rank)], 1) + plan.decay * self.v[active]
                gv[active] += (dv * dv).mean(1)
                self.v[active] -= (0.3 * plan.rate * dv / np.sqrt(gv[active])[:, None]).astype(np.float32)
                db = error.sum()
                gb += db * db
                self.b -= plan.rate * db / np.sqrt(gb)


class Model(NamedTuple):
    """Trained machines over the features that training kept; ``slot`` maps a feature to its place or -1."""

    plan: Plan
    meta: list[str]
    slot: np.ndarray
    heads: dict[str, Machine]

    def probabilities(self, texts: pa.Array, meta: list[pa.Array]) -> dict[str, np.ndarray]:
        out: dict[str, list[np.ndarray]] = {h: [] for h in self.heads}
        for lo, hi in chunks(texts):
            x = self.select(features(texts.slice(lo, hi - lo), [m.slice(lo, hi - lo) for m in meta], self.plan))
            for name, machine in self.heads.items():
                out[name].append(1 / (1 + np.exp(-np.clip(machine.score(x), -30, 30))))
        return {h: np.concatenate(p) if p else np.zeros(0) for h, p in out.items()}

    def select(self, x: Features) -> Features:
        place = self.slot[x.index]
        kept = place >= 0
        run = np.concatenate(([0], np.cumsum(kept)))
        return Features(place[kept], run[x.first])


def train_on(texts: pa.Array, meta: list[pa.Array], labels: dict[str, np.ndarray], names: list[str], plan: Plan) -> Model:
    """Fit one machine per head on the features that tell the classes of some head apart."""
    parts = [features(texts.slice(lo, hi - lo), [m.slice(lo, hi - lo) for m in meta], plan) for lo, hi in chunks(texts)]
    index = np.concatenate([p.index for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    number = np.concatenate([np.diff(p.first) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    whole = Features(index, np.concatenate(([0], np.cumsum(number))))
    size = plan.buckets + _STATS * _BINS + _META * len(meta)
    docs = np.bincount(index, minlength=size)
    kept = np.arange(size) >= plan.buckets
    kept &= docs > 0
    row = np.repeat(np.arange(len(number)), number)
    for head in HEADS:
        y = labels[head].astype(float)
        ones, zeros = y.sum(), len(y) - y.sum()
        if ones and zeros:
            with_one = np.bincount(index, weights=y[row], minlength=size)
            share = docs / len(y)
            error = np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros)) + 1e-9
            kept |= (np.abs(with_one / ones - (docs - with_one) / zeros) >= plan.least_z * error) & (docs >= plan.least_docs)
    slot = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
    model = Model(plan, names, slot, {})
    x = model.select(whole)
    pace = np.where(np.flatnonzero(kept) >= plan.buckets, plan.pace, 1).astype(np.float32)
    for h, head in enumerate(HEADS):
        machine = Machine(int(kept.sum()), plan, plan.seed + h, pace)
        y = labels[head].astype(float)
        if len(y) and 0 < y.mean() < 1:
            share = y.mean()
            weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).clip(0.25, 6)
            machine.fit(x, y, weight)
        elif len(y):
            machine.b = 8.0 if y[0] > 0 else -8.0
        else:  # nothing to learn from: every document is kept
            machine.b = 8.0 if head == "quality" else -8.0
        model.heads[head] = machine
    return model


def train(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("lang",)) -> Model:
    """Train on a bounded sample of labelled documents, drawn by a hash of their ids.

    Rows without a label in either head, without an integer id or with a null text are
    not used; a label that repeats counts once, differing labels of one id by their least
    value, and of rows that repeat an id the least text.  What is drawn is written once,
    and the documents are read once for it.
    """
    number = F.col(id_col).try_cast("bigint").alias("__id")
    found = labels.filter("quality is not null and toxic is not null").groupBy(number).agg(F.min("quality").alias("__q"), F.min("toxic").alias("__t")).filter("__id is not null")
    names = [m for m in meta if m in docs.columns]
    # Ids alone are ordered, and few more than wanted, so what meets in one task is small at any size.
    total = found.count()
    spot = F.xxhash64("__id", F.lit(plan.seed))
    some = found if total <= 2 * plan.sample else found.filter(F.pmod(spot, F.lit(1 << 30)) < int((1 << 30) * 1.5 * plan.sample / total))
    drawn = some.orderBy(spot, "__id").limit(plan.sample)
    text = docs.select(number, F.col(text_col).alias("__text"), *(F.col(m).cast("string").alias(f"__meta{k}") for k, m in enumerate(names))).filter("__text is not null")
    one = text.join(F.broadcast(drawn), "__id").groupBy("__id", "__q", "__t").agg(F.min(F.struct("__text", *(f"__meta{k}" for k in range(len(names))))).alias("d"))
    own = materialise(one.select("__id", "__q", "__t", "d.*"), "labelled")
    sizes = own.select("__id", F.octet_length("__text").alias("n")).orderBy(spot, "__id").collect()  # plan.sample rows at most
    upto = np.cumsum([r["n"] for r in sizes])
    kept = [(r["__id"],) for r in sizes[: max(1, int(np.searchsorted(upto, plan.sample_bytes, side="right")))]]
    chosen = own.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "__id bigint")), "__id", "left_semi")
    table = chosen.toArrow().sort_by("__id")
    drop_table(own)
    column = lambda name: table[name].combine_chunks() if table.num_rows else pa.array([], pa.string())
    return train_on(
        column("__text"),
        [column(f"__meta{k}") for k in range(len(names))],
        {"quality": np.array(table["__q"].to_pylist(), dtype=float), "toxic": np.array(table["__t"].to_pylist(), dtype=float)},
        names,
        plan,
    )


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_quality``, ``p_toxic`` and ``keep`` (columns of these names are replaced).

    Defined cases: a null or empty text is scored by what is left, its structure and
    metadata; texts are scored whole at any length; equal rows get equal scores; null
    metadata is a value of its own; without any labels every document is kept; a
    probability that equals ``plan.quality`` is enough, one that equals ``plan.toxic`` is
    too much; an empty table stays empty.  A column may have any name but ``__p``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<quality:double,toxic:double>")
    def probabilities(texts: pa.Array, *meta: pa.Array) -> pa.Array:
        found = shared.value.probabilities(texts, list(meta))
        return pa.StructArray.from_arrays([pa.array(found[h]) for h in HEADS], names=list(HEADS))

    plan = model.plan
    scored = bounded_batches(docs).withColumn("__p", probabilities.asNondeterministic()(F.col(text_col), *(F.col(m).cast("string") for m in model.meta)))
    return scored.withColumns(
        {
            "p_quality": F.round("__p.quality", 6),
            "p_toxic": F.round("__p.toxic", 6),
            "keep": (F.col("__p.quality") >= plan.quality) & (F.col("__p.toxic") < plan.toxic),
        }
    ).drop("__p")


def keep_good(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The documents that the classifier keeps, with their probabilities."""
    return score(docs, train(docs, labels, plan, id_col, text_col, meta), text_col).filter("keep").drop("keep")
