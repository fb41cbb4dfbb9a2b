"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree has two parts.  Its top, whose leaves are the cells, is sent to every executor;
it starts from a bounded sample and one Lloyd pass over all vectors moves its means.
Below each cell hangs a subtree that the task that holds the cell's vectors builds from
all of them; a cell of more vectors than a task should hold is split by a hash into
shards, each with a subtree, and whoever visits the cell visits all of them.  A query walks
both parts through a priority queue of nodes by the distance to their means: nearest
cells first, and within a cell nearest leaves first.  How many cells and leaves it
visits is found by widening until queries with known neighbours reach the recall asked
for.  Vectors are compared with leaves in matrix products, a leaf with all queries that
visit it.

Equal vectors are indexed, and asked for, once: of their ids only the k + 1 lowest can be
anybody's neighbours, as ties go to the lower id.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroudspark.llm._common import drop_table, materialise


class Plan(NamedTuple):
    """Parameters; the defaults are the production values."""

    k: int = 10  # neighbours
    cell: int = 4096  # vectors in a cell, about
    most_cells: int = 1 << 16  # then cells grow, and what is broadcast doesn't
    shard: int = 1 << 16  # vectors in a subtree, about, at most; larger cells are split
    branches: int = 16
    passes: int = 1  # Lloyd passes of the cells over all vectors
    leaf: int = 48  # vectors in a leaf, at most
    recall: float = 0.96  # of the calibration queries
    calibration: int = 512  # queries
    sample: int = 1 << 17  # vectors, at most, on which the top is fitted before all vectors move it
    hot: int = 4096  # a query vector with more than this part of all queries has its answer broadcast
    seed: int = 5


class Tree:
    """Nodes with means and children; a node without children is a leaf."""

    def __init__(self, mean: np.ndarray) -> None:
        self.means: list[np.ndarray] = [mean]
        self.children: list[list[int]] = [[]]
        self._sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, parent: int, mean: np.ndarray) -> int:
        self.means.append(mean)
        self.children.append([])
        self.children[parent].append(len(self.means) - 1)
        return len(self.means) - 1

    def leaves(self) -> list[int]:
        return [n for n, c in enumerate(self.children) if not c]

    def sides(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and squared norms of a node's children, kept from the first time on."""
        if node not in self._sides:
            means = np.stack([self.means[c] for c in self.children[node]])
            self._sides[node] = means, (means * means).sum(1)
        return self._sides[node]

    def order(self, distance: Callable[[int], list[float]], visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first; ``distance`` has those of a node's children."""
        queue = [(0.0, 0)]
        found: list[int] = []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            inner = self.children[node]
            if not inner:
                found.append(node)
            else:
                for pair in zip(distance(node), inner):
                    heapq.heappush(queue, pair)
        return found

    def visit(self, query: np.ndarray, visits: int) -> list[int]:
        """``order`` for one query; only children of nodes that the queue gives are compared with it."""

        def distance(node: int) -> list[float]:
            means, norms = self.sides(node)
            return (norms - 2 * (means @ query) + own).tolist()

        own = float(query @ query)
        return self.order(distance, visits)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest means, a level at a time."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x)) if self.children[0] else np.zeros(0, np.int64)
        while len(moving):
            moving = moving[np.argsort(at[moving], kind="stable")]
            nodes, starts = np.unique(at[moving], return_index=True)
            for node, part in zip(nodes.tolist(), np.split(moving, starts[1:])):
                means, norms = self.sides(node)
                at[part] = np.array(self.children[node])[(norms - 2 * (x[part] @ means.T)).argmin(1)]
            inner = np.array([bool(c) for c in self.children])
            moving = moving[inner[at[moving]]]
        return at


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def means_of(x: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from k-means++ starts; fewer means where vectors are equal."""
    chosen = [x[rng.integers(len(x))]]
    nearest = squares(x, chosen[0][None])[:, 0]
    while len(chosen) < min(count, len(x)) and nearest.max() > 1e-12:
        pick = x[rng.choice(len(x), p=nearest / nearest.sum())]
        chosen.append(pick)
        nearest = np.minimum(nearest, squares(x, pick[None])[:, 0])
    means = np.stack(chosen)
    for _ in range(rounds):
        own = squares(x, means).argmin(1)
        number = np.bincount(own, minlength=len(means))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(number)
        sums = np.add.reduceat(x[order], (np.cumsum(number) - number)[full], axis=0)
        means[full] = sums / number[full][:, None]
    return means


class Subtree:
    """The tree of one cell, or of a shard of it, with the vectors in the order of its leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, cell: int, plan: Plan) -> None:
        rng = np.random.default_rng([plan.seed, cell])
        self.tree = Tree(x.mean(0))
        spans: dict[int, np.ndarray] = {}
        work = [(0, np.arange(len(x)))]
        while work:
            node, own = work.pop()
            if len(own) <= plan.leaf:
                spans[node] = own
                continue
            means = means_of(x[own], plan.branches // 2, 4, rng)
            side = squares(x[own], means).argmin(1) if len(means) > 1 else np.zeros(len(own), np.int64)
            if len(np.unique(side)) < 2:  # too near each other to be told apart
                side = np.arange(len(own)) // plan.leaf
            for c in np.unique(side).tolist():
                part = own[side == c]
                work.append((self.tree.add(node, x[part].mean(0)), part))
        nodes = sorted(spans)
        order = np.concatenate([spans[n] for n in nodes])
        self.ends = np.cumsum([0] + [len(spans[n]) for n in nodes])
        self.number = {n: k for k, n in enumerate(nodes)}
        self.x, self.ids = x[order], ids[order]
        self.norms = (self.x * self.x).sum(1)
        self.means = np.stack(self.tree.means)

    def visits(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """The leaves that each query visits, in order, as their places among the leaves."""
        if visits >= len(self.number):
            return [list(range(len(self.number)))] * len(queries)
        inner = self.tree.children
        out = []
        for far in squares(queries, self.means).tolist():
            out.append([self.number[n] for n in self.tree.order(lambda node: [far[c] for c in inner[node]], visits)])
        return out

    def search(self, queries: np.ndarray, visits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``k`` nearest in the leaves it visits: squared distances, and rows of ``x`` or -1.

        Every leaf is compared with all queries that visit it in one product.  What is
        nearest by the products is compared again, component by component.
        """
        asked: dict[int, list[int]] = {}
        for q, leaves in enumerate(self.visits(queries, visits)):
            for leaf in leaves:
                asked.setdefault(leaf, []).append(q)
        size = np.diff(self.ends)
        filled = np.zeros(len(queries), np.int64)
        wide = np.zeros(len(queries), np.int64)
        for leaf, own in asked.items():
            wide[own] += size[leaf]
        most = int(wide.max(initial=0))
        near, row = np.full((len(queries), most), np.inf), np.full((len(queries), most), -1, np.int64)
        for leaf, own in asked.items():
            a, b = self.ends[leaf], self.ends[leaf + 1]
            who = np.array(own)
            to = (filled[who][:, None] + np.arange(b - a), who[:, None])
            near[to[1], to[0]] = self.norms[a:b] - 2 * (queries[who] @ self.x[a:b].T)
            row[to[1], to[0]] = np.arange(a, b)
            filled[who] += b - a
        d, at = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
        if not most:
            return d, at
        edge = np.partition(near, min(k, most) - 1, axis=1)[:, min(k, most) - 1]
        slack = 1e-9 * (1 + np.abs(edge) + (queries * queries).sum(1))  # ties at the edge are all kept, then ids decide
        q, c = np.nonzero((near <= (edge + slack)[:, None]) & (row >= 0))
        rows = row[q, c]
        exact = ((self.x[rows] - queries[q]) ** 2).sum(1)
        order = np.lexsort((self.ids[rows], exact, q))
        q, rows, exact = q[order], rows[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        some = place < k
        d[q[some], place[some]], at[q[some], place[some]] = exact[some], rows[some]
        return d, at

    def leaf_rank(self, query: np.ndarray, target: int) -> int:
        """How many leaves a query visits until it comes to a vector's leaf."""
        leaf = int(np.searchsorted(self.ends, int(np.flatnonzero(self.ids == target)[0]), side="right")) - 1
        far = squares(query[None], self.means)[0].tolist()
        order = self.tree.order(lambda node: [far[c] for c in self.tree.children[node]], len(self.number))
        return 1 + order.index(next(n for n, k in self.number.items() if k == leaf))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def build_top(vectors: DataFrame, n: int, plan: Plan) -> Tree:
    """Level by level from a sample, then Lloyd passes over all vectors move the means of the cells."""
    spark = vectors.sparkSession
    cells = int(min(max(1, round(n / plan.cell)), plan.most_cells))
    share = min(1.0, 1.5 * plan.sample / n)
    spot = F.xxhash64("id", F.lit(plan.seed))
    some = vectors if share >= 1 else vectors.filter(F.pmod(spot, F.lit(1 << 30)) < int(share * (1 << 30)))
    first = _matrix(some.orderBy(spot, "id").limit(plan.sample).select("v").toArrow()["v"].combine_chunks())
    tree = Tree(first.mean(0))
    rng = np.random.default_rng(plan.seed)
    while len(frontier := tree.leaves()) < cells:
        at = tree.route(first)
        order = np.argsort(at, kind="stable")
        nodes, starts = np.unique(at[order], return_index=True)
        own = dict(zip(nodes.tolist(), np.split(order, starts[1:])))
        wide = min(plan.branches, max(2, -(-cells // len(frontier))))
        grown = False
        for node in frontier:
            if len(own.get(node, ())) > 1:
                means = means_of(first[own[node]], wide, 4, rng)
                if len(means) > 1:
                    grown = True
                    for mean in means:
                        tree.add(node, mean)
        tree._sides.clear()
        if not grown:  # what is left in each cell is equal
            break
    for _ in range(plan.passes if cells > 1 else 0):
        shared = spark.sparkContext.broadcast(tree)
        moved = dict((node, np.array(total) / number) for node, number, total in _sums(vectors, shared).toLocalIterator())
        shared.unpersist()
        for node, mean in moved.items():
            tree.means[node] = mean
        tree._sides.clear()
    return tree


def _sums(vectors: DataFrame, shared) -> DataFrame:
    """(node, n, sums) over all vectors for each leaf of the tree so far."""

    def add(totals: dict[int, tuple[int, np.ndarray]], node: int, n: int, s: np.ndarray) -> None:
        m, t = totals.get(node, (0, 0.0))
        totals[node] = (m + n, t + s)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                at = shared.value.route(x)
                order = np.argsort(at, kind="stable")
                nodes, starts, number = np.unique(at[order], return_index=True, return_counts=True)
                for node, n, s in zip(nodes.tolist(), number.tolist(), np.add.reduceat(x[order], starts, axis=0)):
                    add(totals, node, n, s)
        yield _sum_rows(totals)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                add(totals, row["node"], row["n"], np.array(row["s"]))
        yield _sum_rows(totals)

    schema = "node bigint, n bigint, s array<double>"
    return vectors.select("v").mapInArrow(part, schema).repartition("node").mapInArrow(whole, schema)


def _sum_rows(totals: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int64()), pa.array([n for n, _ in totals.values()], pa.int64()), pa.array([s.tolist() for _, s in totals.values()], pa.list_(pa.float64()))],
        names=["node", "n", "s"],
    )


def _placed(vectors: DataFrame, shared) -> DataFrame:
    """``vectors`` with ``cell``, the cell that each is routed to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(shared.value.route(_matrix(batch.column("v"))), pa.int64()))

    return vectors.mapInArrow(run, f"{_ddl(vectors)}, cell bigint")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _visitors(queries: DataFrame, shared, cells: int, shards: dict[int, int]) -> DataFrame:
    """(h1, h2, v, cell, shard): every query in each shard of each cell that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for batch in batches:
            at, cell, shard = [], [], []
            for k, q in enumerate(_matrix(batch.column("v"))):
                for node in tree.visit(q, cells):
                    for s in range(shards.get(node, 1)):
                        at.append(k)
                        cell.append(node)
                        shard.append(s)
                if len(at) > 20_000 or k + 1 == batch.num_rows:
                    rows = batch.select(["h1", "h2", "v"]).take(pa.array(at, pa.int64()))
                    yield rows.append_column("cell", pa.array(cell, pa.int64())).append_column("shard", pa.array(shard, pa.int32()))
                    at, cell, shard = [], [], []

    return queries.select("h1", "h2", "v").mapInArrow(run, "h1 bigint, h2 bigint, v array<float>, cell bigint, shard int")


def _subtrees(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[tuple[Subtree, pa.Table, pa.RecordBatch]]:
    """(subtree, the rows in its order, some of its visitors) of rows sorted by cell, shard and ``visits``.

    Only the vectors of one shard are held; its visitors come after them and pass by.
    """
    held: list[pa.RecordBatch] = []
    sub, rows, at = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "shard", "visits")])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            here, visits = marks[:2, a].tolist(), marks[2, a]
            if here != at:
                held, sub, at = [], None, here
            if not visits:
                held.append(batch.slice(a, b - a))
            elif held:
                if sub is None:
                    table = pa.Table.from_batches(held)
                    table = table.take(pa.array(np.argsort(table["id"].to_numpy())))
                    sub = Subtree(_matrix(table["v"].combine_chunks()), np.arange(len(table)), here[0], plan)
                    rows = table.select(["ids"]).take(pa.array(sub.ids))
                yield sub, rows, batch.slice(a, b - a)


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id): the k nearest of all vectors; ``queries`` (q, qv) are few and are sent to every task."""
    rows = queries.select("q", "qv").toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((rows["q"].to_numpy(), _matrix(rows["qv"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        best, who = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows if len(own) else 0, 4096):
                part = batch.slice(lo, 4096)
                ids = part.column("id").to_numpy()
                d = squares(q, _matrix(part.column("v")))
                d[own[:, None] == ids[None, :]] = np.inf
                best, who = np.concatenate([best, d], axis=1), np.concatenate([who, np.broadcast_to(ids, d.shape)], axis=1)
                some = np.argpartition(best, min(k, best.shape[1]) - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(best, some, 1), np.take_along_axis(who, some, 1)
        r, c = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(best[r, c]), pa.array(who[r, c])], names=["q", "d", "id"])

    found = vectors.select("id", "v").mapInArrow(run, "q bigint, d double, id bigint")
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k)
    some = found.groupBy("q", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(nearest.alias("near"))
    whole = some.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return whole.select("q", F.explode("near.id").alias("id"))


def calibrate(placed: DataFrame, tree: Tree, n: int, plan: Plan) -> tuple[int, int]:
    """Cells, and leaves in each shard, to visit: the least work with which calibration queries reach the recall.

    For every true neighbour of a calibration query it is found out how many cells,
    and how many leaves of its shard, the query must visit to meet it.  Only shards
    with such neighbours are built.
    """
    spark = placed.sparkSession
    spot = F.xxhash64("id", F.lit(plan.seed + 1))
    share = min(1.0, 2.0 * plan.calibration / n)
    some = placed if share >= 1 else placed.filter(F.pmod(spot, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    queries = materialise(some.orderBy(spot, "id").limit(plan.calibration).select(F.col("id").alias("q"), F.col("v").alias("qv")), "calibration")
    truth = materialise(exact(placed, queries, plan.k).join(queries, "q"), "truth")  # k rows for a query, so it is few
    wanted = truth.groupBy("id").agg(F.collect_list(F.struct("q", "qv")).alias("asked"))
    rows = placed.select("cell", "shard", "id", "v").join(F.broadcast(wanted), "id", "left")
    built = rows.filter("asked is not null").select("cell", "shard").distinct()
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: Tree = shared.value
        for table in _shards(batches):
            asked = [(i, a["qv"]) for i, c in zip(table["id"].to_pylist(), table["asked"].to_pylist()) for a in c or []]
            if not asked:
                continue
            ids = table["id"].to_numpy()
            order = np.argsort(ids)
            cell, out = table["cell"][0].as_py(), []
            sub = Subtree(_matrix(table["v"].combine_chunks())[order], ids[order], cell, plan)
            for target, vector in asked:
                q = np.array(vector, dtype=np.float64)
                out.append((1 + top.visit(q, len(top.means)).index(cell), sub.leaf_rank(q, target)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out]), pa.array([b for _, b in out])], names=["cells", "leaves"])

    rows = rows.join(F.broadcast(built), ["cell", "shard"], "left_semi")
    ranks = rows.repartition("cell", "shard").sortWithinPartitions("cell", "shard", "id").mapInArrow(run, "cells bigint, leaves bigint").toArrow()
    for table in (queries, truth):
        drop_table(table)
    cells, leaves = ranks["cells"].to_numpy(), ranks["leaves"].to_numpy()
    best = None
    for c in range(1, int(cells.max(initial=1)) + 1):
        in_reach = np.sort(leaves[cells <= c])
        need = int(np.ceil(plan.recall * len(leaves)))
        if 0 < need <= len(in_reach):
            visits = int(in_reach[need - 1])
            cost = c * (visits + 8)  # sending a query to a cell costs about as much as 8 leaves
            if best is None or cost < best[0]:
                best = (cost, c, visits)
    return (best[1], best[2]) if best else (1, 1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell and shard, one whole shard at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(batch.column("cell").to_pylist(), batch.column("shard").to_pylist()))
        a = 0
        for b in range(1, len(keys) + 1):
            if b == len(keys) or keys[b] != keys[a]:
                if held and last != keys[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last, a = keys[a], b
    if held:
        yield pa.Table.from_batches(held)


def neighbours(table: DataFrame, plan: Plan = Plan(), id_col: str = "vec_id", vector_col: str = "embedding", every: int = 1) -> DataFrame:
    """(id, ``rank`` from 1, ``neighbour``, ``distance``): the k nearest others of each query.

    Queries are the rows whose id is divisible by ``every``; they are searched for among
    all rows.  Distances are Euclidean, ties go to the lower id.
    Defined cases: rows with a null id or vector, with an id that is no integer, with a
    null, NaN or infinite component, or with another number of components than most
    have, are left out; of rows that repeat an id the least vector counts; with fewer
    than k others there are fewer rows; an empty table, or one without queries, has no
    rows.  Equal vectors, however many, are neighbours at distance 0.  Other columns,
    whatever their names, are not read.  Tables of any size are indexed whole: beyond
    ``most_cells`` x ``cell`` vectors cells grow, and beyond ``shard`` they are split.
    """
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(~bad).withColumn("size", F.size("v"))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    schema = f"{id_col} bigint, rank int, neighbour bigint, distance double"
    spark = table.sparkSession
    if sizes is None or sizes["size"] == 0:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.col("size") == sizes["size"]).groupBy("id").agg(F.min("v").alias("v"))
    zero = F.transform("v", lambda c: F.when(c == 0, F.lit(0.0).cast("float")).otherwise(c))  # -0 is 0
    own = materialise(rows.select("id", zero.alias("v")).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(plan.seed), "v").alias("h2")), "vectors")
    lowest = own.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("place") <= plan.k + 1)
    lowest = lowest.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = own.filter(F.pmod("id", F.lit(every)) == 0).select("id", "h1", "h2")
    lowest = lowest.join(asked.groupBy("h1", "h2").agg(F.count("*").alias("asked")), ["h1", "h2"], "left")
    vectors = materialise(lowest.select(F.col("ids")[0].alias("id"), "v", "ids", "h1", "h2", F.coalesce("asked", F.lit(0)).alias("asked")), "distinct")
    n, queries, total = vectors.agg(F.count("*"), F.count_if(F.col("asked") > 0), F.sum("asked")).first()
    if not queries:
        return spark.createDataFrame([], schema)
    tree = build_top(vectors, n, plan)
    shared = spark.sparkContext.broadcast(tree)
    placed = materialise(_placed(vectors, shared), "placed")
    heavy = placed.groupBy("cell").count().filter(F.col("count") > plan.shard)  # cells are at most most_cells
    heavy = heavy.select("cell", F.ceil(F.col("count") / plan.shard).alias("parts"))
    shards = {r["cell"]: r["parts"] for r in heavy.collect()}
    heavy = F.broadcast(spark.createDataFrame(list(shards.items()), "cell bigint, parts bigint"))
    placed = placed.join(heavy, "cell", "left").withColumn("shard", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    cells, leaves = calibrate(placed, tree, n, plan)
    none = F.lit(0).cast("bigint")
    base = placed.select("cell", "shard", F.lit(0).alias("visits"), "id", "v", "ids", none.alias("h1"), none.alias("h2"))
    guests = _visitors(vectors.filter(F.col("asked") > 0), shared, cells, shards)
    guests = guests.select("cell", "shard", F.lit(1).alias("visits"), F.lit(None).cast("bigint").alias("id"), "v", F.lit(None).cast("array<bigint>").alias("ids"), "h1", "h2")
    kind = pa.list_(pa.struct([("d", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, rows, guests in _subtrees(batches, plan):
            step = max(1, (1 << 21) // min(len(sub.x), leaves * plan.leaf))
            for lo in range(0, guests.num_rows, step):
                some = guests.slice(lo, step)
                d, at = sub.search(_matrix(some.column("v")), leaves, plan.k + 1)
                good = at >= 0
                ids = rows["ids"].combine_chunks().take(pa.array(at[good]))
                entries = pa.StructArray.from_arrays([pa.array(d[good]), ids], fields=list(kind.value_type))
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(good.sum(1))]), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([some.column("h1"), some.column("h2"), near], names=["h1", "h2", "near"])

    met = base.unionByName(guests).repartition("cell", "shard").sortWithinPartitions("cell", "shard", "visits", "id")
    found = met.mapInArrow(run, "h1 bigint, h2 bigint, near array<struct<d:double,ids:array<bigint>>>")
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, plan.k + 1)
    each = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct(e["d"].alias("d"), i.alias("id")))))
    best = found.groupBy("h1", "h2").agg(nearest.alias("near")).select("h1", "h2", F.slice(F.array_sort(each), 1, plan.k + 1).alias("near"))
    best = materialise(best, "best")
    hot = F.broadcast(vectors.filter(F.col("asked") > total / plan.hot).select("h1", "h2"))  # so they are fewer than plan.hot
    many = asked.join(F.broadcast(best.join(hot, ["h1", "h2"], "left_semi")), ["h1", "h2"])
    answers = many.unionByName(asked.join(hot, ["h1", "h2"], "left_anti").join(best, ["h1", "h2"]))
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, plan.k)
    return answers.select(F.col("id").alias(id_col), F.posexplode(others).alias("p", "e")).select(
        id_col, (F.col("p") + 1).alias("rank"), F.col("e.id").alias("neighbour"), F.round(F.sqrt("e.d"), 6).alias("distance")
    )
