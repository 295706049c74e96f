"""Exact top-k inner-product search with two cover trees.

Vectors become integers floor(256 x).  The top levels of a cover tree over a bounded sample
give *cells*; every row goes to the cell of its nearest centre, and a cell's radius and
greatest norm cover all of its rows.  Large cells are split into blocks by hash.

1. Each query visits the cell whose centre scores best.  A task holds one block: it builds
   the block's cover tree, then one over each group of the queries that visit it, and walks
   both together.  The worst kth score of a query node prunes the block's nodes.
2. The kth score that a query then has is shared: the query visits only those other cells
   whose bound reaches it.

A node with centre p, covering radius R and greatest norm N cannot score above

    min( <q,p> + |q| R,  (|q|^2 + N^2 - max(0, d(q,p) - R)^2) / 2,  |q| N )

with a query q; for a query node the same with its own radius and norms.  What is left is
scored exactly, so the result is that of brute force.

Pruning needs structure: of 8,000 vectors in 200 tight clusters 1 % of the pairs are scored, of
random directions in 64 dimensions nearly all (no bound by radii can part them).

The trees have levels: a level's centres are the prefix of the farthest-first order whose
spacing is above ``BASE ** level``, so levels nest, centres of a level are separated by that
distance, and every row is within it of a centre.  A centre hangs below the nearest one
of the levels above.

Edge cases: vectors that are null or hold a null or non-finite component, and rows with
a null id, take no part; only vectors of equal length are compared; rows with the query's
own id are not its candidates; a query id that repeats is asked once, with its least
vector; ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrain.llm.common import slices, staged, table

SCALE = 256
TOP = 5
EVERY = 50
#: Rows of a leaf at which a branch is not divided further, about.
LEAF = 8
#: Ratio of the distances of two levels.
BASE = 1.3
#: Rows that the cells' centres are picked from, rows of a cell aimed at, and most cells (fewer for long vectors).
SAMPLE, CELL, CELLS, CELL_BYTES = 8192, 4096, 1024, 1 << 25
#: Rows of a block and of a group of queries that a task holds.
BLOCK, GROUP = 8192, 4096


def distances(x: np.ndarray, squares: np.ndarray, i: int) -> np.ndarray:
    return np.sqrt(np.maximum(squares + squares[i] - 2 * (x @ x[i]), 0))


def farthest_first(x: np.ndarray, most: int):
    """Up to ``most`` centres, each the row farthest from those before it.

    Returns the centres, their distances from those before, the parent of each (as a place
    in the order), each row's centre and distance.
    """
    squares = (x**2).sum(1)
    near, owner = distances(x, squares, 0), np.zeros(len(x), np.int64)
    centers, spacing, parent, level, above = [0], [np.inf], [-1], None, owner
    while len(centers) < most and near.max() > 0:
        i = int(near.argmax())
        at = int(np.floor(np.log(near[i]) / np.log(BASE)))
        if at != level:  # a new level: centres so far are those of the levels above
            level, above = at, owner.copy()
        parent.append(int(above[i]))
        spacing.append(float(near[i]))
        d = distances(x, squares, i)
        closer = d < near
        owner[closer] = len(centers)
        near = np.minimum(near, d)
        centers.append(i)
    return np.array(centers), np.array(spacing), np.array(parent), owner, near


class CoverTree:
    """Nodes over the rows of ``x``: centre row, level, radius, greatest norm, and children or rows."""

    def __init__(self, x: np.ndarray, leaf: int | None = None):
        self.x = x
        centers, spacing, parent, owner, _ = farthest_first(x, max(1, len(x) // (leaf or LEAF)))
        level = np.floor(np.log(spacing[1:]) / np.log(BASE)).astype(np.int64)
        below: list[dict] = [{} for _ in centers]  # level -> centres that hang there
        for j, (p, at) in enumerate(zip(parent[1:].tolist(), level.tolist(), strict=True), 1):
            below[p].setdefault(at, []).append(j)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(centers) + 1))
        norms = np.sqrt((x**2).sum(1))
        self.center: list[int] = []
        self.level: list[int | None] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        radius, norm = [], []

        def make(j: int, levels: list[int]) -> tuple[int, np.ndarray]:
            me = len(self.center)
            self.center.append(int(centers[j]))
            self.level.append(levels[0] if levels else None)
            self.children.append([])
            self.rows.append(None)
            radius.append(0.0)
            norm.append(0.0)
            if levels:
                parts = []
                for c, rest in [(j, levels[1:]), *((c, sorted(below[c], reverse=True)) for c in below[j][levels[0]])]:
                    child, held = make(c, rest)
                    self.children[me].append(child)
                    parts.append(held)
                mine = np.concatenate(parts)
            else:
                self.rows[me] = mine = order[ends[j] : ends[j + 1]]
            radius[me] = float(np.sqrt(((x[mine] - x[centers[j]]) ** 2).sum(1).max()))
            norm[me] = float(norms[mine].max())
            return me, mine

        self.root = make(0, sorted(below[0], reverse=True))[0]
        self.c = x[self.center]
        self.r, self.most = np.array(radius), np.array(norm)
        self.inner = np.array([bool(k) for k in self.children])


def bound(q: np.ndarray, s: float | np.ndarray, most: float | np.ndarray, c: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Highest score of any query within ``s`` of a row of ``q``, of norm ``most`` at most, with what the nodes ``c, r, n`` cover."""
    s, most = (np.broadcast_to(np.asarray(v, float), len(q))[:, None] for v in (s, most))
    dot = q @ c.T
    qq, cc = (q**2).sum(1)[:, None], (c**2).sum(1)[None, :]
    away = np.maximum(np.sqrt(np.maximum(qq + cc - 2 * dot, 0)) - r - s, 0)
    ball = dot + s * np.sqrt(cc) + r * (np.sqrt(qq) + s)
    best = np.minimum(np.minimum(ball, (most**2 + n**2 - away**2) / 2), most * n)
    return best + 1e-6 * most * n + 1  # for rounding


class _Best:
    """The k best of each query so far; ``floor``: kth scores that are known already."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.lists = k, [[] for _ in floor]
        self.worst = floor.astype(float)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        merged = heapq.nsmallest(self.k, [*self.lists[q], *zip((-scores).tolist(), ids.tolist(), strict=True)])
        self.lists[q] = merged
        if len(merged) == self.k:
            self.worst[q] = max(self.worst[q], -merged[-1][0])


class Block:
    """Candidate rows under a cover tree; rows are integers held in float64 or int64."""

    def __init__(self, px: np.ndarray, pid: np.ndarray):
        self.px, self.pid, self.tree = px, pid, CoverTree(px.astype(np.float64))
        #: Pairs scored exactly, and pairs asked for.
        self.scored, self.asked = 0, 0

    def search(self, qx: np.ndarray, qid: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query row the k best ``(-score, id)`` that reach its floor."""
        best = _Best(np.full(len(qx), -np.inf) if floor is None else floor, k)
        self.asked += len(qx) * len(self.px)
        qt, pt = CoverTree(qx.astype(np.float64)), self.tree

        def leaf(rows: np.ndarray, nodes: np.ndarray) -> None:
            q = qt.x[rows]
            norms = np.sqrt((q**2).sum(1))

            def bounds(at):
                return bound(q, 0.0, norms, pt.c[at], pt.r[at], pt.most[at])

            heap = [(-b.max(), n, b) for n, b in zip(nodes.tolist(), bounds(nodes).T, strict=True)]
            heapq.heapify(heap)
            while heap:
                top, n, b = heapq.heappop(heap)
                worst = best.worst[rows]
                if -top < worst.min():
                    return
                want = b >= worst
                if not want.any():
                    continue
                if pt.inner[n]:
                    kids = np.array(pt.children[n])
                    for kid, kb in zip(kids.tolist(), bounds(kids).T, strict=True):
                        if (kb >= worst).any():
                            heapq.heappush(heap, (-kb.max(), kid, kb))
                    continue
                asks, mine = rows[want], pt.rows[n]
                self.scored += len(asks) * len(mine)
                scores = qx[asks] @ self.px[mine].T
                good = (scores >= best.worst[asks][:, None]) & (qid[asks][:, None] != self.pid[mine][None, :])
                for i in np.flatnonzero(good.any(1)).tolist():
                    best.add(int(asks[i]), scores[i, good[i]], self.pid[mine[good[i]]])

        def walk(q: int, nodes: np.ndarray) -> np.ndarray:
            """Visits the rows below a query node and returns them."""
            if qt.rows[q] is not None:
                leaf(qt.rows[q], nodes)
                return qt.rows[q]
            under = []
            for child in qt.children[q]:
                rows = self._under(qt, child)
                at = slice(child, child + 1)
                near = nodes[bound(qt.c[at], qt.r[at], qt.most[at], pt.c[nodes], pt.r[nodes], pt.most[nodes])[0] >= best.worst[rows].min()]
                # nodes wider than the query node are opened before going down
                wide = pt.inner[near] & (pt.r[near] > qt.r[child])
                if wide.any():
                    near = np.concatenate([near[~wide], *(np.array(pt.children[n]) for n in near[wide])])
                under.append(walk(child, near) if len(near) else rows)
            return np.concatenate(under)

        walk(qt.root, np.array([pt.root]))
        return best.lists

    @staticmethod
    def _under(tree: CoverTree, node: int) -> np.ndarray:
        stack, out = [node], []
        while stack:
            n = stack.pop()
            if tree.rows[n] is not None:
                out.append(tree.rows[n])
            stack += tree.children[n]
        return np.concatenate(out)


def _matrix(rows: list) -> np.ndarray:
    x = np.array(rows, np.int64)
    return x if x.shape[1] else np.zeros((len(x), 1), np.int64)


#: A task's rows: role 0 is a block's row, role 1 a query with the kth score that it has.
DEALT = "cell int, salt int, size int, role int, vec_id long, v array<long>, floor long"


def _tasks(k: int, group: int):
    """Rows arrive sorted by ``cell, salt, size, role``; a block and a group of queries are held at a time."""

    def flush(block, queries):
        if block is None or not queries:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])
        q, ids = _matrix([r[1] for r in queries]), np.array([r[0] for r in queries], np.int64)
        floor = np.array([-np.inf if r[2] is None else r[2] for r in queries], float)
        # float64 is exact while no sum can reach 2**53
        if block.whole and float(np.abs(q).max()) * block.largest * q.shape[1] < 2.0**53:
            found = block.floats.search(q.astype(np.float64), ids, k, floor)
        else:
            found = block.ints.search(q, ids, k, floor)
        rows = [(i, n, int(-s)) for i, best in zip(ids.tolist(), found, strict=True) for s, n in best]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["query_id", "vec_id", "score"])

    class Held:
        """A block's rows, and its trees as they are needed."""

        def __init__(self, rows):
            x, ids = _matrix([r[1] for r in rows]), np.array([r[0] for r in rows], np.int64)
            self.largest = float(np.abs(x).max())
            self.whole = self.largest < 2.0**53
            self.made = {}
            self.make = lambda kind: self.made.setdefault(kind, Block(x.astype(kind), ids)) if kind not in self.made else self.made[kind]

        floats = property(lambda self: self.make(np.float64))
        ints = property(lambda self: self.make(np.int64))

    def run(batches):
        at, rows, queries, block = None, [], [], None
        for batch in slices(batches, 2048):
            for cell, salt, size, role, vec_id, v, floor in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (cell, salt, size) != at:
                    yield flush(block, queries)
                    at, rows, queries, block = (cell, salt, size), [], [], None
                if role == 0:
                    rows.append((vec_id, v))
                    continue
                if not rows and block is None:
                    continue
                if block is None:
                    block, rows = Held(rows), []
                queries.append((vec_id, v, floor))
                if len(queries) == group:
                    yield flush(block, queries)
                    queries = []
        yield flush(block, queries)

    return run


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v array<long>, size`` of the rows that take part."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")).withColumn("size", F.size("v"))


def centers(rows: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """By vector length the centres of at most ``cells`` cells, from ``SAMPLE`` rows in hash order."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("size", "v").collect()  # at most SAMPLE rows
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(r["size"], []).append(r.v)
    out = {}
    for size, own in by.items():
        x = _matrix(own).astype(np.float64)
        most = min(-(-cells * len(own) // len(sample)), max(1, CELL_BYTES // (8 * x.shape[1])))
        out[size] = x[farthest_first(x, max(1, most))[0]]
    return out


def _assign(shared):
    """Adds ``cell, away, norm``: the place of the nearest centre of the vector's length (-1 without one), the distance, the norm."""

    def run(batches):
        for batch in slices(batches):
            cell, away, norm = [], [], []
            for v in batch.column(1).to_pylist():
                x = _matrix([v]).astype(np.float64)[0]
                c = shared.value.get(len(v))
                d = np.sqrt(((c - x) ** 2).sum(1)) if c is not None else np.zeros(1)
                cell.append(int(d.argmin()) if c is not None else -1)
                away.append(float(d.min()))
                norm.append(float(np.sqrt((x**2).sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64()), pa.array(norm, pa.float64())], [*batch.schema.names, "cell", "away", "norm"])

    return run


def _visits(shared, cells, again: bool):
    """Rows of :data:`DEALT` for queries: one cell a query, or again all others whose bound reaches its floor.

    cells: by vector length the cells' ``number, radius, greatest norm, blocks``, of cells with rows only.
    """

    def run(batches):
        for batch in slices(batches):
            out = []
            for vec_id, v, size, floor in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = cells.value.get(size)
                if own is None:
                    continue
                number, radius, norm, blocks = own
                c = shared.value.get(size)
                at = np.zeros(1, np.int64)  # a length without centres is one cell
                if c is not None:
                    q = _matrix([v]).astype(np.float64)
                    first = int((c[number] @ q[0]).argmax())
                    at = np.array([first])
                    if again:
                        reach = bound(q, 0.0, np.sqrt((q**2).sum(1)), c[number], radius, norm)[0] >= (-np.inf if floor is None else floor)
                        reach[first] = False
                        at = np.flatnonzero(reach)
                elif again:
                    continue
                out += [(int(number[i]), s, size, 1, vec_id, v, floor) for i in at.tolist() for s in range(int(blocks[i]))]
                if len(out) > 5000:
                    yield _dealt(out)
                    out = []
            yield _dealt(out)

    kinds = [pa.int32()] * 4 + [pa.int64(), pa.list_(pa.int64()), pa.int64()]
    names = [x.split()[0] for x in DEALT.split(", ")]

    def _dealt(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``is_query`` names, against all rows."""
    spark = vectors.sparkSession
    plain = staged(quantised(vectors), "vectors")
    shared = spark.sparkContext.broadcast(centers(plain, min(CELLS, -(-plain.count() // CELL))))
    rows = staged(plain.mapInArrow(_assign(shared), "vec_id long, v array<long>, size int, cell int, away double, norm double"), "cells")
    # one row a cell: at most CELLS, and one for each vector length that the sample missed
    held = rows.groupBy("size", "cell").agg(F.max("away").alias("r"), F.max("norm").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    told: dict = {}
    for r in held.orderBy("size", "cell").collect():
        told.setdefault(r["size"], []).append((r.cell, r.r, r.n, r.blocks))
    cells = spark.sparkContext.broadcast({size: tuple(np.array(c) for c in zip(*own, strict=True)) for size, own in told.items()})
    blocks = rows.join(F.broadcast(held.select(F.col("size").alias("_s"), F.col("cell").alias("_c"), "blocks")), (F.col("size") == F.col("_s")) & (F.col("cell") == F.col("_c")))
    salt = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    blocks = blocks.select("cell", salt.alias("salt"), "size", F.lit(0).alias("role"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    n_blocks = sum(own[3] for x in told.values() for own in x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame, again: bool) -> DataFrame:
        visits = asked.select("vec_id", "v", "size", "floor").mapInArrow(_visits(shared, cells, again), DEALT)
        dealt = visits.union(blocks).repartition(max(1, n_blocks), "cell", "salt", "size").sortWithinPartitions("cell", "salt", "size", "role")
        found = dealt.mapInArrow(_tasks(k, GROUP), "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    queries = plain.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    if max((len(x) for x in told.values()), default=0) < 2:
        return searched(queries.withColumn("floor", F.lit(None).cast("long")), False).select("query_id", "rank", "vec_id", "score")
    first = staged(searched(queries.withColumn("floor", F.lit(None).cast("long")), False), "first")
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("floor"))
    second = searched(queries.join(kth, F.col("vec_id") == F.col("_q"), "left"), True)
    both = first.drop("rank").union(second.drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op3_cover_search": op3_cover_search}
ORACLE_SQL = {
    "op3_cover_search": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
