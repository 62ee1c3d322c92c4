"""Exact top-k search by a dual-tree walk over cover trees.

Rows are dealt into cells, each of the rows nearest to one of a bounded number of
pivots, and cells into blocks of bounded size.  A block publishes its pivot and the
greatest distance from it, a cell of queries the same and the least kth score that its
queries have within one block of bounded size.  Where the largest inner product that
the two allow stays below that score, no vector of the one is sent to the other.  For
what is left, a task builds the cover tree of a block of rows and of the queries that
may have hits in it and walks both together, and leaves out pairs of nodes by the same
bound.  Queries come in large blocks, so a block's tree is built once for each of them;
no row meets a query outside such a pair of blocks, and no block grows with the data.

Defined cases: vectors that are null or hold null or non-finite components, or rows
without an id, take no part; vectors shorter or longer than the most usual length take
no part either; a query's own row is the one with its id; rows that repeat an id all
count; ties go to the smaller id; sums beyond 2^53 are whole numbers all the same, and a
score that no long holds is given as the nearest one; with fewer candidates than k all
are returned; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .vectors import dense, ranked, usable

_HITS = "query_id long, vec_id long, score long"
#: Up to here sums of whole numbers are exact in doubles.
_EXACT = 2.0**53
_LONG = 2**63


class CoverTree:
    """Nodes over a matrix whose rows are reordered so that a node's rows lie together.

    A node has a centre, the greatest distance of its rows from it, and children whose
    centres are over ``1 / base`` of that distance apart; small nodes are leaves.
    """

    def __init__(self, points: np.ndarray, leaf: int = 64, base: float = 1.6) -> None:
        self.order = np.arange(len(points))
        self.points = points
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._leaf, self._base = leaf, base
        if len(points):
            self._build()
        self.points = points[self.order]

    def _build(self) -> None:
        first = int(np.argmin(((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1)))
        todo = [self._node(0, len(self.points), self.points[first])]
        while todo:
            node = todo.pop()
            low, high = self.spans[node]
            if high - low <= self._leaf or not self.radii[node]:
                continue
            self.children[node] = self._split(node, low, high)
            todo += self.children[node]

    def _node(self, low: int, high: int, centre: np.ndarray) -> int:
        away = self.points[self.order[low:high]] - centre
        self.centres.append(centre)
        self.radii.append(float(np.sqrt((away * away).sum(axis=1).max())))
        self.spans.append((low, high))
        self.children.append([])
        return len(self.spans) - 1

    def _split(self, node: int, low: int, high: int) -> list[int]:
        """Cover a node's rows by centres over ``radius / base`` apart, the farthest row next, 64 at most."""
        rows = self.order[low:high]
        points = self.points[rows]
        apart = self.radii[node] / self._base
        centres = [self.centres[node]]
        nearest = np.zeros(len(rows), np.int64)
        distance = np.sqrt(((points - centres[0]) ** 2).sum(axis=1))
        while len(centres) < 64 and (far := int(np.argmax(distance))) >= 0 and (distance[far] > apart or len(centres) < 2):
            centre = points[far]
            other = np.sqrt(((points - centre) ** 2).sum(axis=1))
            closer = other < distance
            closer[far] = True
            nearest[closer] = len(centres)
            distance[closer] = other[closer]
            centres.append(centre)
        by_centre = np.argsort(nearest, kind="stable")
        self.order[low:high] = rows[by_centre]
        counts = np.bincount(nearest, minlength=len(centres))
        out, at = [], low
        for centre, n in zip(centres, counts.tolist(), strict=True):
            if n:
                out.append(self._node(at, at + n, centre))
                at += n
        return out


def _below(score: int) -> float:
    """A whole number as a double that is not above it."""
    return float(score) if abs(score) < _EXACT else float(np.nextafter(float(score), -np.inf))


def pair_bounds(products: np.ndarray, q_norms: np.ndarray, r_norms: np.ndarray, q_radii: np.ndarray, r_radii: np.ndarray) -> np.ndarray:
    """What no inner product between the rows around two centres exceeds, from the centres' products, norms and radii."""
    with np.errstate(all="ignore"):
        spread = q_norms[:, None] * r_radii + q_radii[:, None] * r_norms + q_radii[:, None] * r_radii
        top = products + spread
        top = top + 1e-6 * (1 + np.abs(products) + spread + q_norms[:, None] * r_norms)  # rounding never prunes a row
    return np.where(np.isnan(top), np.inf, top)


class DualSearch:
    """Best k rows of one tree for every query of another, by the inner product."""

    def __init__(self, queries: CoverTree, rows: CoverTree, query_ids: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.q, self.r, self.k = queries, rows, k
        self.query_ids, self.row_ids = query_ids[queries.order], row_ids[rows.order]
        self.floor = floor[queries.order]  # a score below it cannot count
        self.best: list[list[tuple[float, int]]] = [[] for _ in self.query_ids]  # heaps of (score, -id)
        self.worst = self.floor.copy()
        self.pairs = 0  # rows compared with queries
        largest = [np.sqrt((t.points * t.points).sum(axis=1)).max(initial=0.0) for t in (queries, rows)]
        self.whole = bool(largest[0] * largest[1] < _EXACT)  # doubles hold every score
        self._centres = [np.stack(t.centres) if t.centres else None for t in (queries, rows)]
        self._radii = [np.array(t.radii) for t in (queries, rows)]
        self._norms = [np.sqrt((c * c).sum(axis=1)) if c is not None else None for c in self._centres]

    def bounds(self, q: list[int], r: list[int]) -> np.ndarray:
        """For each pair of nodes, what no inner product between their rows exceeds."""
        cq, cr = self._centres[0][q], self._centres[1][r]
        rq, rr = self._radii[0][q], self._radii[1][r]
        nq, nr = self._norms[0][q], self._norms[1][r]
        return pair_bounds(cq @ cr.T, nq, nr, rq, rr)

    def run(self) -> None:
        if not len(self.query_ids) or not len(self.row_ids):
            return
        todo = [(0, 0, float(self.bounds([0], [0])[0, 0]))]
        while todo:
            q, r, bound = todo.pop()
            low, high = self.q.spans[q]
            if bound < self.worst[low:high].min():
                continue
            below_q, below_r = self.q.children[q], self.r.children[r]
            if not below_q and not below_r:
                self._compare(low, high, *self.r.spans[r])
                continue
            split_q = below_q and (not below_r or self._radii[0][q] >= self._radii[1][r])
            qs, rs = (below_q, [r]) if split_q else ([q], below_r)
            bounds = self.bounds(qs, rs)
            nexts = [(a, b, float(bounds[i, j])) for i, a in enumerate(qs) for j, b in enumerate(rs)]
            todo += sorted(nexts, key=lambda x: x[2])  # the most promising pair is walked first

    def _compare(self, q_low: int, q_high: int, r_low: int, r_high: int) -> None:
        q, r = self.q.points[q_low:q_high], self.r.points[r_low:r_high]
        if self.whole:
            scores = q @ r.T
        else:  # whole numbers of any size, brought to the nearest long
            scores = _integers(q) @ _integers(r).T
            scores = np.minimum(np.maximum(scores, -_LONG), _LONG - 1)
        self.pairs += scores.size
        ids = self.row_ids[r_low:r_high]
        hit_q, hit_r = np.nonzero(scores >= self.worst[q_low:q_high, None])
        for i, j in zip(hit_q.tolist(), hit_r.tolist(), strict=True):
            at, row = q_low + i, int(ids[j])
            if row == self.query_ids[at]:
                continue
            heap, entry = self.best[at], (int(scores[i, j]), -row)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.worst[at] = max(self.worst[at], _below(heap[0][0]))

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and scores found."""
        found = [(int(q), -n, s) for q, heap in zip(self.query_ids, self.best, strict=True) for s, n in heap]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], np.int64)


def _integers(x: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as whole numbers."""
    return np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component; a double beyond 2^53 has no fraction, and one that overflows is the largest."""
    top = F.lit(np.finfo(np.float64).max.item())

    def one(x: Column) -> Column:
        scaled = F.greatest(F.least(x.cast("double") * scale, top), -top)
        return F.when(F.abs(scaled) < F.lit(_EXACT), F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, one)


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (``id, v, is_query, h``) with the nearest pivot as ``cell`` and the distance from it as ``away``."""
    squares = (pivots * pivots).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = dense(batch.column(1))
                with np.errstate(all="ignore"):
                    cell = np.nan_to_num(squares - 2 * (x @ pivots.T)).argmin(axis=1)
                    apart = x - pivots[cell]
                    away = np.nan_to_num(np.sqrt((apart * apart).sum(axis=1)), nan=np.inf, posinf=np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["id", "v", "is_query", "h", "cell", "away"])

    return rows.select("id", "v", "is_query", "h").mapInArrow(run, "id long, v array<double>, is_query boolean, h long, cell int, away double")


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    row_block: int = 4096,
    query_block: int = 16384,
    first_block: int = 4096,
    most_cells: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest integer inner products of each query.

    ``is_query`` is a condition on the id column.  ``first_block`` rows, those with the
    smallest hash of their id, give every query its first kth score, and ``most_cells`` of
    them at most are pivots.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    clean = clean.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") > 0))
    rows = cut(clean.select("id", quantised(F.col("v")).alias("v"), "is_query", F.xxhash64("id").alias("h")))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries"))
    usual = sizes.orderBy(F.desc("rows"), "n").first()
    if usual is None or not usual.queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == usual.n)
    sample = rows.orderBy("h", "id").limit(first_block).select("id", "v")
    n_cells = min(most_cells, _blocks(usual.rows, row_block))
    pivots = np.array([r.v for r in rows.orderBy("h", "id").limit(n_cells).select("v").collect()])  # most_cells vectors at most
    rows = cut(_dealt(rows, pivots))

    def search(batches_q: pa.Table, batches_r: pa.Table, floors: np.ndarray | None) -> pa.Table:
        q_ids, r_ids = batches_q["id"].to_numpy(), batches_r["id"].to_numpy()
        floor = np.full(len(q_ids), -np.inf) if floors is None else floors
        with np.errstate(all="ignore"):  # what overflows prunes nothing
            walk = DualSearch(CoverTree(dense(batches_q["v"])), CoverTree(dense(batches_r["v"])), q_ids, r_ids, k, floor)
            walk.run()
        return pa.table(dict(zip(("query_id", "vec_id", "score"), walk.hits(), strict=True)))

    queries = rows.where("is_query").select("id", "v", "h", "cell", "away")

    # every query's kth score within the first block: a bound that no answer falls below
    parts = max(1, min(64, _blocks(usual.queries, 256)))
    spread_q = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).cast("int"))
    spread_s = sample.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def against_sample(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search(left, right, None).to_pandas()
        kth = found.groupby("query_id")["score"].agg(["min", "size"])
        floor = {i: _below(s) for i, s, n in kth.itertuples() if n == k}
        ids = left["id"].to_pylist()
        return pa.table({"id": pa.array(ids, pa.int64()), "floor": pa.array([floor.get(i) for i in ids], pa.float64())})

    floors = (
        spread_q.select("part", "id", "v").groupBy("part").cogroup(spread_s.select("part", "id", "v").groupBy("part")).applyInArrow(against_sample, "id long, floor double")
    ).groupBy("id").agg(F.max("floor").alias("floor"))
    asked = cut(queries.join(floors, "id", "left"))

    def against_block(left: pa.Table, right: pa.Table) -> pa.Table:
        floor = np.array([-np.inf if f is None else f for f in left["floor"].to_pylist()], np.float64)
        return search(left, right, floor)

    # cells: how many blocks of rows each has, what its queries ask at least, and where their blocks begin
    held = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asking = {r.cell: r for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("floor")).collect()}
    parts_of, first_of, filled, turn = {}, {}, 0, 0
    for cell, r in sorted(asking.items()):  # small cells share a block, large ones take several
        if filled and filled + r.n > query_block:
            filled, turn = 0, turn + 1
        parts_of[cell], first_of[cell] = _blocks(r.n, query_block), turn
        filled, turn = (filled + r.n, turn) if r.n <= query_block else (0, turn + parts_of[cell])
    by_cell = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("cell"))
    spread = by_cell({c: _blocks(n, row_block) for c, n in held.items()})
    rows = rows.withColumn("rb", F.col("cell").cast("long") * (1 << 32) + F.pmod("h", spread))
    asked = asked.withColumn("qb", by_cell(first_of) + F.pmod(F.xxhash64("id", F.lit(11)), by_cell(parts_of)).cast("int"))

    norms = np.sqrt((pivots * pivots).sum(axis=1))
    ask = sorted(asking)
    ask_away, ask_floor = np.array([asking[c].away for c in ask]), np.array([asking[c].floor for c in ask])

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, away = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            with np.errstate(all="ignore"):
                top = pair_bounds(pivots[ask] @ pivots[at].T, norms[ask], norms[at], ask_away, away)
            q, r = np.nonzero(top >= ask_floor[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(np.array(ask, np.int32)[q])], ["rb", "cell"])

    row_blocks = rows.groupBy("rb", "cell").agg(F.max("away").alias("away")).select("rb", "cell", "away")
    pairs = cut(row_blocks.mapInArrow(worth, "rb long, cell int"))
    by_row = asked.join(pairs, "cell")
    turns = asked.select("cell", "qb").distinct()
    meeting = cut(pairs.join(turns, "cell").select("rb", "qb").distinct())
    by_query = rows.select("id", "v", "rb").join(meeting, "rb")
    hits = (
        by_row.select("qb", "rb", "id", "v", "floor")
        .groupBy("qb", "rb")
        .cogroup(by_query.select(*(F.col(c).alias(c) for c in ("qb", "rb", "id", "v"))).groupBy("qb", "rb"))
        .applyInArrow(against_block, _HITS)
    )
    return ranked(hits, k)
