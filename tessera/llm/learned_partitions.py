"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into balanced parts by
moving vectors to the part that most of their neighbours are in while no part is over
its share; a small classifier learns the parts from the vectors.  Every row is indexed
under the part that the classifier finds likeliest, and a query is sent to its most
probable parts, whose rows are ranked by their exact inner products.  How many parts a
query visits is settled on the sample, so that the neighbours found there reach
``recall``, and a query goes on to further parts until those it visits hold over k rows
or there are no more.  A part of any size is searched whole, in blocks of bounded size.

Defined cases: vectors that are null, zero or hold null or non-finite components, or
rows without an id, take no part; nor do those shorter or longer than the most usual
length; a query's own row is the one with its id; rows that repeat an id all count, but
those that repeat a query's id are not its candidates; ties go to the smaller id; with
fewer candidates than k all are returned; other columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .vectors import dense, ranked, usable


@dataclass
class Router:
    """A classifier with one hidden layer: vector to log-probabilities of the parts; and how many to visit."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Scores of the parts for each row, in the order of their probabilities."""
        unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product for each row, itself excluded."""
    out = np.empty((len(x), k), np.int32)
    for low in range(0, len(x), 1024):
        scores = x[low : low + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(low, low + len(scores))] = -np.inf
        out[low : low + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 5) -> np.ndarray:
    """Part of each row: balanced to ``slack`` times the mean, with few graph edges between parts.

    It starts from the nearest of ``parts`` rows drawn at random and then moves rows,
    those that gain most first, to the part that holds most of their neighbours.
    """
    rng = np.random.default_rng(seed)
    room = int(np.ceil(slack * len(x) / parts))
    likes = x @ x[rng.choice(len(x), parts, replace=False)].T
    part = _fill(likes, room)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        rows = np.repeat(np.arange(len(x)), graph.shape[1])
        np.add.at(votes, (rows, part[graph.ravel()]), 1.0)
        np.add.at(votes, (graph.ravel(), part[rows]), 1.0)
        votes[np.arange(len(x)), part] += 0.5
        after = _fill(votes, room)
        moved = int((after != part).sum())
        part = after
        if moved < 0.005 * len(x):
            break
    return part


def _fill(likes: np.ndarray, room: int) -> np.ndarray:
    """Each row's best part that has room, the rows that care most first."""
    n, parts = likes.shape
    choices = np.argsort(-likes, axis=1, kind="stable")
    top = np.take_along_axis(likes, choices[:, :2], axis=1)
    keen = top[:, 0] - top[:, -1]
    out, used = np.full(n, -1), np.zeros(parts, int)
    for i in np.argsort(-keen, kind="stable").tolist():
        for p in choices[i]:
            if used[p] < room:
                out[i] = p
                used[p] += 1
                break
    return out


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 96, epochs: int = 25, seed: int = 3) -> Router:
    """Cross-entropy against the shares of a row's neighbours, and its own, among the parts; Adam."""
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    target[np.arange(len(x)), part] += 0.5 * graph.shape[1]
    target /= target.sum(axis=1, keepdims=True)
    d = x.shape[1]
    params = [rng.normal(0, np.sqrt(2 / d), (d, hidden)) * np.sqrt(d) / 2, np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 256):
            rows = order[low : low + 256]
            a = x[rows]
            h = np.maximum(a @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            e = (p - target[rows]) / len(rows)
            back = (e @ params[2].T) * (h > 0)
            grads = [a.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*params, visits=parts)


def fit_router(x: np.ndarray, parts: int, k: int, recall: float, graph_k: int = 10) -> Router:
    """Fit on a sample: the last fifth of it is kept back to settle how many parts a query visits.

    The neighbours of the rows kept back are looked for among the rest; in the whole
    table a query's neighbours are nearer than in the sample, and easier to route to.
    """
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    n = len(x) * 4 // 5
    if parts < 2 or n < max(4 * parts, 2 * graph_k, 2 * k):
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(unit[:n], graph_k)
    router = train_router(unit[:n], balanced_parts(unit[:n], graph, parts), graph, parts)
    home = router.logits(x[:n]).argmax(axis=1)
    asked = router.logits(x[n:])
    place = np.empty(asked.shape, int)
    np.put_along_axis(place, np.argsort(-asked, axis=1, kind="stable"), np.broadcast_to(np.arange(parts), asked.shape), axis=1)
    true = np.argpartition(-(x[n:] @ x[:n].T), k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, home[true], axis=1).ravel())
    router.visits = min(parts, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)
    return router


def approximate_topk(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    recall: float = 0.94,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 4096,
    rows_per_part: int = 2048,
    max_parts: int = 256,
    row_block: int = 8192,
    query_block: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query.

    A table of n rows has n / ``rows_per_part`` parts, 8 at least and ``max_parts`` at most.
    The router is fitted on ``sample_rows`` rows, or 64 a part if that is more (so at most
    ``64 * max_parts`` by default), those with the smallest hash of their id; every row is
    indexed.
    """
    clean = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    clean = clean.where(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = clean.withColumn("h", F.xxhash64("id"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries"))
    usual = sizes.orderBy(F.desc("rows"), "n").first()
    if usual is None or not usual.queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == usual.n)
    parts = int(np.clip(usual.rows // rows_per_part, 8, max_parts))
    drawn = rows.orderBy("h", "id").limit(max(sample_rows, 64 * parts)).select("v").collect()  # bounded by max_parts
    router = fit_router(np.array([r.v for r in drawn]), parts, k, recall)
    visits = router.visits

    def likely(batch: pa.RecordBatch) -> np.ndarray:
        """The parts of each row, the most probable first."""
        return np.argsort(-router.logits(dense(batch.column(1))), axis=1, kind="stable").astype(np.int32)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(likely(batch)[:, 0])], ["id", "v", "is_query", "h", "part"])

    held = cut(rows.select("id", "v", "is_query", "h").mapInArrow(home, "id long, v array<double>, is_query boolean, h long, part int"))
    # how many rows each part holds, and how many blocks they take; a row for each part
    blocks = cut(held.groupBy("part").agg(F.count("*").alias("n"), F.ceil(F.count("*") / row_block).cast("int").alias("rbs")))
    size = np.zeros(router.parts, np.int64)
    for r in blocks.collect():  # max_parts rows at most
        size[r.part] = r.n

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = likely(batch)
                enough = (np.cumsum(size[order], axis=1) <= k).sum(axis=1) + 1  # parts that hold over k rows, the query's own among them
                seen = [o[: max(visits, n)] for o, n in zip(order, enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int32()))], ["id", "v", "h", "parts"])

    routed = held.where("is_query").select("id", "v", "h").mapInArrow(visit, "id long, v array<double>, h long, parts array<int>")
    asked = cut(routed.select("id", "v", "h", F.explode("parts").alias("part")))
    query_blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qbs"))
    grid = F.broadcast(cut(blocks.drop("n").join(query_blocks, "part")))  # max_parts rows at most
    left = (
        asked.join(grid, "part")
        .withColumn("qb", F.pmod("h", F.col("qbs")).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)))
    )
    right = (
        held.join(grid, "part")
        .withColumn("rb", F.pmod("h", F.col("rbs")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    )

    def rerank(asks: pa.Table, rows_: pa.Table) -> pa.Table:
        q_ids, r_ids = asks["id"].to_numpy(), rows_["id"].to_numpy()
        q, r = dense(asks["v"]), dense(rows_["v"])
        found_q, found_r, found_s = [], [], []
        if len(q) and len(r):
            for low in range(0, len(q), 256):
                scores = q[low : low + 256] @ r.T
                scores[q_ids[low : low + 256, None] == r_ids] = -np.inf
                if k < len(r):
                    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
                    keep = scores >= kth - 1e-9 * (1 + np.abs(kth))  # ties, whatever the rounding
                else:
                    keep = np.ones(scores.shape, bool)
                i, j = np.nonzero(keep & (scores > -np.inf))
                exact = (q[low + i] * r[j]).sum(axis=1)  # the same order of summing for every pair
                best = np.lexsort((r_ids[j], -exact, i))
                i, j, exact = i[best], j[best], exact[best]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, exact = i[nth < k], j[nth < k], exact[nth < k]
                found_q.append(q_ids[low + i])
                found_r.append(r_ids[j])
                found_s.append(exact)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"query_id": join(found_q, np.int64), "vec_id": join(found_r, np.int64), "score": join(found_s, np.float64)})

    columns = ("part", "qb", "rb")
    hits = (
        left.select(*columns, "id", "v")
        .groupBy(*columns)
        .cogroup(right.select(*(F.col(c).alias(c) for c in (*columns, "id", "v"))).groupBy(*columns))
        .applyInArrow(rerank, "query_id long, vec_id long, score double")
    )
    return ranked(hits, k)
