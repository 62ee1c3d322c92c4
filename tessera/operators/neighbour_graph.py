"""Approximate nearest neighbours by neighbour graphs of shards, searched by best-first walks.

Rows are dealt into shards of about ``SHARD`` rows by a hash of their id.  The graph links a row
with the nearest rows of its shard, which are found by comparing the shard's rows in full, so the work of
a row does not grow with the table.  A search sends every query to every shard and walks a shard's graph with many
queries at once: each round opens the best rows of a query's beam that were not open yet, compares
the query with those rows' neighbours, of either direction, and keeps the best; a walk ends when its beam has nothing
left to open.  What leaves a shard is its ``k`` best rows for each query; the best of all shards stay.  So every row is
indexed, and rows and links are shuffled once, not a vector for each compared pair.  Walks are queries times shards.

The number of compared rows comes back with the result.  Neighbours are found, not proven: recall
against ``similarity.nearest`` is measured in the tests.

Defined cases: as in ``similarity``, vectors that are null, not finite or not of the most
usual length take no part, and a zero vector scores 0; a row is no neighbour of itself;
ties go to the smaller id; ids are whole numbers and told apart by them, a repeated one has the smallest of its
vectors; with fewer rows than asked for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import _unit, usual_vectors

#: Rows of a shard, about; rows of a shard that are scored at a time; queries walked at a time, and of one group at most, about.
SHARD, STRIPE, WALKED, ASKED = 8192, 512, 64, 32768
#: A place without a row; odd, as places that were opened are.
NONE = np.iinfo(np.int64).max


def _shards(vectors: DataFrame, id_col: str, vector_col: str, shard: int) -> tuple[DataFrame, int]:
    """``id, v, shard`` of the rows that take part, and the number of shards."""
    rows, n = usual_vectors(vectors, id_col, vector_col)
    rows = rows.select(F.col("id").cast("long").alias("id"), "v").groupBy("id").agg(F.min("v").alias("v"))
    return rows.withColumn("shard", _shard(max(1, -(-n // shard)))), max(1, -(-n // shard))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def _places(scores: np.ndarray, rows: np.ndarray, n: int, digits: int) -> np.ndarray:
    """Score and row as one whole number, smaller for larger rounded scores and then for smaller rows; even: not opened."""
    return (10**digits - np.rint(scores * 10**digits).astype(np.int64)) * (2 * n) + 2 * rows


def _scores(places: np.ndarray, n: int, digits: int) -> np.ndarray:
    return (10**digits - places // (2 * n)) / 10**digits


def build(vectors: DataFrame, *, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, shard: int = SHARD) -> DataFrame:
    """``id, near, score``: the ``k`` nearest rows of each row by rounded cosine within its shard."""
    rows, _ = _shards(vectors, id_col, vector_col, shard)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, x, n = table["id"].to_numpy(), _unit(table["v"]), table.num_rows
        best = [np.zeros((0, 1), np.int64)]
        for at in range(0, n if n > 1 else 0, STRIPE):
            places = _places(x[at : at + STRIPE] @ x.T, np.arange(n), n, digits)
            places[np.arange(len(places)), np.arange(at, at + len(places))] = NONE
            some = min(k, n - 1)
            best.append(np.partition(places, some - 1, axis=1)[:, :some])
        places = np.concatenate(best[1:] or best)
        near = ids[places % (2 * n) // 2].ravel()
        return pa.table({"id": np.repeat(ids[: len(places)], places.shape[1]), "near": near, "score": _scores(places.ravel(), n, digits)})

    return rows.groupBy("shard").applyInArrow(compare, "id long, near long, score double")


def _both_ways(a: np.ndarray, b: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of ``n`` rows its neighbours and up to ``k`` rows, the nearest, that have it as one; -1 where there are no more."""
    order = np.lexsort((a, -score, b))
    back = order[np.arange(len(order)) - np.searchsorted(b[order], b[order]) < k]
    links = np.unique(np.concatenate([a * n + b, b[back] * n + a[back]]))
    row, to = links // n, links % n
    place = np.arange(len(links)) - np.searchsorted(row, row)
    table = np.full((n, int(place.max(initial=-1)) + 1), -1)
    table[row, place] = to
    return table


def _walk(x: np.ndarray, links: np.ndarray, start: np.ndarray, q: np.ndarray, own: np.ndarray, beam: int, open_at_once: int, digits: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The beams of some queries after their walks, best first, and how many rows each was compared with; ``own``: a query's row, or -1."""
    n, here = len(x), own >= 0
    seen = np.zeros((len(q), n), bool)
    seen[:, start] = True
    places = _places(q @ x[start].T, start, n, digits)
    places[own[:, None] == start] = NONE
    seen[here, own[here]] = True
    held = np.sort(places, axis=1)[:, :beam]
    for _ in range(limit):
        closed = held % 2 == 0
        i, j = np.nonzero(closed & (np.cumsum(closed, axis=1) <= open_at_once))
        if not len(i):
            break
        to = links[held[i, j] % (2 * n) // 2]
        held[i, j] += 1
        reached = (i[:, None] * n + to)[to >= 0]
        reached = np.unique(reached[~seen.ravel()[reached]])
        seen.ravel()[reached] = True
        a, b = reached // n, reached % n
        place = np.arange(len(a)) - np.searchsorted(a, a)
        fresh = np.full((len(q), int(place.max(initial=-1)) + 1), -1)
        fresh[a, place] = b
        places = _places((x[fresh] @ q[:, :, None])[:, :, 0], fresh, n, digits)
        places[fresh < 0] = NONE
        held = np.sort(np.concatenate([held, places], axis=1), axis=1)[:, :beam]
    return held, seen.sum(axis=1) - here


def search(
    vectors: DataFrame, graph: DataFrame, asked: Column, *, k: int = 10, beam: int = 64, open_at_once: int = 4, entries: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, limit: int = 200, shard: int = SHARD,
) -> DataFrame:
    """``query_id, rank, id, score, compared`` of the rows found nearest to each row where ``asked`` holds.

    ``graph`` is what ``build`` gives for the same rows and ``shard``; links between shards are not walked.
    ``compared`` is the number of rows that the query was compared with.  A wider ``beam`` finds more; it is at least ``k``.
    Walks begin at ``entries`` rows of a shard, four times the square root of its rows, 32 to 1,024, unless told; clusters without
    an entry that no neighbour leads to are not found.
    """
    rows, shards = _shards(vectors, id_col, vector_col, shard)
    named = vectors.where(asked).select(F.col(id_col).cast("long").alias("id")).distinct()
    wanted = rows.join(named, "id", "left_semi").select("id", "v")
    parts = max(1, -(-named.count() // ASKED))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    held = rows.select("shard", "id", "v", none.cast("long").alias("near"), none.cast("double").alias("score")).unionByName(
        graph.select(_shard(shards).alias("shard"), "id", none.cast(rows.schema["v"].dataType).alias("v"), "near", "score")
    ).withColumn("part", every(parts))
    queries = wanted.select(F.col("id").alias("id"), F.col("v").alias("v"), part.alias("part"), every(shards).alias("shard"))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        is_row = pa.compute.is_null(left["near"])
        table, linked = left.filter(is_row).sort_by("id"), left.filter(pa.compute.invert(is_row))
        found = []
        if table.num_rows and right.num_rows:
            ids, x = table["id"].to_numpy(), _unit(table["v"])
            n = len(ids)
            a, b, score = (linked[c].to_numpy() for c in ("id", "near", "score"))
            inside = np.isin(a, ids) & np.isin(b, ids)
            links = _both_ways(np.searchsorted(ids, a[inside]), np.searchsorted(ids, b[inside]), score[inside], n, k)
            some = min(entries or min(max(int(4 * n**0.5), 32), 1024), n)
            start = np.sort(np.random.default_rng(11).permutation(n)[:some])
            for at in range(0, right.num_rows, WALKED):
                few = right.slice(at, WALKED)
                named = few["id"].to_numpy()
                near = np.minimum(np.searchsorted(ids, named), n - 1)
                places, compared = _walk(x, links, start, _unit(few["v"]), np.where(ids[near] == named, near, -1), max(beam, k), open_at_once, digits, limit)
                places = places[:, :k]
                i, j = np.nonzero(places < NONE)
                found.append(pa.table({"query_id": named[i], "id": ids[places[i, j] % (2 * n) // 2], "score": _scores(places[i, j], n, digits), "compared": np.where(j == 0, compared[i], 0)}))
        kinds = pa.schema({"query_id": pa.int64(), "id": pa.int64(), "score": pa.float64(), "compared": pa.int64()})
        return pa.concat_tables(found) if found else kinds.empty_table()

    dealt = lambda df: df.repartition(shards * parts, "shard", "part").groupBy("shard", "part")
    met = dealt(held).cogroup(dealt(queries)).applyInArrow(walk, "query_id long, id long, score double, compared long")
    by = Window.partitionBy("query_id")
    ranked = met.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "id"))).withColumn("compared", F.sum("compared").over(by))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "compared")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, recall``: the share of the exact rows ``query_id, id`` that were found, over their queries."""
    hit = exact.join(found.select("query_id", "id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.coalesce(F.sum("_hit"), F.lit(0)) / F.count("*")).alias("recall"))
