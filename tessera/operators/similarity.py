"""All-pairs and nearest-neighbour search by blocks of vectors.

Rows are dealt into blocks of bounded size by a hash; each pair of blocks is one
group, whose scores are matrix products of a stripe of rows with a block.  A row is sent once for each block, so there
are ``BLOCKS`` blocks, whose size grows with the table from ``LEAST`` to ``MOST`` rows, and what is sent grows with the rows;
only beyond ``BLOCKS * MOST`` rows are there more blocks.  Stripes bound the memory: what a stripe finds leaves the
group at once.  It is bounded by k a row, or by what passes the threshold.  Vectors that are null, or hold null, NaN or
infinite components, or are not of the most usual length, take no part; a zero vector
scores 0 with every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine

#: Rows of a block that are scored at a time, at most, and scores that are held at a time.
STRIPE, SCORES = 1024, 2**23
#: Columns of scores that are looked at together, by their largest alone at first.
TOGETHER = 16
#: Blocks, unless they would be smaller or larger than so many rows.
BLOCKS, LEAST, MOST = 8, 8192, 65536


def _unit(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def usual_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, v`` of the usable vectors of the most usual length (the shorter of equals), and how many there are."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.size("v") == (usual["length"] if usual else 0)), usual["count"] if usual else 0


def _block_pairs(vectors: DataFrame, id_col: str, vector_col: str, block: int | None):
    """Groups of each two blocks, and of each block alone: ``id, v, home`` with the row's block; ``a, b`` are the group's."""
    rows, n_rows = usual_vectors(vectors, id_col, vector_col)
    n = max(1, -(-n_rows // (block or min(max(-(-n_rows // BLOCKS), LEAST), MOST))))
    other, home = F.explode(F.sequence(F.lit(0), F.lit(n - 1))), F.col("home")
    met = rows.withColumn("home", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", other)
    return met.select("id", "v", "home", F.least(home, "other").alias("a"), F.greatest(home, "other").alias("b")).groupBy("a", "b")


def _sides(batches: Iterator[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of a group's two blocks, or of its one."""
    ids, x, home = [], [], []
    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        x.append(_unit(batch.column(1)))
        home.append(batch.column(2).to_numpy())
    ids, x, home = np.concatenate(ids), np.concatenate(x), np.concatenate(home)
    return [(ids[home == block], x[home == block]) for block in np.unique(home)]


def _stripes(x: np.ndarray, other: np.ndarray, digits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rounded cosines of a few rows at a time with all others, and where those rows begin."""
    rows = max(1, min(STRIPE, SCORES // max(1, len(other))))
    for at in range(0, len(x), rows):
        yield at, np.round(x[at : at + rows] @ other.T, digits)


def _first(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each row ``i``, ties to the smaller id."""
    best = np.lexsort((ids, -scores, i))
    return best[np.arange(len(i)) - np.searchsorted(i[best], i[best]) < k]


def _best(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids ``a``, ids ``b`` and rounded cosines of the ``k`` rows of ``y`` nearest to each row of ``x``, a few rows at a time.

    Scores in single precision choose what is scored in double precision: whatever may be among the best, with their error and
    the rounding as margin.  Rows for which that is much, or whose id repeats, are scored in double precision as a whole.
    """
    plain = np.arange(len(x))
    if len(y) >= 4 * TOGETHER * (k + 1):
        rest = []
        for at, found in _likely(x, y, k, digits):
            i, j, alike = found
            score, other = np.round(np.einsum("ij,ij->i", x[at + i], y[j]), digits), a[at + i] != b[j]
            n = len(alike)
            whole = alike | (np.bincount(i, ~other, n) > 1) | (np.bincount(i, other, n) < k)
            rest.append(at + np.flatnonzero(whole))
            keep = other & ~whole[i]
            i, j, score = i[keep], j[keep], score[keep]
            first = _first(i, b[j], score, k)
            yield a[at + i[first]], b[j[first]], score[first]
        plain = np.concatenate(rest) if rest else plain
    own, left = a[plain], x[plain]
    for at, scores in _stripes(left, y, digits):
        asked = own[at : at + len(scores)]
        scores[asked[:, None] == b] = -np.inf
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if k < scores.shape[1] else -np.inf
        i, j = np.nonzero((scores >= kth) & (scores > -np.inf))
        first = _first(i, b[j], scores[i, j], k)
        i, j = i[first], j[first]
        yield asked[i], b[j], scores[i, j]


def _likely(x: np.ndarray, y: np.ndarray, k: int, digits: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Where a few rows of ``x`` begin; their pairs with rows of ``y`` that may be among the ``k`` best, and which rows have too many to list.

    Columns are looked at by the largest of ``TOGETHER`` first: the largest but ``k`` of these is no more than the score at rank ``k`` without the row itself.
    """
    few, n = x.astype(np.float32), len(y) // TOGETHER
    many, margin = y.astype(np.float32).T.copy(), 2 * (x.shape[1] + 8) * 2.0**-24 + 10.0**-digits
    rows, steps = max(1, min(STRIPE, SCORES // len(y))), np.arange(TOGETHER) * n
    for at in range(0, len(x), rows):
        scores = few[at : at + rows] @ many
        tops = np.concatenate([scores[:, : n * TOGETHER].reshape(len(scores), TOGETHER, n).max(axis=1), scores[:, n * TOGETHER :]], axis=1)
        least = np.partition(tops, tops.shape[1] - k - 1, axis=1)[:, -k - 1] - np.float32(margin)
        i, group = np.nonzero(tops >= least[:, None])
        alike = np.bincount(i, minlength=len(scores)) > 8 * (k + 1)
        i, group = i[~alike[i]], group[~alike[i]]
        inside = group < n
        j = np.concatenate([(group[inside, None] + steps).ravel(), group[~inside] - n + n * TOGETHER])
        i = np.concatenate([np.repeat(i[inside], TOGETHER), i[~inside]])
        keep = scores[i, j] >= least[i]
        yield at, (i[keep], j[keep], alike)


def similar_pairs(
    vectors: DataFrame, threshold: float, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, block: int | None = None
) -> DataFrame:
    """``id1, id2, score`` of all pairs, each once, whose rounded cosine is at least ``threshold``; zero vectors score 0."""
    kind = vectors.schema[id_col].dataType

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, alone = _sides(batches), key[0].as_py() == key[1].as_py()
        if len(sides) == 2 or alone:
            (a, x), (b, y) = sides[0], sides[-1]
            for at, scores in _stripes(x, y, digits):
                i, j = np.nonzero(scores >= threshold)
                score, one, two = scores[i, j], a[at + i], b[j]
                if alone:
                    keep = one < two
                    score, one, two = score[keep], one[keep], two[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two), ids), pa.array(np.maximum(one, two), ids), pa.array(score)], ["id1", "id2", "score"])

    ids = to_arrow_type(kind)
    return _block_pairs(vectors, id_col, vector_col, block).applyInArrow(compare, f"id1 {kind.simpleString()}, id2 {kind.simpleString()}, score double")


def nearest(
    vectors: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, block: int | None = None
) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` rows of largest rounded cosine to each row, ties to the smaller id."""
    kind = vectors.schema[id_col].dataType

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, alone = _sides(batches), key[0].as_py() == key[1].as_py()
        ways = [(sides[0], sides[0])] if alone else [sides, sides[::-1]] if len(sides) == 2 else []
        for (a, x), (b, y) in ways:
            for one, two, score in _best(a, x, b, y, k, digits):
                yield pa.RecordBatch.from_arrays([pa.array(one, ids), pa.array(two, ids), pa.array(score)], ["query_id", "id", "score"])

    ids = to_arrow_type(kind)
    hits = _block_pairs(vectors, id_col, vector_col, block).applyInArrow(compare, f"query_id {kind.simpleString()}, id {kind.simpleString()}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def search(
    vectors: DataFrame, probe: Column, limit: int = 10, *, include_chunks: bool = False, node_type: str | None = None, digits: int = 6
) -> DataFrame:
    """``id, node_type, chunk_parent, score`` of the ``limit`` rows of largest cosine to a vector, ties to the smaller id.

    Rows are ``id, node_type, embedding, parent``.  Chunks take no part unless they are asked for, as a type or by
    ``include_chunks``, and then at most ``2 * limit`` of them; ``chunk_parent`` is null for what is no chunk.
    """
    rows = vectors.where(usable(F.col("embedding"))).where(F.size("embedding") == F.size(probe))
    is_chunk = F.col("node_type") == "chunk"
    scored = rows.select(
        "id", "node_type", F.when(is_chunk, F.col("parent")).alias("chunk_parent"), F.round(cosine(F.col("embedding"), probe), digits).alias("score")
    )
    best = lambda df, n: df.orderBy(F.desc("score"), "id").limit(n)
    if node_type is not None:
        return best(scored.where(F.col("node_type") == node_type), limit)
    entities = best(scored.where(~is_chunk), limit)
    return best(entities.unionByName(best(scored.where(is_chunk), 2 * limit)), limit) if include_chunks else entities
