"""Vector code compression: codebooks of vector parts, with LAESA pivots in the assignments.

A vector becomes whole numbers and is cut into equal parts; each part position has a
codebook of ``entries`` rows, moved in rounds to the floors of its parts' means.  The
distances of every part to a few fixed pivots are computed once and kept beside it.  In
each round the pivots' distances to the entries give a lower bound of every part's
distance to every entry, by the triangle inequality; entries are tried by rising bounds,
and exact whole-number distances are computed only while a bound does not exceed the best
distance so far.  Codebooks and pivots are of a fixed size, so tasks get them whole; a task
hands on one sum for each entry.

Defined cases: vectors that are null or hold null or non-finite components are dropped;
shorter vectors count as filled up with zeros to the longest one, and lengths that do not
divide into parts to the next that does; components beyond the range in which squared
distances fit a long (about 2^27 at 64 components a part) are set to its bounds; ties of
distances go to the lower entry; of rows that repeat a ``vec_id`` the ones of smaller
components come first, and null ids last; with fewer vectors than entries the codebook is
as long as the table; an empty table gives an empty result; null labels are one label; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .vectors import dense, usable

#: Entries of which exact distances are computed at a time, in the order of their bounds.
_STEP = 8
#: Rows that are assigned at a time.
_ROWS = 2048


@dataclass
class Codebooks:
    """``entries[part, entry, position]`` and the fixed ``pivots[part, pivot, position]``."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in order."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``a`` to every row of ``b``."""
    return np.sqrt(np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1).astype(float)) if len(b) else np.zeros((len(a), 0))


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: the first one, then each time the one farthest from those chosen."""
    chosen, far = [0], distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part its nearest entry, ties to the lower one, its squared distance, and how many distances were computed."""
    n, k = len(parts), len(entries)
    bound = np.zeros((n, k))
    for i in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, i, None] - entry_pivots[None, :, i]), out=bound)
    # a bound holds but for rounding, so it is lowered by more than that before it prunes
    bound = np.maximum(bound * (1 - 1e-9) - 1e-3, 0.0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    tried, alive = np.zeros(n, np.int64), np.arange(n)
    for low in range(0, k, _STEP):
        alive = alive[bound[alive, order[alive, low]] <= best[alive]]
        if not len(alive):
            break
        asked = order[alive, low : low + _STEP]
        squared = ((parts[alive, None, :] - entries[asked]) ** 2).sum(axis=2)
        tried[alive] += asked.shape[1]
        least = squared.min(axis=1)
        own = np.where(squared == least[:, None], asked, k).min(axis=1)
        better = (least < best[alive]) | (least == best[alive]) & (own < found[alive])
        best[alive[better]], found[alive[better]] = least[better], own[better]
    return found, best, tried


def whole_parts(vectors: DataFrame, width: int, *, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, whole`` of the usable vectors: components times ``scale``, floored, filled up to ``width``."""
    limit = 1 << int((62 - np.log2(max(width, 1))) / 2 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.zeros((batch.num_rows, width), np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            with np.errstate(over="ignore"):
                whole[row, place] = np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64)
            ends = np.arange(0, whole.size + 1, width, dtype=np.int32) if width else np.zeros(batch.num_rows + 1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(whole.ravel()))], ["vec_id", "label", "whole"])

    kept = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fields = [*kept.schema.fields[:2], T.StructField("whole", T.ArrayType(T.LongType()))]
    return kept.mapInArrow(run, T.StructType(fields))


def _assigned(batch: pa.RecordBatch, books: Codebooks, first: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Slices of a batch with their parts and each part's nearest entries; columns ``first`` and the next hold components and pivot distances."""
    count, _, size = books.entries.shape
    entry_pivots = [distances(e, p) for e, p in zip(books.entries, books.pivots, strict=True)]
    for low in range(0, batch.num_rows, _ROWS):
        rows = batch.slice(low, _ROWS)
        parts = dense(rows.column(first)).astype(np.int64).reshape(rows.num_rows, count, size)
        known = dense(rows.column(first + 1)).reshape(rows.num_rows, count, -1)
        yield rows, parts, [nearest(parts[:, i], known[:, i], books.entries[i], entry_pivots[i]) for i in range(count)]


def with_pivots(whole: DataFrame, books: Codebooks) -> DataFrame:
    """``whole`` with ``to_pivots``, the distances of every part to its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, _, size = books.entries.shape
        for batch in batches:
            parts = dense(batch.column(2)).astype(np.int64).reshape(batch.num_rows, count, size)
            far = np.concatenate([distances(parts[:, i], books.pivots[i]) for i in range(count)], axis=1)
            ends = np.arange(0, far.size + 1, max(far.shape[1], 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], [*batch.schema.names, "to_pivots"])

    return whole.mapInArrow(run, T.StructType([*whole.schema.fields, T.StructField("to_pivots", T.ArrayType(T.DoubleType()))]))


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: floors of the means of the parts that each entry is nearest to."""
    count, k, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = np.zeros((count, k, size), np.int64), np.zeros((count, k), np.int64)
        for batch in batches:
            for _, parts, found in _assigned(batch, books, 0):
                for i, (entry, _, _) in enumerate(found):
                    np.add.at(sums[i], entry, parts[:, i])
                    used[i] += np.bincount(entry, minlength=k)
        part, entry = np.nonzero(used)
        names = ["part", "entry", "used", *[f"s{i}" for i in range(size)]]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(used[part, entry]), *map(pa.array, sums[part, entry].T)], names)

    schema = ", ".join(["part long, entry long, used long", *[f"s{i} long" for i in range(size)]])
    totals = rows.select("whole", "to_pivots").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("used").alias("used"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)])
    entries = books.entries.copy()
    for row in totals.collect():  # one for each entry in use
        entries[row.part, row.entry] = np.array(row[3:], np.int64) // row.used
    return Codebooks(entries, books.pivots)


def fit_codebooks(vectors: DataFrame, *, entries: int = 256, parts: int = 4, rounds: int = 4, pivots: int = 8, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[Codebooks, DataFrame]:
    """The codebooks after ``rounds`` rounds, and the vectors with their distances to the pivots."""
    longest = vectors.where(usable(F.col(vector_col))).agg(F.max(F.size(vector_col))).first()[0]
    size = -(-(longest or 0) // parts)
    whole = cut(whole_parts(vectors, size * parts, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    start = np.array([r.whole for r in first], np.int64).reshape(len(first), parts, size).transpose(1, 0, 2)
    books = Codebooks(start, np.stack([choose_pivots(e, pivots) for e in start]) if len(first) else start)
    rows = cut(with_pivots(whole, books))
    for _ in range(rounds if len(first) else 0):
        books = moved(rows, books)
    return books, rows


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error, tried``: two hex digits a part, the squared distances summed, and how many were computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, _, found in _assigned(batch, books, 2):
                codes = ["".join(f"{e:02x}" for e in row) for row in zip(*(f[0].tolist() for f in found), strict=True)]
                error, tried = sum(f[1] for f in found), sum(f[2] for f in found)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(codes), pa.array(error), pa.array(tried)], ["vec_id", "label", "code", "error", "tried"])

    more = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("tried", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *more]))


def vector_codes(vectors: DataFrame, **fit) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, tried`` of every usable vector."""
    books, rows = fit_codebooks(vectors, **fit)
    coded = cut(encode(rows, books))
    of_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "tried")
