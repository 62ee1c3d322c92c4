"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A text is its different words, hashed to a fixed number of buckets and scaled to unit
length, the bins of its structure statistics, and the bins of chosen metadata columns.
The score is the logistic of ``b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairs
cost no more than the features, as ``sum_{i<j} <v_i, v_j> x_i x_j`` is half of
``|sum v_i x_i|^2 - sum |v_i x_i|^2``.  Spark hashes the labelled rows and scores all texts;
the fit sees at most ``max_rows`` rows, as sparse vectors.

Defined cases: null and empty texts have statistics of their own bins and a score like any
other; whole texts are scored, very long ones too; rows that repeat a ``doc_id`` are scored
one by one; a document with contradicting labels counts as good; null labels and labels
without a document are no labels; a null ``doc_id`` is never labelled nor held out; rows of
one hash stand in the sample by their id; null metadata is a value of its own; with one class
only among the labels every score is that class, without labels 0.5; empty tables give an
empty result; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import log2
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .toxicity import held_out

#: Buckets of hashed words; bins of statistics and metadata follow them.
BUCKETS = 1 << 16
#: Bins of a statistic or of a metadata column.
BINS = 64
#: Words in a worker's table before it is begun anew.
KEPT = 100_000
#: Texts whose features are scored at a time.
_TEXTS = 256

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b".,;:!?'\"()-"
_BLANK = b" \t\n\r\x0b\x0c"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS)


def statistics(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Numbers from 0 to 1, or logarithms, that tell how a text is built."""
    size = max(len(data), 1)
    share = lambda kind: (len(data) - len(data.translate(None, kind))) / size
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = max(len(words), 1)
    return [
        log2(len(words) + 1) / 32,
        log2(len(data) / max(len(lines), 1) + 1) / 32,
        min(sum(map(len, words)) / n / 32, 1.0),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(set(lines)) / max(len(lines), 1),
        *(share(kind) for kind in (_UPPER, _DIGIT, _MARKS, _SYMBOL, b"!", _BLANK)),
    ]


STATISTICS = 13


def metadata_value(value: object) -> int:
    """The bin of a metadata value: of its logarithm if it is a number, else of its hash; null is bin 0."""
    if value is None:
        return 0
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return 1 + min(int(log2(abs(value) + 1)) if abs(value) < 2**61 else 61, 61)
    return 1 + crc32(str(value).encode("utf-8", "surrogatepass")) % (BINS - 1)


def hashed(text: bytes | None, metadata: tuple, table: dict[bytes, int], buckets: int = BUCKETS) -> tuple[list[int], float]:
    """The features of a text, words' buckets first, and the value that each of the words has."""
    data = text or b""
    words = data.lower().translate(_LETTERS).split()
    counts = Counter(words)
    found = []
    for word in counts:
        if (bucket := table.get(word)) is None:
            bucket = crc32(word) % buckets
            if len(word) <= 64:
                if len(table) >= KEPT:
                    table.clear()
                table[word] = bucket
        found.append(bucket)
    value = len(found) ** -0.5 if found else 0.0
    bins = [min(int(s * BINS), BINS - 1) for s in statistics(data, words, counts)]
    bins += map(metadata_value, metadata)
    found += [buckets + BINS * i + b for i, b in enumerate(bins)]
    return found, value


@dataclass
class QualityModel:
    """Intercept, weights and factors by feature, and what the features are."""

    intercept: float
    weights: np.ndarray
    factors: np.ndarray
    rows: int
    metadata_cols: tuple[str, ...]
    buckets: int

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of the label of each row; a row is the features from its start up to the next one's."""
        linear, sums, squares = pooled(index, value, starts, self.weights, self.factors)
        z = self.intercept + linear + 0.5 * (sums**2 - squares).sum(axis=1)
        scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        scores[z == -np.inf] = 0.0
        return scores


def pooled(index: np.ndarray, value: np.ndarray, starts: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the weighted sum, the sum of the factors, and the sum of their squares; no row is empty."""
    scaled = v[index] * value[:, None]
    return np.add.reduceat(w[index] * value, starts), np.add.reduceat(scaled, starts), np.add.reduceat(scaled**2, starts)


def fit_machine(
    index: np.ndarray, value: np.ndarray, starts: np.ndarray, y: np.ndarray, width: int, *,
    rank: int = 8, epochs: int | None = None, batch: int = 256, rate: float = 0.1, ridge: float = 1e-5, seed: int = 7,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, weights and factors by AdaGrad on the logistic loss; features that no row has get zeros.

    Without ``epochs`` about 24,000 rows are seen, in 6 to 60 rounds.
    """
    rng = np.random.default_rng(seed)
    n = len(starts)
    good = min(max(float(y.mean()), 1 / (n + 2)), 1 - 1 / (n + 2))
    b, w, v = float(np.log(good / (1 - good))), np.zeros(width), rng.normal(0, 0.05, (width, rank))
    seen = np.zeros(width, bool)
    seen[index] = True
    v[~seen] = 0
    past_b, past_w, past_v = 1e-6, np.full(width, 1e-6), np.full((width, rank), 1e-6)
    ends = np.append(starts[1:], len(index))
    for _ in range(epochs or min(max(24_000 // n, 6), 60)):
        order = rng.permutation(n)
        for low in range(0, n, batch):
            rows = order[low : low + batch]
            sizes = ends[rows] - starts[rows]
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = np.repeat(starts[rows] - begin, sizes) + np.arange(sizes.sum())
            i, x, r = index[at], value[at], np.repeat(np.arange(len(rows)), sizes)
            linear, sums, squares = pooled(i, x, begin, w, v)
            z = b + linear + 0.5 * (sums**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[rows]) / len(rows)
            own, inverse = np.unique(i, return_inverse=True)
            pull = error[r] * x
            grad_w = np.bincount(inverse, pull, len(own)) + ridge * w[own]
            change = pull[:, None] * (sums[r] - v[i] * x[:, None])
            grad_v = np.stack([np.bincount(inverse, change[:, f], len(own)) for f in range(rank)], axis=1) + ridge * v[own]
            past_b, past_w[own], past_v[own] = past_b + error.sum() ** 2, past_w[own] + grad_w**2, past_v[own] + grad_v**2
            b -= rate * error.sum() / past_b**0.5
            w[own] -= rate * grad_w / np.sqrt(past_w[own])
            v[own] -= rate * grad_v / np.sqrt(past_v[own])
    return b, w, v


def _flat(lists: list[list[int]], values: list[float], tail: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their values, and where each row starts; the last ``tail`` features of a row have the value 1."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(sizes)
    index = np.fromiter((i for found in lists for i in found), np.int64, int(ends[-1]))
    value = np.repeat(np.array(values), sizes)
    value[(ends[:, None] - 1 - np.arange(tail)).ravel()] = 1.0
    return index, value, ends - sizes


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int, metadata_cols: tuple[str, ...]) -> DataFrame:
    """``label, text`` and the metadata of at most ``max_rows`` labelled rows outside the held-out fold, those of the smallest hash of their id."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    )
    chosen = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))  # few by that bound, so broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(metadata_cols)])
    meta = [f"_m{i}" for i in range(len(metadata_cols))]
    return texts.join(F.broadcast(chosen), "_id").select(F.col("_label").alias("label"), F.col("_text").alias("text"), *meta)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    metadata_cols: tuple[str, ...] = ("n_chars",),
    max_rows: int = 6_000,
    buckets: int = BUCKETS,
    **machine,
) -> QualityModel:
    """Fit the machine on a sample of at most ``max_rows`` labelled rows; ``machine`` are settings of ``fit_machine``."""
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows, metadata_cols=metadata_cols)
    tail = STATISTICS + len(metadata_cols)
    width = buckets + BINS * tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            metadata = list(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)) or [()] * len(texts)
            found = [hashed(t, m, table, buckets) for t, m in zip(texts, metadata, strict=True)]
            lists = pa.array([f for f, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([x for _, x in found], pa.float64())], ["label", "has", "value"])

    got = rows.mapInArrow(run, "label int, has array<int>, value double").toArrow().to_pylist()  # at most max_rows sparse rows
    got.sort(key=lambda r: (r["label"], r["has"]))  # the same order at every run
    y = np.array([r["label"] for r in got], float)
    if len(set(y)) < 2:
        intercept = (np.inf if y[0] else -np.inf) if len(y) else 0.0
        return QualityModel(intercept, np.zeros(width, np.float32), np.zeros((width, 1), np.float32), len(y), metadata_cols, buckets)
    index, value, starts = _flat([r["has"] for r in got], [r["value"] for r in got], tail)
    b, w, v = fit_machine(index, value, starts, y, width, **machine)
    return QualityModel(b, w.astype(np.float32), v.astype(np.float32), len(y), metadata_cols, buckets)


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "quality") -> DataFrame:
    """``docs`` with the probability of the label for each whole text in ``score_col``."""
    columns = [c for c in docs.columns if c != score_col]
    place, meta = columns.index(text_col), [columns.index(c) for c in model.metadata_cols]
    tail = STATISTICS + len(meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, int] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(low, _TEXTS)
                metadata = list(zip(*(batch.column(i).to_pylist() for i in meta), strict=True)) or [()] * batch.num_rows
                found = [hashed(c.as_py(), m, table, model.buckets) for c, m in zip(batch.column(place).cast(pa.binary()), metadata, strict=True)]
                scores = model.score(*_flat([f for f, _ in found], [x for _, x in found], tail))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, score_col])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(score_col, T.DoubleType())])
    return docs.select(*columns).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_col: str = "text", **fit) -> DataFrame:
    """``docs`` without the documents that score under ``threshold``."""
    model = fit_quality(docs, labels, text_col=text_col, **fit)
    score_col = "_" + "_".join(["quality", *docs.columns])  # clashes with no column
    return score_quality(docs, model, text_col=text_col, score_col=score_col).where(F.col(score_col) >= threshold).select(*docs.columns)
