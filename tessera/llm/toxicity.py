"""Toxicity: a counterfactually regularised classifier over words and word beginnings.

Labels and texts of a bounded sample train a logistic regression on the presence of
words and of their first letters.  Identity terms in labelled sentences are swapped
for others of their group, and the squared change of the score that a swap causes is
part of the loss, so a neutral mention of a group does not raise a score.  Screening
counts and the training rows come from Spark; the fit itself sees at most ``max_rows``
rows as a sparse matrix, of every feature that passes the screen.

Defined cases: null and empty texts have no features and get the intercept's score;
whole texts are scored, very long ones too; rows that repeat a ``doc_id`` are scored one
by one; a document with contradicting labels counts as toxic; null labels and labels
without a document are no labels; a null ``doc_id`` is never labelled nor held out;
features of equal strength pass the screen together; without both classes among the
labels every score is 0; empty tables give an empty result; other columns are carried,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
#: Lengths of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7)
#: Words longer than this are known by their beginnings alone.
LONGEST = 40
#: Words in a worker's table before it is begun anew.
KEPT = 100_000

#: Terms that stand in for each other within a group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


def word_features(word: str, prefixes: tuple[int, ...] = PREFIXES) -> tuple[str, ...]:
    """The features of one lower-case word: itself, and its beginnings marked by ^."""
    beginnings = tuple(f"^{word[:n]}" for n in prefixes if len(word) > n)
    return beginnings if len(word) > LONGEST else (word, *beginnings)


def text_features(words: set[str], prefixes: tuple[int, ...] = PREFIXES) -> set[str]:
    """The features of a set of words."""
    return {f for w in words for f in word_features(w, prefixes)}


def swapped(words: set[str], groups: tuple[tuple[str, ...], ...]) -> Iterator[set[str]]:
    """The words with the identity terms in them replaced by each other term of their group."""
    for group in groups:
        if present := words & set(group):
            for step in range(1, len(group)):
                yield (words - present) | {group[(group.index(w) + step) % len(group)] for w in present}


@dataclass
class ToxicityModel:
    """Weights by feature, intercept, and how the fit went."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -np.inf
    rows: int = 0
    pairs: int = 0
    prefixes: tuple[int, ...] = PREFIXES

    def score(self, words: set[str]) -> float:
        """Probability of the label for a set of lower-case words."""
        logit = self.intercept + sum(self.weights.get(f, 0.0) for f in sorted(text_features(words, self.prefixes)))
        return 0.0 if logit == -np.inf else float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a document belongs to the fold that labels are not learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


class SparseRows:
    """Rows of a matrix as the columns and values that are not zero."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> None:
        self.shape = len(sizes), width
        self.row, self.column, self.value = np.repeat(np.arange(len(sizes)), sizes), columns, values

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix times a vector."""
        return np.bincount(self.row, self.value * v[self.column], self.shape[0])

    def turned(self, r: np.ndarray) -> np.ndarray:
        """The transposed matrix times a vector."""
        return np.bincount(self.column, self.value * r[self.row], self.shape[1])


def fit_logistic(
    x: SparseRows, y: np.ndarray, swaps: SparseRows, swap_counts: np.ndarray, ridge: float, counterfactual: float, rounds: int = 60
) -> tuple[np.ndarray, float]:
    """Logistic loss, half a ridge, and ``counterfactual / 2`` times the squared score change of each swap, by Newton's method.

    Each step is solved by conjugate gradients, which need products with the sparse rows alone.
    """
    k = x.shape[1]
    own = np.append(np.full(k, ridge), 1e-6)

    def logits(v: np.ndarray) -> np.ndarray:
        return x.times(v[:k]) + v[k]

    def turned(r: np.ndarray) -> np.ndarray:
        return np.append(x.turned(r), r.sum())

    def fixed(v: np.ndarray) -> np.ndarray:
        return own * v + np.append(counterfactual * swaps.turned(swap_counts * swaps.times(v[:k])), 0.0)

    def loss(v: np.ndarray) -> float:
        z = logits(v)
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * v @ fixed(v))

    w = np.zeros(k + 1)
    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(logits(w), -500, 500)))
        gradient = turned(p - y) + fixed(w)
        curve = p * (1 - p)
        step, rest = np.zeros(k + 1), gradient.copy()
        towards, square = rest.copy(), float(rest @ rest)
        goal = 1e-12 * square
        for _ in range(2 * k + 20):
            if square <= goal:
                break
            bent = turned(curve * logits(towards)) + fixed(towards)
            size = square / float(towards @ bent)
            step += size * towards
            rest -= size * bent
            after = float(rest @ rest)
            towards = rest + after / square * towards
            square = after
        size = 1.0
        while (after := loss(w - size * step)) > at and size > 1e-6:
            size /= 2
        if after > at:
            break
        w, gain, at = w - size * step, at - after, after
        if gain < 1e-9 * max(1.0, abs(at)):
            break
    return w[:k], float(w[k])


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``toxic, text`` of at most ``max_rows`` labelled rows outside the held-out fold, a third of them toxic at most.

    The rows are those with the smallest hash of their id, so the choice is the same
    at every run; the ids of the sample are few by that bound and are broadcast.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    )
    by_hash = (F.xxhash64("_id"), F.col("_id"))
    toxic = known.where("_toxic = 1").orderBy(*by_hash).limit(max_rows // 3)
    clean = known.where("_toxic = 0").orderBy(*by_hash).limit(max_rows - max_rows // 3)
    chosen = cut(toxic.unionByName(clean))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").select(F.col("_toxic").alias("toxic"), F.col("_text").alias("text"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 9_000,
    min_rows: int = 3,
    min_strength: float = 2.5,
    ridge: float = 0.2,
    counterfactual: float = 50.0,
    prefixes: tuple[int, ...] = PREFIXES,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
    held: int = 400_000,
) -> ToxicityModel:
    """Fit the classifier on a sample of at most ``max_rows`` labelled rows.

    Features are screened by their log-odds ratio over its standard error: all of at least
    ``min_strength`` that stand in ``min_rows`` rows take part, and so do the features of
    identity terms.  ``cross_validate`` is how the defaults were chosen.  A task counts up to
    ``held`` features before it hands them on.
    """
    rows = cut(training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows))
    totals = rows.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    if not totals.toxic or not totals.clean:
        return ToxicityModel(rows=totals.toxic + totals.clean, prefixes=prefixes)
    identity = {w for g in groups for w in g}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(by_class[0].keys() | by_class[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in by_class)]
            for c in by_class:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_class[toxic].update(text_features(set(_WORD.findall((text.as_py() or "").lower())), prefixes))
                if len(by_class[0]) + len(by_class[1]) > held:
                    yield flush()
        yield flush()

    counted = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    a, b = F.col("toxic") + 0.5, F.lit(totals.toxic) - F.col("toxic") + 0.5
    c, d = F.col("clean") + 0.5, F.lit(totals.clean) - F.col("clean") + 0.5
    strength = F.abs(F.log(a) - F.log(b) - F.log(c) + F.log(d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    strongest = (
        counted.where(F.col("clean") + F.col("toxic") >= min_rows)
        .select("feature", strength.alias("strength"))
        .where(F.col("strength") >= min_strength)
    )
    names = sorted(r.feature for r in strongest.select("feature").collect())  # of at most max_rows texts
    names += sorted(text_features(identity, prefixes) - set(names))
    index = {f: i for i, f in enumerate(names)}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        kinds = [("toxic", pa.int32()), ("key", pa.int64()), ("has", pa.list_(pa.int32())), ("loses", pa.list_(pa.int32())), ("n", pa.int64())]
        schema = pa.schema(kinds)

        def indices(features: set[str]) -> tuple[int, ...]:
            return tuple(sorted(index[f] for f in features if f in index))

        for batch in batches:
            labels_, has = batch.column(0).to_pylist(), []
            for cell in batch.column(2):
                text = (cell.as_py() or "").lower()
                words = set(_WORD.findall(text))
                has.append(indices(text_features(words, prefixes)))
                if words & identity:
                    for sentence in _SENTENCE.split(text):
                        said = set(_WORD.findall(sentence))
                        if said & identity:
                            before = text_features(said, prefixes)
                            for other in swapped(said, groups):
                                after = text_features(other, prefixes)
                                pairs[indices(after - before), indices(before - after)] += 1
            nothing = pa.nulls(len(has), pa.list_(pa.int32()))
            ones = pa.array(np.ones(len(has), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(labels_, pa.int32()), batch.column(1), pa.array(has, pa.list_(pa.int32())), nothing, ones], schema=schema)
        if pairs:
            none = pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.int64())
            changed = [pa.array([p[k] for p in pairs], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*none, *changed, pa.array(list(pairs.values()), pa.int64())], schema=schema)

    keyed = rows.select("toxic", F.xxhash64("text").alias("key"), "text")
    found = keyed.mapInArrow(project, "toxic int, key long, has array<int>, loses array<int>, n long").toArrow()  # at most max_rows rows, and swaps by kind
    known = pc.is_valid(found["toxic"])
    # in an order of its own: that of labels and texts' hashes
    sample = found.filter(known).sort_by([("toxic", "ascending"), ("key", "ascending")]).combine_chunks()
    has = sample["has"].combine_chunks()
    x = SparseRows(pc.list_value_length(has).to_numpy(zero_copy_only=False), has.flatten().to_numpy(), np.ones(len(has.flatten())), len(names))
    y = sample["toxic"].to_numpy().astype(float)
    swaps = sorted(found.filter(pc.invert(known)).select(["has", "loses", "n"]).to_pylist(), key=lambda r: (r["has"], r["loses"], r["n"]))
    changes = SparseRows(
        np.array([len(r["has"]) + len(r["loses"]) for r in swaps], np.int64),
        np.array([i for r in swaps for i in (*r["has"], *r["loses"])], np.int64),
        np.array([v for r in swaps for v in (*[1.0] * len(r["has"]), *[-1.0] * len(r["loses"]))]),
        len(names),
    )
    counts = np.array([float(r["n"]) for r in swaps])
    w, intercept = fit_logistic(x, y, changes, counts, ridge, counterfactual)
    weights = {f: float(v) for f, v in zip(names, w, strict=True) if v}
    return ToxicityModel(weights, intercept, len(y), int(counts.sum()), prefixes)


def cross_validate(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", folds: int = 5, **fit) -> tuple[float, float]:
    """Mean log loss and share of wrong decisions on labelled rows, each by a model that did not see its fold.

    The held-out fold takes no part: the folds are the other remainders of the same hash.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    sums = np.zeros(3)
    for i in range(1, folds):
        rest = labels.where(fold != i)
        model = fit_toxicity(docs, rest, id_col=id_col, label_col=label_col, **fit)
        asked = docs.join(known.where(fold == i), id_col)
        p = F.least(F.greatest(F.col("_p"), F.lit(1e-9)), F.lit(1 - 1e-9))
        scored = score_toxicity(asked, model, score_col="_p")
        loss = -F.when(F.col("_toxic") == 1, F.log(p)).otherwise(F.log(1 - p))
        wrong = F.count_if((F.col("_p") >= 0.5) != (F.col("_toxic") == 1))
        sums += np.array(scored.agg(F.sum(loss), wrong, F.count("*")).first(), float)
    return sums[0] / sums[2], sums[1] / sums[2]


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of the label for each whole text in ``score_col``."""
    names = list(model.weights)
    weights = np.array([model.weights[f] for f in names])
    index = {f: i for i, f in enumerate(names)}
    intercept, prefixes = model.intercept, model.prefixes
    columns = [c for c in docs.columns if c != score_col]
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            logits = np.full(batch.num_rows, intercept)
            for i, cell in enumerate(batch.column(place)):
                active: set[int] = set()
                for word in set(_WORD.findall((cell.as_py() or "").lower())):
                    if (hit := table.get(word)) is None:
                        hit = tuple(index[f] for f in word_features(word, prefixes) if f in index)
                        if len(word) <= LONGEST:
                            if len(table) >= KEPT:
                                table.clear()
                            table[word] = hit
                    if hit:
                        active.update(hit)
                if active:
                    logits[i] += weights[sorted(active)].sum()
            scores = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            scores[logits == -np.inf] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, score_col])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(score_col, T.DoubleType())])
    return docs.select(*columns).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text_col: str = "text", **fit) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    model = fit_toxicity(docs, labels, text_col=text_col, **fit)
    score_col = "_" + "_".join(["toxicity", *docs.columns])  # clashes with no column
    return score_toxicity(docs, model, text_col=text_col, score_col=score_col).where(F.col(score_col) < threshold).select(*docs.columns)
