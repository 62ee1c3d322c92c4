"""Quality scores, source divergence and vector codes on small fixtures, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, divergence, quality, queries

# --- quality --------------------------------------------------------------------------------------------------------


def test_pairs_by_the_sum_of_squares_equal_all_pairs():
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=20), rng.normal(size=(20, 4))
    rows = [rng.choice(20, n, replace=False) for n in (1, 5, 9)]
    value = [rng.normal(size=len(r)) for r in rows]
    starts = np.array([0, 1, 6])
    linear, sums, squares = quality.pooled(np.concatenate(rows), np.concatenate(value), starts, w, v)
    for i, (r, x) in enumerate(zip(rows, value, strict=True)):
        want = sum(w[a] * p for a, p in zip(r, x, strict=True)) + sum(v[r[a]] @ v[r[b]] * x[a] * x[b] for a, b in combinations(range(len(r)), 2))
        assert linear[i] + 0.5 * (sums[i] ** 2 - squares[i]).sum() == pytest.approx(want)


def test_machine_learns_what_only_pairs_tell():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (2000, 2))  # the label is whether the two features agree
    index = np.array([[a, 2 + b] for a, b in bits]).ravel()
    y = (bits[:, 0] == bits[:, 1]).astype(float)
    starts = np.arange(0, len(index), 2)
    b, w, v = quality.fit_machine(index, np.ones(len(index)), starts, y, 4, epochs=30)
    model = quality.QualityModel(b, w, v, len(y), (), 4)
    assert ((model.score(index, np.ones(len(index)), starts) >= 0.5) == (y == 1)).all()


def quality_tables(spark, n=400):
    rng = random.Random(2)
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(n)]
    texts = [t if i % 5 else " ".join(f"{w}###" for w in t.upper().split()) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(n)], "doc_id long, quality int")
    return docs, labels


def test_quality_learns_and_covers_edge_cases(spark):
    docs, labels = quality_tables(spark)
    model = quality.fit_quality(docs, labels.unionByName(spark.createDataFrame([(None, 1), (7, None), (9999, 0)], labels.schema)))
    more = spark.createDataFrame([(None, None, None, None), (1000, "", 0, ""), (1001, "a wo b", None, ""), (1001, "a wo b", None, ""), (1002, "woaa " * 100_000, 500_000, "")], docs.schema)
    rows = quality.score_quality(docs.unionByName(more), model, score_col="good").collect()
    assert len(rows) == 405 and all(0 <= r.good <= 1 for r in rows)
    assert all((r.good >= 0.3) == bool(r.doc_id % 5) for r in rows if r.doc_id is not None and r.doc_id < 400)
    again = quality.fit_quality(docs.repartition(7), labels)
    assert np.array_equal(again.weights, model.weights) and again.rows == model.rows  # of any partitioning the same
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 5}


def test_quality_without_labels_or_rows(spark):
    docs, labels = quality_tables(spark, 20)
    score = lambda found: {r.quality for r in quality.score_quality(docs, quality.fit_quality(docs, found)).collect()}
    assert score(labels.where("false")) == {0.5}
    assert score(labels.where("quality = 1")) == {1.0} and score(labels.where("quality = 0")) == {0.0}
    assert quality.score_quality(docs.where("false"), quality.fit_quality(docs.where("false"), labels)).count() == 0


def test_quality_on_the_held_out_fold(spark):
    rows = queries.op11_quality(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = rows.join(labels.where("quality IS NOT NULL"), "doc_id").groupBy("quality", "predicted").count().collect()
    by = {(r.quality, r.predicted): r["count"] for r in seen}
    good, bad = by.get((1, 1), 0) + by.get((1, 0), 0), by.get((0, 1), 0) + by.get((0, 0), 0)
    assert by.get((1, 1), 0) >= 0.99 * good and by.get((0, 0), 0) >= 0.9 * bad


# --- divergence -----------------------------------------------------------------------------------------------------


def plain_divergence(rows, min_docs=3, top=200):
    docs = [(t or "", la or "", s or "") for t, la, s in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in docs]
    spread, counts, groups = defaultdict(Counter), defaultdict(Counter), {(la, s) for _, la, s in docs}
    for (_, la, s), found in zip(docs, terms, strict=True):
        spread[la].update(set(found))
        counts[la, s].update(found)
    out = []
    for la, s in groups:
        kept = [t for t, n in spread[la].items() if n >= min_docs]
        every = Counter()
        for g, c in counts.items():
            if g[0] == la:
                every.update(c)

        def p(c, kept=kept):
            whole = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // whole for t in kept}

        own, lang = p(counts[la, s]), p(every)
        pairs = []
        for la2, s2 in groups:
            if la2 == la and s2 != s:
                other = p(counts[la2, s2])
                pairs.append((sum((own[t] - other[t]) ** 2 // other[t] for t in kept), s2))
        found = [((own[t] - lang[t]) ** 2 // lang[t], t) for t in kept if counts[la, s][t] and own[t] > lang[t]]
        for part, items, most in (("pair", pairs, None), ("term", found, top)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(la, s, part, item, value, i) for i, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def divergence_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abä日x", k=rng.choice([1, 2, 3, 4, 5, 8, 9, 17, 40]))) for _ in range(120)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for _ in range(150)]
    rows += [(None, "fr", "z"), ("", "fr", "y"), ("123 _ .", "es", "only"), ("Same Same", "en", "a"), ("Same Same", "en", "a"), ("ab" * 50_000, "en", "b"), ("tip", "it", "p"), ("tip", "it", "q"), ("tip tip", "it", "q")]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_divergence_against_plain_loops(spark, seed):
    rows = divergence_rows(seed)
    docs = spark.createDataFrame([(*r, i, "x", 1) for i, r in enumerate(rows)], "text string, lang string, source string, doc_id int, term string, docs int")
    got = sorted(tuple(r) for r in divergence.source_divergence(docs.repartition(5)).collect())
    assert got == plain_divergence(rows)


def test_divergence_without_a_broadcast(spark):
    rows = divergence_rows(3)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, top=3, small=0).collect())
    assert got == plain_divergence(rows, top=3)
    assert divergence.source_divergence(docs.where("false")).count() == 0


def test_prefix_counts_are_of_different_documents():
    block = divergence._Block()
    block.add(b"abcdX abcdY abcdefgh", b"en", b"s")
    block.add(b"abcdz", b"en", b"s")
    assert block.docs[b"en", 4] == {b"abcd": 2} and block.docs[b"en", 8] == {b"abcdefgh": 1}


# --- vector codes ---------------------------------------------------------------------------------------------------


def plain_codes(rows, entries, parts=4, rounds=4):
    kept = sorted((i, [int(np.floor(1024 * float(x))) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                if own := [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = defaultdict(int)
    for (_, _, la), e in zip(kept, errors, strict=True):
        labels[la] += e
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, labels[la]) for (i, _, la), f, e in zip(kept, found, errors, strict=True))


def test_codes_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(6)] + 0.1 * rng.normal(size=8))], None if i % 7 == 0 else i % 3) for i in range(300)]
    rows += [(1000, rows[5][1], 1), (1001, [0.0] * 8, 2), (1002, [0.0] * 8, 2), (2000, None, 1), (2001, [float("nan")] * 8, 1), (2002, [None] + [0.5] * 7, 1), (2003, [float("inf")] * 8, 1)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, whole int")
    got = codes.vector_codes(table.repartition(5), entries=40)
    assert sorted(tuple(r)[:4] for r in got.collect()) == plain_codes(rows, 40)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r)[:4] for r in codes.vector_codes(few).collect()) == plain_codes(rows[:3], 256)
    assert codes.vector_codes(few.where("false")).count() == 0


def test_bounds_leave_out_work_and_no_entry():
    rng = np.random.default_rng(6)
    entries = (rng.normal(size=(16, 6))[rng.integers(16, size=256)] * 2000 + rng.normal(size=(256, 6)) * 50).astype(np.int64)
    parts = entries[rng.integers(256, size=500)] + rng.integers(-20, 20, (500, 6))
    pivots = codes.choose_pivots(entries, 8)
    found, best, tried = codes.nearest(parts, codes.distances(parts, pivots), entries, codes.distances(entries, pivots))
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert tried.mean() < 256 / 4


def test_codes_of_ragged_repeated_and_huge_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [], 1), (None, [1e300] * 5, None), (None, [-1e300] * 5, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = codes.vector_codes(table).collect()
    assert len(got) == 5 and {r.error for r in got} == {0} and {r.label_error for r in got} == {0}
    assert [r.code for r in got if r.vec_id == 2] == ["02020000"]


@pytest.mark.parametrize("name", ["op12_divergence", "op13_codes"])
def test_sql_of_the_new_operators(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
    assert got.select(F.count("*")).first()[0] > 0
