"""Mixing, SimHash, the two vector searches and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import cover_tree, learned_partitions, line_dedup, mixing, queries, simhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# --- mixing ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_mixing_targets_and_cuts(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "c", "d", None, "ü"])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "e"), (1002, "one two", "b"), (1002, "one two", "b"), (None, "x y z", "c")]
    out = mixing.mix_plan(docs_of(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    taken = {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_plan(docs_of(spark, rows[::-1])).collect()))


def test_mixed_documents_take_what_the_plan_says(spark):
    rng = random.Random(5)
    rows = [(i, " \t".join(f"w{k}" for k in range(rng.randint(0, 20))), rng.choice("abc")) for i in range(120)]
    docs = docs_of(spark, rows).withColumns({"_size": F.lit("clash"), "_doc": F.lit(1), "_src": F.lit(None).cast("int")})
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(docs_of(spark, rows)).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and {r._size for r in out.collect()} == {"clash"}
    got, text = {}, {i: t for i, t, _ in rows}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert got == {i: n for i, n in plan.items() if n}
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0 and mixing.mix_plan(docs_of(spark, [])).count() == 0


# --- near copies of the pipeline -------------------------------------------------------------------------------------


def test_pipeline_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 3000)}" for _ in range(rng.choice([12, 60, 150, 400]))]
        for k in range(8):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 50))):
                words[rng.randrange(len(words))] = f"new{g}x{k}"
            if k % 3 == 1:
                words.insert(rng.randrange(len(words)), words.pop(rng.randrange(len(words))))
            rows.append((g * 100 + k, " ".join(words), "s"))
    # a chain: each text only near the one before it, all in the same bucket again and again
    chain = [f"c{i}" for i in range(200)]
    rows += [(5000 + k, " ".join(chain[10 * k :] + [f"d{i}" for i in range(10 * k)]), "s") for k in range(12)]
    rows += [(6000, None, "s"), (6001, "", "s"), (6002, "One two", "s"), (6003, "one  TWO", "s")]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = {i for i in sets if root(i) == i}
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs_of(spark, rows + [(None, "one two", "s")]), "")
    got = [r.doc_id for r in out.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert {r.doc_id for r in simhash.dedup_documents(docs_of(spark, rows)).collect()} - want


# --- SimHash --------------------------------------------------------------------------------------------------------


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprint_definition():
    import xxhash

    words = [f"W{i % 7}é" for i in range(50)]
    text = " \n".join(words)
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    grams = [" ".join(low[i : i + 3]) for i in range(48)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 48)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", seed=42)


def test_near_components_against_brute_force(spark):
    rng = random.Random(6)
    base = [f"t{rng.randint(0, 5000)}" for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base) if i < 25 else [f"u{rng.randint(0, 9999)}" for _ in range(120)]
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = f"v{i}"
        rows.append((i, " ".join(words), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "one", "s"), (103, "one", "s")]
    docs = docs_of(spark, rows)
    want = brute_components({i: simhash.fingerprint(t) for i, t, _ in rows})
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert got == want and len(set(want.values())) < 50
    split = {r.doc_id: r.component_id for r in simhash.near_components(docs, max_shard=3).collect()}
    assert split == want  # shards dealt again lose no link
    doubled = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs_of(spark, [(None, "no id", "s")]))
    kept = simhash.dedup_documents(doubled)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, set(want.values())), "None"])
    assert simhash.near_components(docs.where("false")).count() == 0
    odd = docs.withColumns({"m": F.create_map(F.lit("a"), F.lit(1)), "fp": F.lit(1), "component_id": F.lit(2)})
    assert sorted(r.doc_id for r in simhash.dedup_documents(odd).collect()) == sorted(set(want.values()))


def test_bk_tree_and_resharding_find_every_link():
    rng = random.Random(7)
    values = list({rng.getrandbits(64) for _ in range(50)})
    values += list({v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values} - set(values))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.values[i] for i in tree.within(v, 3)) == sorted(w for w in values if (w ^ v).bit_count() <= 3)


# --- vector searches ------------------------------------------------------------------------------------------------


def vectors_of(spark, x, extra=()):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


BAD = [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, [1.0])]


def test_exact_topk_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(420, 8)).astype(np.float32) / 3
    x[60:80] = x[50]  # ties
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for blocks in ({}, {"row_block": 50, "query_block": 4, "first_block": 30}):
        out = cover_tree.exact_topk(vectors_of(spark, x, BAD), F.col("vec_id") % 50 == 0, **blocks).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for i in range(0, 420, 50):
            s = q @ q[i]
            order = [j for j in np.lexsort((np.arange(420), -s)) if j != i][:5]
            assert got[i] == [(j, s[j]) for j in order]
        assert set(got) == set(range(0, 420, 50))


def test_exact_topk_of_large_numbers_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 4)) * 10.0 ** rng.integers(-2, 12, (120, 1))
    x[7], x[8], x[50] = 1e17, -1e17, [1e17, 1e17, 1.0, -1e17]
    x[9] = 1.7e308
    x[10] = x[11]
    rows = [(min(i, 110), [float(c) for c in v]) for i, v in enumerate(x)]  # the last ten share an id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS h", "2 AS cell", "3 AS score")
    top = int(np.finfo(float).max)
    q = [[max(-top, min(top, int(np.floor(256 * int(c) if abs(c) > 2**53 else 256 * c)))) for c in v] for _, v in rows]
    out = {}
    for r in sorted(cover_tree.exact_topk(df, F.col("vec_id") % 50 == 0, row_block=25, first_block=20).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i in (0, 50, 100):
        score = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q[i], other)))) for other in q]
        want = sorted(((-s, rows[j][0]) for j, s in enumerate(score) if rows[j][0] != i))[:5]
        assert out[i] == [(j, -s) for s, j in want]


def test_blocks_of_rows_are_left_out(spark):
    """Queries near one cluster meet few of the blocks of the others."""
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 6)) * 3
    x = (centres[:, None] + rng.normal(size=(12, 40, 6)) / 100).reshape(-1, 6).astype(np.float32)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    out = cover_tree.exact_topk(vectors_of(spark, x), F.col("vec_id") % 50 == 0, row_block=40, first_block=480).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i in range(0, 480, 50):
        s = q @ q[i]
        assert got[i] == [(j, s[j]) for j in [j for j in np.lexsort((np.arange(480), -s)) if j != i][:5]]
    norms, radii = np.sqrt((centres**2).sum(axis=1)), np.full(12, 0.05)
    bounds = cover_tree.pair_bounds(centres @ centres.T, norms, norms, radii, radii)
    assert (bounds < (norms**2 - 2)[:, None]).mean() > 0.5


def test_exact_topk_few_and_none(spark):
    few = cover_tree.exact_topk(vectors_of(spark, np.eye(3)), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(few)] == [(1, 1, 0), (2, 2, 0)]
    assert cover_tree.exact_topk(vectors_of(spark, np.eye(3)).where("false"), F.col("vec_id") == 0).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(size=(500, 5)), np.zeros((40, 5))])
    tree = cover_tree.CoverTree(points, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(540))
    for (low, high), centre, radius, below in zip(tree.spans, tree.centres, tree.radii, tree.children, strict=True):
        assert np.sqrt(((tree.points[low:high] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if below:
            assert [tree.spans[b] for b in below][0][0] == low and tree.spans[below[-1]][1] == high


def test_dual_walk_prunes():
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(20, 6)) * 50
    rows = (centres[:, None] + rng.normal(size=(20, 100, 6))).reshape(-1, 6)
    walk = cover_tree.DualSearch(cover_tree.CoverTree(rows[::50], 4), cover_tree.CoverTree(rows, 16), np.arange(0, 2000, 50), np.arange(2000), 5, np.full(40, -np.inf))
    walk.run()
    assert walk.pairs < 0.5 * 40 * 2000


def test_learned_partitions(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    extra = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0])]
    out = learned_partitions.approximate_topk(vectors_of(spark, x, extra), F.col("vec_id") % 20 == 0, sample_rows=1500, row_block=200, query_block=40).collect()
    y, hits, total = x.astype(np.float64), 0, 0
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    for i, rows in by.items():
        s = y @ y[i]
        s[i] = -np.inf
        hits += len({r.vec_id for r in rows} & set(np.argsort(-s)[:20].tolist()))
        total += 20
        assert [r.rank for r in rows] == list(range(1, 21)) and all(r.vec_id != i for r in rows)
        assert np.allclose([r.score for r in rows], [s[r.vec_id] for r in rows], atol=1e-12)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert hits / total >= 0.9
    assert learned_partitions.approximate_topk(vectors_of(spark, x[:0]), F.col("vec_id") == 0).count() == 0


def test_learned_partitions_find_k_whatever_the_parts(spark):
    rng = np.random.default_rng(14)
    x = np.vstack([rng.normal(size=(240, 8)), np.tile(rng.normal(size=(1, 8)) * 9, (60, 1))]).astype(np.float32)  # many ties
    rows = [(min(i, 297), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS part", "2 AS id")
    for n, k in ((300, 20), (300, 250), (12, 20)):
        some = df.where(F.col("vec_id") < n)
        out, by = learned_partitions.approximate_topk(some, F.col("vec_id") % 20 == 0, k=k, sample_rows=250).collect(), {}
        for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
            by.setdefault(r.query_id, []).append(r)
        for i, hits in by.items():
            others = sum(j != i for j, _ in rows if j < n)
            assert len(hits) == min(k, others) and [(-r.score, r.vec_id) for r in hits] == sorted((-r.score, r.vec_id) for r in hits)


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.op5_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == documents.columns, name
        assert [f.dataType for f in docs.schema] == [f.dataType for f in documents.schema], name
        assert all(r.n_chars == len(r.text) for r in docs.collect()), name
        seen.append(docs.count())
    assert seen[0] > seen[1] == seen[2] >= seen[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in last)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]


def plain_pipeline(rows, score):
    """What the stages keep, by plain loops: ``doc_id`` and text of each row, before the tokens."""
    rows = [r for r in rows if score(r[1]) < 0.5]
    at, first, sites = {}, {}, {}
    for i, text, _, source, _ in rows:
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            if body := line.strip(" \t\r"):
                sites.setdefault(body, set()).add(source)
                at.setdefault(body, []).append((2**62 + (signed_hash(text) % 2**64 >> 2) if i is None else i, signed_hash(text), p))
    spread = {b for b, s in sites.items() if len(s) >= 10}
    first = {b: min(at[b]) for b in spread}
    lined = []
    for i, text, lang, source, n in rows:
        if text is not None:
            d = 2**62 + (signed_hash(text) % 2**64 >> 2) if i is None else i
            kept = [x for p, x in enumerate(text.split("\n")) if (b := x.strip(" \t\r")) not in spread or first[b] == (d, signed_hash(text), p)]
            text = "\n".join(kept)
        lined.append((i, text, source))
    sets = {}
    for i, text, _ in lined:
        w = (text or "").lower().split()
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    near = lambda a, b: any(x == y or 5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b])
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if root[a] != root[b] and near(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    one = [min((t or "", s or "", t, s) for j, t, s in lined if j == i) for i in ids if root[i] == i]
    kept = [(i, t, s) for i, (_, _, t, s) in zip([i for i in ids if root[i] == i], one)] + [r for r in lined if r[0] is None]
    size = lambda t: len((t or "").split())
    totals = {}
    for _, t, s in kept:
        totals[s] = totals.get(s, 0) + size(t)
    out = []
    for s, target in brute_targets(totals).items():
        left = round(target)
        own = sorted((r for r in kept if r[2] == s), key=lambda r: (hashlib.md5(f"mix{'' if r[0] is None else r[0]}".encode()).hexdigest()[:16], size(r[1])))
        while left > 0 and totals[s]:
            for i, t, _ in own:
                if n := min(size(t), left):
                    out.append((i, t if n == size(t) else " ".join(t.split()[:n])))
                    left -= n
    return out


def signed_hash(text):
    """Spark's xxhash64 of a string."""
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(text.encode(), seed=42) + 2**63) % 2**64 - 2**63


def test_pipeline_against_plain_loops(spark, tmp_path):
    import sentencepiece

    rng = random.Random(20)
    prose = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    rows = []
    for i in range(70):
        text = f"{prose(rng.choice([3, 20, 60]))}\nshared by every site"
        rows.append((i, text + (" scumbag" if i % 7 == 0 else ""), "en", f"s{i % 13}", 0))
    rows += [(100 + k, rows[1][1].replace(" ", "  ", k), "en", "s1", 0) for k in range(3)]
    long = prose(200).split()
    rows += [(200 + k, " ".join([*long[:k], f"edit{k}", *long[k + 1 :]]), "en", "s2", 0) for k in range(6)]
    rows += [(300, None, None, None, None), (301, "", "en", None, 0), (None, "no id here", "en", "s3", 0), (None, None, None, "s3", None), (302, "only source", "en", None, 0), (5, rows[5][1], "en", "s5", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], 1, int("scumbag" in r[1])) for r in rows[:70]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    from tessera.llm import toxicity

    model = toxicity.fit_toxicity(docs, labels)
    word = re.compile(r"[^\W\d_]+")
    want = plain_pipeline(rows, lambda t: model.score(set(word.findall((t or "").lower()))))
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())
    digest = lambda t: hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.ids_sha256) for r in out) == sorted((str(i), digest(t)) for i, t in want)
    assert 50 < len({i for i, _ in want}) < len(rows)
    # columns of any name are carried through all stages but the last
    odd = docs.selectExpr("*", "1 AS node", "2 AS component", "3 AS _size", "4 AS _h1", "5 AS fp", "6 AS bucket", "7 AS _toxicity")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, str(tmp_path))
        assert odd.columns == [*docs.columns, "node", "component", "_size", "_h1", "fp", "bucket", "_toxicity"], name
    assert {(r.node, r.component, r._size, r._h1, r.fp, r.bucket, r._toxicity) for r in odd.collect()} == {(1, 2, 3, 4, 5, 6, 7)}


def test_very_long_texts(spark):
    words = [f"w{i % 5003}" for i in range(300_000)]
    rows = [(1, " ".join(words), "a"), (2, " ".join(words[:-1] + ["end"]), "a"), (3, "few words", "b")]
    rows += [(10 + i, "\n".join(["everywhere", *words[:2000]]) if i == 3 else "everywhere", f"s{i}") for i in range(12)]
    docs = docs_of(spark, rows)
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    assert plan[1].size == 300_000 and sum(r.taken for r in plan.values()) > 0
    found = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert found[2] == 1 and found[3] == 3
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[13].text == "\n".join(words[:2000]) and lines[1].text == rows[0][1] and lines[10].text == "everywhere"


def test_pipeline_on_nothing(spark, tmp_path, sf_dir):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
