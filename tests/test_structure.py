"""Communities in levels, paths from both ends, neighbour graphs and clones on small fixtures."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import clones, communities, equivalence, graph, leaders, neighbour_graph, paths, similarity
from tessera.plans import more_queries, structure_queries


def edge_frame(spark, edges):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in edges], "src long, dst long, weight double")


# --- communities ----------------------------------------------------------------------------------------------------


def ring_of_cliques(cliques=10, size=3):
    """Cliques in a ring: so many that at resolution 1 neighbouring cliques belong together, which moving single nodes cannot find."""
    edges = [(c * size + i, c * size + j, 1) for c in range(cliques) for i in range(size) for j in range(i)]
    return edges + [(c * size, (c + 1) % cliques * size + 1, 1) for c in range(cliques)]


def plain_modularity(edges, where, resolution=1.0):
    whole, inner, degree = 0.0, 0.0, {}
    for a, b, w in edges:
        whole += 2 * w
        inner += 2 * w if where[a] == where[b] else 0
        for x in (a, b):
            degree[where[x]] = degree.get(where[x], 0) + w
    return inner / whole - resolution * sum(d * d for d in degree.values()) / whole**2


def levels_of(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.level, ({}, r.modularity))[0][r.node] = r.community
    return out


def test_levels_merge_cliques_that_local_moving_leaves_apart(spark):
    edges = ring_of_cliques()
    found = levels_of(communities.louvain(edge_frame(spark, edges), rounds=6, max_levels=3))
    assert len(found) >= 2
    for where, quality in found.values():
        assert quality == pytest.approx(plain_modularity(edges, where))
    qualities = [found[level][1] for level in sorted(found)]
    assert all(b > a for a, b in zip(qualities, qualities[1:], strict=False))
    first, last = found[1][0], found[max(found)][0]
    assert len(set(last.values())) < len(set(first.values()))
    assert all(len({where[c * 3 + i] for i in range(3)}) == 1 for where in (first, last) for c in range(10))
    fine = levels_of(communities.louvain(edge_frame(spark, edges), resolution=4.0, rounds=4, max_levels=1))
    assert len(set(fine[1][0].values())) > len(set(last.values()))


def test_levels_of_loops_repeats_and_nothing(spark):
    edges = [(1, 1, 2), (1, 2, 1), (2, 1, 1), (1, 2, 1), (3, 4, 5), (4, 4, 1)]
    found = levels_of(communities.louvain(edge_frame(spark, edges)))
    where, quality = found[max(found)]
    assert where[1] == where[2] != where[3] == where[4] and quality == pytest.approx(plain_modularity(edges, where))
    assert communities.louvain(edge_frame(spark, [])).count() == 0
    unweighted = edge_frame(spark, [(1, 2, 0)]).drop("weight").unionByName(spark.createDataFrame([(None, 3)], "src long, dst long"))
    assert {r.node for r in communities.louvain(unweighted).collect()} == {1, 2}


# --- paths ----------------------------------------------------------------------------------------------------------


def plain_paths(edges, a, b, depth, most):
    on, out = {}, []
    for s, d in set(edges):
        on.setdefault(s, set()).add(d)

    def walk(path):
        if path[-1] == b:
            out.append(path)
        elif len(path) <= depth:
            for n in on.get(path[-1], ()):
                if n not in path:
                    walk([*path, n])

    walk([a])
    return sorted(out, key=lambda p: (len(p), p))[:most]


@pytest.mark.parametrize("depth", [4, 5])
def test_paths_from_both_ends_equal_a_plain_search(spark, depth):
    rng = random.Random(depth)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(34)]
    pairs = [(0, 5), (5, 0), (3, 3), (7, 99), (1, 2), (1, 2), (4, 11)]
    e = spark.createDataFrame(edges, "src long, dst long")
    asked = spark.createDataFrame([*pairs, (None, 1)], "src long, dst long")
    for most in (None, 3):
        got = {}
        for r in paths.find_paths(e, asked, max_depth=depth, max_paths=most).orderBy("number").collect():
            assert r.length == len(r.path) - 1 and r.number == len(got.setdefault((r.src, r.dst), [])) + 1
            got[r.src, r.dst].append(list(r.path))
        want = {p: plain_paths(edges, *p, depth, most) for p in pairs}
        assert got == {p: found for p, found in want.items() if found}


def test_dense_starts_are_named(spark):
    edges = [(1, i) for i in range(2, 30)] + [(2, i) for i in range(3, 14)] + [(3, 4)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {(r.node, r.out_degree, r.level) for r in paths.density_warnings(e, e).collect()}
    assert got == {(1, 28, "dense"), (2, 11, "moderate")}


# --- neighbour graph ------------------------------------------------------------------------------------------------


def test_walks_find_the_nearest_rows(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    built = neighbour_graph.build(emb, k=20).cache()
    assert built.groupBy("id").count().agg(F.max("count")).first()[0] <= 20 and built.where("id = near").count() == 0
    found = neighbour_graph.search(emb, built, F.col("vec_id") % 25 == 0, k=10, beam=100, open_at_once=8).cache()
    exact = similarity.nearest(emb, 10).where("query_id % 25 = 0")
    result = neighbour_graph.recall(found, exact).first()
    assert result.queries == 20 and result.recall >= 0.9
    assert found.agg(F.max("compared")).first()[0] < 500


def test_neighbour_graph_of_clusters_is_nearly_exact(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(25, 16))
    rows = [(i, [float(x) for x in centres[i % 25] + 0.2 * rng.normal(size=16)]) for i in range(1200)]
    odd = [(5000, None), (5001, [float("nan")] * 16), (5002, [1.0, 2.0]), (5003, [0.0] * 16)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    built = neighbour_graph.build(table, k=12)
    assert {r.id for r in built.select("id").distinct().collect()} == {i for i, _ in rows} | {5003}
    found = neighbour_graph.search(table, built, F.col("vec_id") % 60 == 0, k=10)
    exact = similarity.nearest(table, 10).where("query_id % 60 = 0")
    assert neighbour_graph.recall(found, exact).first().recall >= 0.95
    assert found.agg(F.avg("compared")).first()[0] < 600


def test_neighbour_graph_of_few_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    built = neighbour_graph.build(table, k=5)
    got = neighbour_graph.search(table, built, F.col("vec_id") == 1, k=5).collect()
    assert [(r.rank, r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 3)]
    assert neighbour_graph.build(table.where("false")).count() == 0


def test_walks_over_many_rows_keep_their_recall(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(10000, 64)))], "vec_id long, embedding array<double>").cache()
    exact = similarity.nearest(table, 10).where("query_id % 50 = 0").cache()
    for more in ({}, {"shard": 1000}):  # one graph, and graphs of shards that each know a part of the rows
        found = neighbour_graph.search(table, neighbour_graph.build(table, k=20, **more), F.col("vec_id") % 50 == 0, k=10, beam=100, open_at_once=8, **more).cache()
        assert found.groupBy("query_id").count().where("count = 10").count() == 200
        assert neighbour_graph.recall(found, exact).first().recall >= 0.9
        assert found.join(exact.select("query_id", "id", F.col("score").alias("s")), ["query_id", "id"]).where("abs(score - s) > 1.5e-6").count() == 0


def test_walks_among_copies_give_the_smaller_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(1000 + i, [1.0] * 8) for i in range(90)]
    table = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")
    for more in ({}, {"shard": 100}):
        found = neighbour_graph.search(table, neighbour_graph.build(table, k=8, **more), F.col("vec_id") == 1005, k=10, **more).collect()
        assert [(r["rank"], r.id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(n + 1, 1000 + n + (n > 4), 1.0) for n in range(10)]


# --- clones ---------------------------------------------------------------------------------------------------------


def plain_spans(files, k, window):
    """Maximal runs of equal canonical tokens of k + window - 1 or more, between files of which none repeats another."""
    def form(t):
        return "".join(c for c in t.lower().translate(str.maketrans("123456789", "000000000")) if c.isalpha() or c == "0")

    tokens = {p: t.split() for p, t in files.items()}
    plain = {p: [form(t) for t in ts] for p, ts in tokens.items()}
    firsts = {}
    for p in sorted(files):
        firsts.setdefault(tuple(plain[p]), p)
    out = set()
    for a, b in permutations(sorted(firsts.values()), 2):
        if a < b:
            x, y = plain[a], plain[b]
            for i in range(len(x)):
                for j in range(len(y)):
                    if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= k + window - 1:
                            out.add((a, b, "I" if tokens[a][i : i + n] == tokens[b][j : j + n] else "II", i, j, n))
    return out


def test_spans_are_maximal_and_whole(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta eps".split()) + str(rng.randrange(9)) * rng.randrange(2)
    shared = [word() for _ in range(40)]
    files = {f"f{i}": " ".join([word() for _ in range(rng.randrange(20))] + shared[rng.randrange(20) :][: rng.randrange(8, 20)] + [word() for _ in range(5)]) for i in range(12)}
    files["up"] = files["f3"].upper()
    files["near"] = files["f5"] + " omega omega"
    files["same"] = files["f7"]
    files |= {"run": "la " * 50, "run2": "la " * 30, "empty": ""}
    table = spark.createDataFrame([*files.items(), ("null", None), (None, "x")], "path string, text string")
    tokens = clones.token_files(table)
    spans = clones.clone_spans(tokens, k=4, window=3)
    got = {tuple(r) for r in spans.collect()}
    assert got == plain_spans(files, 4, 3) and {g[2] for g in got} >= {"I"}
    pairs = {(r.file1, r.file2): (r.kind, r.similarity) for r in clones.clone_pairs(tokens, spans, k=4, threshold=0.7).collect()}
    assert pairs["f3", "up"] == ("II", 1.0) and pairs["f7", "same"] == ("I", 1.0) and pairs["f5", "near"][0] == "III"
    assert clones.clone_spans(clones.token_files(table.where("false"))).count() == 0


def test_spans_beside_common_runs_need_no_row_for_each_run(spark, monkeypatch):
    line = lambda c: " ".join(c * (i + 1) for i in range(13))
    files = {f"f{i}": f"{line('h')} {' '.join(chr(98 + i) * (j + 2) for j in range(9))} {line('h')}" for i in range(5)}
    files |= {f"g{i}": f"{files['f4']} {line('xyz'[i])} {line('u')} {line('h')}" for i in range(3)} | {"long": " ".join([line("u")] + ["w" * (i % 50 + 1) + "v" * (i // 50 + 1) for i in range(2000)] + [line("u")])}
    tokens = clones.token_files(spark.createDataFrame([*files.items()], "path string, text string"))
    monkeypatch.setattr(clones, "_runs", None)  # a row for each run of a file, which all diagonals were joined with
    spans = clones.clone_spans(tokens, k=4, window=3, most=5)
    got, every = {tuple(r) for r in spans.collect()}, plain_spans(files, 4, 3)
    met = {(a, b, j - i) for a, b, _, i, j, _ in got}
    assert got <= every and {g for g in every if (g[0], g[1], g[4] - g[3]) in met} == got  # whole diagonals, common runs and all
    assert {(g[0], g[1]) for g in got} == {("f4", "g0"), ("f4", "g1"), ("f4", "g2"), ("g0", "g1"), ("g0", "g2"), ("g1", "g2"), ("g0", "long"), ("g1", "long"), ("g2", "long")}


def test_shares_of_long_spans_need_no_row_for_each_run(spark):
    files = spark.createDataFrame([(p, ["x"] * 23, ["x"] * 23) for p in "ab"], "path string, raw array<string>, tokens array<string>").withColumn("tokens", F.array_append("tokens", F.col("path")))
    spans = [("a", "b", "II", 0, 3, 10), ("a", "b", "II", 2, 0, 4), ("a", "b", "II", 5, 5, 9), ("a", "b", "II", 16, 16, 8)]
    share = lambda rows: clones.clone_pairs(files, spark.createDataFrame(rows, "file1 string, file2 string, kind string, start1 int, start2 int, tokens long"), k=4, threshold=0.0).collect()
    want = {i for _, _, _, at, _, n in spans for i in range(at, at + n - 3)}
    assert [tuple(r) for r in share(spans)] == [("a", "b", "III", round(len(want) / 21, 6))]
    assert share([("a", "b", "II", 0, 0, 2_000_000_000)])[0].similarity > 1  # one row, however long


def test_spans_around_a_usual_run_are_whole(spark):
    usual = [[f"{w}{c}" for c in ("amo", "bel", "cid", "dun")] for w in "pqrstu"]
    own = lambda i, n: " ".join(f"{'klmnv'[i % 5]}{'abcdefghij'[j % 10] * (j // 10 + 1)}{'w' * (i // 5)}" for j in range(n))
    files = {f"u{i}": " ".join(f"{own(i, j + 3)} {' '.join(u)}" for j, u in enumerate(usual)) for i in range(8)}  # four tokens, in more than five files
    for i, u in enumerate(usual * 4):
        files |= {f"{side}{i:02}": f"{side * 3} x{'y' * i} {' '.join(u)} z{'y' * i} {side * 4}" for side in "gh"}  # six tokens, in two files
    tokens = clones.token_files(spark.createDataFrame([*files.items()], "path string, text string"))
    got = {tuple(r) for r in clones.clone_spans(tokens, k=4, window=3, most=5).collect()}
    assert got == plain_spans(files, 4, 3) and {(g[0], g[1]) for g in got} >= {(f"g{i:02}", f"h{i:02}") for i in range(24)}


def test_what_is_sent_for_spans_grows_with_the_files_not_their_meetings(spark):
    rng = random.Random(3)
    files = {f"f{i}": " ".join([f"w{'x' * i}", *(["la"] * 120), *(rng.choice(["Lo", "lo"]) for _ in range(80)), f"v{'x' * i}"]) for i in range(6)}  # 15 pairs meet about 400,000 times
    tokens = clones.token_files(spark.createDataFrame([*files.items()], "path string, text string"))
    edges = clones._edges(tokens, 4, 3, spark.sparkContext.broadcast(clones._filters(tokens, 4, 3)))
    assert edges.count() <= 202 * 6 and clones._by_block(edges, 200, 4).count() <= 202 * 6 * 4
    spans = clones.clone_spans(tokens, k=4, window=3)
    got = {tuple(r) for r in spans.collect()}
    assert got == plain_spans(files, 4, 3) and {g[2] for g in got} == {"I", "II"}
    both = [{tuple(r) for r in df.select("file1", "file2", "shared").collect()} for df in (clones.shared_runs(tokens, k=4, window=3), clones._covered(spans, 4))]
    assert both[0] == both[1] and len(both[0]) == 15
    pairs = [clones.clone_pairs(tokens, s, k=4, threshold=0.7).collect() for s in (spans, clones.shared_runs(tokens, k=4, window=3, threshold=0.7))]
    assert sorted(pairs[0]) == sorted(pairs[1]) and len(pairs[0]) == 15


def test_of_a_repeated_path_the_first_text_counts(spark):
    rows = spark.createDataFrame([("a", "b c"), ("a", "A -- c"), ("b", ""), ("c", " "), ("d", "1\u00e9 - Z.9\nx")], "path string, text string")
    got = {r.path: (r.raw, r.tokens) for r in clones.token_files(rows).collect()}
    assert got == {"a": (["A", "--", "c"], ["a", "", "c"]), "b": ([], []), "c": ([], []), "d": (["1\u00e9", "-", "Z.9", "x"], ["0\u00e9", "", "z0", "x"])}


def test_common_runs_become_classes_not_pairs(spark):
    header = "one two three four five six seven eight nine ten eleven twelve"
    table = spark.createDataFrame([(f"f{i:02}", f"{header} {' '.join(f'w{i}x{j}'.replace('0', 'o') + chr(97 + i) * (j + 1) for j in range(6))}") for i in range(20)], "path string, text string")
    tokens = clones.token_files(table)
    assert clones.clone_spans(tokens, k=4, window=3, most=5).count() == 0
    runs = clones._runs(tokens, 4)
    common = clones.common_runs(runs, clones.fingerprints(runs, 3), 5)
    assert {r["count"] for r in common.groupBy("hash").count().collect()} == {20}


CODE = '''
def total(rows, limit):
    out = 0
    for row in rows:
        if row.price > limit:
            out += row.price * row.count
    return out
'''


def test_subtrees_tell_copies_from_renamings(spark):
    renamed = CODE.replace("total", "add_up").replace("rows", "items").replace("row.", "item.").replace("for row", "for item").replace("price", "cost")
    files = [("a.py", CODE + "\nx = [1, 2]\n"), ("b.py", "import os\n" + CODE), ("c.py", renamed), ("d.py", "def f(:"), ("e.py", ""), ("f.py", None)]
    trees = clones.subtrees(spark.createDataFrame(files, "path string, text string")).cache()
    assert {r.path: r.error for r in trees.where("error IS NOT NULL").collect()} == {"d.py": "SyntaxError"}
    pairs, hot = clones.subtree_clones(trees)
    got = {(r.file1, r.file2, r.kind, r.line1, r.line2) for r in pairs.collect()}
    assert got == {("a.py", "b.py", "I", 2, 3), ("a.py", "c.py", "II", 2, 2), ("b.py", "c.py", "II", 3, 2)}
    assert hot.count() == 0
    pairs, hot = clones.subtree_clones(trees, most=2)
    assert pairs.count() == 0 and {r.path for r in hot.collect()} == {"a.py", "b.py", "c.py"}


def test_simple_paths_and_first_paths_agree(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (4, 1)], "src long, dst long")
    one = spark.createDataFrame([(1, 4)], "src long, dst long")
    found = {tuple(r.path) for r in paths.find_paths(e, one, max_depth=3, max_paths=None).collect()}
    assert found == {tuple(r.path) for r in graph.simple_paths(e, 3).where("src = 1 AND dst = 4").collect()}


# --- patterns of trees ----------------------------------------------------------------------------------------------


def test_patterns_at_any_depth(spark):
    inner = '["binary_op","+",["literal",{"value":1,"at":{"line":3}},[]],["literal",{"value":2},[]]]'
    rows = [(1, f'["loop",{{"loop_type":"for"}},{inner}]'), (2, inner), (3, "no json"), (4, None), (5, '"leaf"')]
    nodes = equivalence.tree_nodes(spark.createDataFrame(rows, "id int, tree string"))
    patterns = {
        "any": "_", "kind": ["literal", "_", "_"], "old_kind": ["binary_op", "_", "_", "_"], "attributes": ["literal", {"value": 1, "at": {"line": 3}}, "_"],
        "other_attribute": ["literal", {"value": 9}, "_"], "operator": ["binary_op", "+", "_", "_"], "itself": ["literal", {"value": 2}, []], "leaf": "leaf",
    }
    got = {}
    for r in equivalence.find_patterns(nodes, patterns).collect():
        got.setdefault(r.pattern, []).append((r.id, r.depth))
    assert sorted(got.pop("any")) == [(1, 0), (1, 1), (1, 2), (1, 2), (1, 3), (1, 3), (2, 0), (2, 1), (2, 1), (2, 2), (2, 2), (5, 0)]
    assert {k: sorted(v) for k, v in got.items()} == {
        "kind": [(1, 2), (1, 2), (2, 1), (2, 1)], "old_kind": [(1, 1), (2, 0)], "attributes": [(1, 2), (2, 1)],
        "operator": [(1, 1), (2, 0)], "itself": [(1, 2), (2, 1)], "leaf": [(5, 0)],
    }


def test_only_nodes_of_its_kind_are_written_out_for_a_whole_pattern(spark):
    nodes = equivalence.tree_nodes(spark.createDataFrame([(1, '["call",{},["literal",{},7]]'), (2, '["literal",{},7]'), (3, '["literal",{},8]'), (4, '[7]')], "id int, tree string"))
    test = equivalence.pattern_test(F.col("node"), ["literal", {}, 7])
    assert [(r.id, r.depth) for r in nodes.where(test).orderBy("id").collect()] == [(1, 1), (2, 0)]
    assert "CASE WHEN" in str(test) and str(test).index("try_variant_get") < str(test).index("to_json")


# --- leaders --------------------------------------------------------------------------------------------------------


def test_leaders_are_those_of_one_row_after_another(spark):
    rng = random.Random(12)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(110)] + [(i, i + 1) for i in range(100, 112)] + [(3, 3), (3, 999)]
    nodes = [*range(80), *range(100, 113), 500]
    near = {n: {b for a, b in links if a == n} | {a for a, b in links if b == n} for n in nodes}
    want, led = {}, set()
    for n in sorted(nodes):
        own = sorted((near[n] - {n}) & led)
        want[n] = own[0] if own else n
        led |= set() if own else {n}
    table = spark.createDataFrame([(n,) for n in nodes] + [(None,), (5,)], "node long")
    got = leaders.leader_groups(table, spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.leader for r in got} == want and len(got) == len(nodes)
    assert leaders.leader_groups(table.where("false"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_find_leaders_without_their_pairs(spark, sf_dir, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i % 190, [float(x) for x in rng.normal(size=3)]) for i in range(200)] + [(300, None), (301, [1.0]), (302, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows + [(None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    links = similarity.similar_pairs(table, 0.8).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    want = {tuple(r) for r in leaders.leader_groups(table.select(F.col("vec_id").alias("node")), links).collect()}
    for chunk in (3, 50, 4096):
        assert {tuple(r) for r in leaders.vector_leaders(table, 0.8, chunk=chunk).collect()} == want and len(want) == 193
    assert leaders.vector_leaders(table.where("false"), 0.8).count() == 0
    monkeypatch.setattr(similarity, "similar_pairs", None)  # the groups of a large crowd come without a row for each pair of it
    crowd = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") % 2 * 2.0).alias("embedding"), F.lit(0).alias("label"))
    crowd.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = structure_queries.similarity_groups(spark, str(tmp_path)).groupBy("leader").count().collect()
    assert [tuple(r) for r in got] == [(0, 4000)]


def test_components_of_a_long_path_keep_their_estimated_size(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1000), (1001, None), (5, 5)], "src long, dst long")
    found = graph.components(path)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(401)} | {(1000, 1000)}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**40  # digits that multiply from round to round fill the driver


# --- names ----------------------------------------------------------------------------------------------------------


def test_equal_names_are_compared_once(spark, tmp_path, monkeypatch):
    names = ["red bolt", "red bolts", "steel pipe", None]
    rows = [(i, "B", i % 2, names[i // 2 % 4]) for i in range(160)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([text.jaro_of(x, y) for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(text, "jaro", counted)
    got = {(r.p_partkey, r.other): r.score for r in more_queries.jaro_names(spark, str(tmp_path)).collect()}
    want = {(a[0], b[0]): round(text.jaro_of(a[3], b[3]), 6) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[3] and b[3]}
    assert got == {k: v for k, v in want.items() if v > 0.8}
    assert 0 < asked.value < 100 < len(want)  # a plan may ask for the nine pairs of names more than once
