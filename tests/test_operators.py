"""Operators on small hand-made tables, edge cases first."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import lexicon, vectors
from tessera.operators import analysis, equivalence, graph, retrieval, similarity, store, timeline
from tessera.sources import code, documents
from tessera.streaming import events as streams

E = "src string, dst string"


def edges(spark, text):
    return spark.createDataFrame([tuple(x.split(">")) for x in text.split()], E)


def mapped(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


# --- graph ----------------------------------------------------------------------------------------------------------


def test_diamond(spark):
    e = edges(spark, "a>b b>c a>d d>c a>b")
    rank = mapped(graph.pagerank(e), "node", "score")
    assert rank["c"] > rank["b"] > rank["a"] and rank["b"] == pytest.approx(rank["d"]) and sum(rank.values()) <= 1
    paths = {tuple(r.path) for r in graph.simple_paths(e).collect() if r.src == "a" and r.dst == "c"}
    assert paths == {("a", "b", "c"), ("a", "d", "c")}
    sp = {(r.source, r.node): (r.dist, r.sigma) for r in graph.shortest_paths(e).collect()}
    assert sp["a", "c"] == (2, 2) and sp["a", "a"] == (0, 1) and ("c", "a") not in sp
    between = mapped(graph.betweenness_centrality(e), "node", "betweenness")
    assert between == pytest.approx({"a": 0, "b": 0.5 / 6, "d": 0.5 / 6, "c": 0})
    few = mapped(graph.betweenness_centrality(e, max_nodes=1, normalize=False), "node", "betweenness")
    assert few["b"] == pytest.approx(0.5)
    near = mapped(graph.closeness_centrality(e), "node", "closeness")
    assert near["a"] == pytest.approx(3 / 4 * 3 / 3) and near["c"] == 0
    degree = {r.node: (r.in_degree, r.out_degree) for r in graph.degree_centrality(e, spark.createDataFrame([("z",)], "node string")).collect()}
    assert degree == {"a": (0, 2), "b": (1, 1), "c": (2, 0), "d": (1, 1), "z": (0, 0)}


def test_cycles_components_and_reach(spark):
    e = edges(spark, "a>b b>c c>a b>a d>d e>f")
    assert sorted(tuple(r.cycle) for r in graph.simple_cycles(e).collect()) == [("a", "b"), ("a", "b", "c")]
    assert mapped(graph.components(e), "node", "component") == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}
    reach = {(r.node, r.reached) for r in graph.reachable(e).collect()}
    assert ("a", "a") in reach and ("d", "d") in reach and ("e", "e") not in reach
    target = spark.createDataFrame([("c",)], "node string")
    hit = mapped(graph.affected(e, target, depth=2), "node", "level")
    assert hit == {"c": 0, "b": 1}
    blocked = graph.affected(e, target, depth=5, exclude=spark.createDataFrame([("b",)], "node string"))
    assert mapped(blocked, "node", "level") == {"c": 0}
    assert mapped(graph.neighbourhood(e, target, 1), "node", "level") == {"c": 0, "a": 1, "b": 1}


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).select((F.col("id") * 7 % 301).alias("src"), ((F.col("id") + 1) * 7 % 301).alias("dst"))
    assert graph.components(chain).select("component").distinct().count() == 1


def test_empty_graph(spark):
    none = edges(spark, "a>b").where("false")
    for f in (graph.pagerank, graph.components, graph.closeness_centrality, graph.betweenness_centrality, graph.label_propagation, graph.simple_paths, graph.simple_cycles, graph.reachable, graph.degree_centrality):
        assert f(none).count() == 0, f.__name__
    stats = graph.graph_stats(none.select(F.col("src").alias("node")), none).first()
    assert stats.node_count == 0 and stats.density == 0


def test_communities_and_modularity(spark):
    weighted = edges(spark, "a>b b>a c>d d>c a>c").withColumn("weight", F.when((F.col("src") == "a") & (F.col("dst") == "c"), 0.1).otherwise(1.0))
    found = mapped(graph.local_moves(weighted), "node", "community")
    assert found["a"] == found["b"] != found["c"] == found["d"]
    two = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "node string, community string")
    one = two.withColumn("community", F.lit("x"))
    score = lambda part: graph.modularity(weighted, part).first()[0]
    assert score(two) == pytest.approx(4 / 4.1 - 2 * 2.1**2 / (2 * 4.1**2)) and score(one) == pytest.approx(0.5)
    assert graph.label_propagation(weighted).count() == 4
    assert graph.export_dot(weighted).count() == 9
    assert {json.loads(r.json).get("id") for r in graph.export_d3(weighted).where("kind = 'node'").collect()} == set("abcd")


# --- vectors and retrieval ------------------------------------------------------------------------------------------


def test_cosine_cases(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([0.6, 0.8], [0.8, 0.6]), ([3.0], [3.0, 4.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1, 0, -1, 0, 0.96, 0.6])


def test_neighbours_in_blocks(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), 0.1 * i]) for i in range(30)]
    df = spark.createDataFrame([*rows, (99, None)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, similarity.nearest(df, 3, block=7).collect())) == sorted(map(tuple, similarity.nearest(df, 3, block=100).collect()))
    small, large = (sorted(map(tuple, similarity.similar_pairs(df, 0.9, block=b).collect())) for b in (7, 100))
    assert small == large and all(a < b for a, b, _ in small) and small


def test_fusion_and_metrics(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], a.schema)
    fused = [(r.id, r.score) for r in sorted(retrieval.reciprocal_rank_fusion([a, b]).collect(), key=lambda r: r.rank)]
    assert fused == [("y", round(1 / 61 + 1 / 60, 6)), ("x", round(1 / 60, 6)), ("z", round(1 / 61, 6))]
    golden = spark.createDataFrame([("q", "x", 3), ("q", "y", 1), ("none", "x", 0)], "query_id string, id string, grade int")
    perfect = mapped(retrieval.relevance_metrics(a, golden, 2), "query_id", "ndcg")
    assert perfect["q"] == 1.0 and perfect["none"] == 0.0
    row = {r.query_id: r for r in retrieval.relevance_metrics(b, golden, 2).collect()}
    assert row["q"].mrr == 1.0 and row["q"].precision == 0.5 and row["q"].recall == 0.5 and row["none"].recall == 1.0
    assert retrieval.macro_average(retrieval.relevance_metrics(a, golden.where("false"))).first().ndcg == 0.0


def test_packing_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([("q", 1, 10, 60), ("q", 2, 11, 50), ("q", 3, 12, 40)], "query_id string, rank int, id long, size long")
    assert [r.id for r in sorted(retrieval.packed(hits, 100).collect(), key=lambda r: r.rank)] == [10, 12]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(120)))), (2, "one\ntwo"), (3, "")], "doc_id long, text string")
    got = {}
    for r in retrieval.chunks(docs).collect():
        got.setdefault(r.id, []).append((r.start_line, r.end_line))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 60), (46, 105), (91, 120)], 2: [(1, 2)], 3: [(1, 1)]}


def test_bm25_and_blend(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "nothing")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red fox")], "item_id long, text string")
    hits = retrieval.bm25(docs, asked)
    score = mapped(hits, "id", "score")
    assert set(score) == {1, 2} and score[1] > score[2] > 0
    assert mapped(retrieval.normalised(hits), "id", "score") == {1: 1.0, 2: 0.0}
    given = spark.createDataFrame([(2, 10.0)], "id long, given double")
    assert mapped(retrieval.blend(retrieval.normalised(hits), given, alpha=0.6), "id", "score") == {1: 0.7, 2: 0.6}


def test_lexicon(spark):
    q = spark.createDataFrame([("map over list",), ("fix bug",), (None,)], "q string")
    got = [tuple(r) for r in q.select(lexicon.expand_query(F.col("q")), lexicon.intent(F.col("q"), lexicon.RANKING_INTENTS)).collect()]
    assert got[0] == ("map over list function code implementation transform apply", "general")
    assert got[1] == ("fix bug error exception failure issue problem", "debug") and got[2][1] == "general"
    t = spark.createDataFrame([("createUser MyApp.user_accounts the é",)], "t string")
    assert t.select(lexicon.text_tokens(F.col("t"))).first()[0] == ["create", "user", "my", "app", "user", "accounts"]
    boost = lambda *a: spark.range(1).select(lexicon.meta_boost(*a, lexicon.INTENT_BOOSTS["general"])).first()[0]
    none = F.lit(None)
    assert boost(none.cast("string"), none.cast("boolean"), none.cast("int")) == 1.0
    assert boost(F.lit("core"), none.cast("boolean"), F.lit(0)) == pytest.approx(1.2) and boost(none.cast("string"), F.lit(True), F.lit(0)) == pytest.approx(1.56)
    weights = F.create_map(F.lit("user"), F.lit(1.5))
    rel = spark.range(1).select(lexicon.relevance_boost(weights, F.array(F.lit("User"), F.lit("x")))).first()[0]
    assert rel == 1.75


# --- analysis, store, timeline --------------------------------------------------------------------------------------


def test_cohesion_cases(spark):
    mods = spark.createDataFrame([("empty",), ("one",), ("two",)], "module string")
    fns = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two"), (4, "two")], "fn long, module string")
    calls = spark.createDataFrame([(2, 3), (1, 2)], "src long, dst long")
    got = {r.module: (r.components, r.fci, r.tcc) for r in analysis.cohesion(fns, calls, mods).collect()}
    assert got == {"empty": (0, 1.0, 1.0), "one": (1, 1.0, 1.0), "two": (2, 0.5, round(1 / 3, 6))}


def test_dead_code_confidence(spark):
    rows = [(1, "M", "helper", 2, "private"), (2, "M", "init", 1, "public"), (3, "MTest", "x", 0, "public"), (4, "Mix.Tasks.A", "x", 0, "private"), (5, "M", "used", 0, "public")]
    fns = spark.createDataFrame(rows, "fn long, module string, name string, arity int, visibility string")
    calls = spark.createDataFrame([(1, 5)], "src long, dst long")
    assert mapped(analysis.dead_functions(fns, calls, 0, 0), "fn", "confidence") == pytest.approx({1: 1.0, 2: 0.1, 3: 0.5, 4: 0.6})
    assert set(mapped(analysis.dead_functions(fns, calls), "fn", "confidence")) == {1, 3}


def test_co_change_bounds(spark):
    rows = [(1, f) for f in (1, 2, 2, 3)] + [(2, 1), (2, 2)] + [(3, 1)] + [(4, f) for f in range(60)]
    pairs = {(r.a, r.b): r.n for r in analysis.co_changes(spark.createDataFrame(rows, "commit long, file long")).collect()}
    assert pairs == {(1, 2): 2, (1, 3): 1, (2, 3): 1}
    partners = analysis.co_change_partners(spark.createDataFrame([(1, 2, 2), (1, 3, 1)], "a long, b long, n long"))
    assert {(r.file, r.partner) for r in partners.collect()} == {(1, 2), (2, 1)}


def test_quality_without_rows(spark):
    empty = spark.createDataFrame([], "cyclomatic int, cognitive int, max_nesting int, warnings array<string>, pure boolean")
    row = analysis.quality_score(analysis.quality_stats(empty)).first()
    assert row.files == 0 and row.avg_cyclomatic == 0.0 and row.score == 100


def test_suggestion_levels(spark):
    rows = spark.createDataFrame([("remove_dead_code", 1.0, 1.0, 0.0, 10, "low"), ("x", None, None, None, None, None)], "pattern string, benefit double, confidence double, effort double, affected_files int, risk string")
    got = {r.pattern: (r.priority_score, r.priority, r.roi) for r in analysis.ranked_suggestions(rows).collect()}
    assert got["remove_dead_code"] == (0.76, "high", 10.0) and got["x"][1] == "info"


def test_suggestions_round_as_their_sql(spark):
    rows = spark.createDataFrame([("x", 23 / 40, 0.5, 1.0, 1, "low"), ("y", 0.5, 0.5, 0.5, 1, "low")], "pattern string, benefit double, confidence double, effort double, affected_files int, risk string")
    got = {r.pattern: r.roi for r in analysis.ranked_suggestions(rows).collect()}
    assert got == {"x": 0.57, "y": 1.0}  # 0.575 times 100 is under 57.5


def test_suggestion_means_do_not_show_the_order_of_a_sum(spark):
    rows = spark.createDataFrame([("low", 0.41, 1.0)] + [("low", 0.42, 1.0)] * 19, "priority string, priority_score double, roi double").coalesce(1)
    assert analysis.suggestion_stats(rows).first().avg_score == 0.42  # 0.4195, which a sum of doubles misses by 7e-17


def test_trailing_sums_do_not_walk_through_their_span(spark):
    odd = [None, float("nan"), float("inf"), -float("inf"), 2.5]
    data = [(i, "ab"[i % 2], i * 40_000 // 7, odd[i % 5] if i % 50 < 5 else i % 9 / 4) for i in range(100)]
    got = timeline.trailing(spark.createDataFrame(data, "id int, k string, at long, v double"), "k", "at", "v", {"hour": 3600, "day": 86400})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and "RangeFrame, -" not in plan
    for r in got.collect():
        for name, span in (("hour", 3600), ("day", 86400)):
            seen = [x[3] for x in data if x[1] == r.k and r["at"] - span <= x[2] <= r["at"]]
            given = [x for x in seen if x is not None]
            assert r[f"n_{name}"] == len(seen) and repr(r[f"sum_{name}"]) == repr(round(sum(given), 4) if given else None), (r, name)


def test_bm25_sums_scores_where_the_counts_are(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 5} a") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b1 c2"), (2, "b2"), (3, "none")], "item_id long, text string")
    found = retrieval.bm25(docs, queries)
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each query and term is shuffled
    shared = {(r.query_id, r.id): r.shared for r in found.collect()}
    assert shared == {(1, i): 1.0 + (i % 3 == 1) + (i % 5 == 2) for i in range(40)} | {(2, i): 1.0 for i in range(2, 40, 3)}


def test_large_blocks_are_scored_in_stripes(spark):
    stripe, n = similarity.STRIPE, similarity.STRIPE + 200
    angle = [(i * 37 % n) * 0.001 for i in range(n)]
    rows = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angle)], "vec_id long, embedding array<double>")
    got = {r.query_id: r.id for r in similarity.nearest(rows, 1).collect()}
    assert len(got) == n and all(abs(angle[i] - angle[j]) < 0.0015 for i, j in got.items())
    pairs = {(r.id1, r.id2) for r in similarity.similar_pairs(rows, round(math.cos(0.0015), 9), digits=9).collect()}
    assert pairs == {(i, j) for i in range(n) for j in range(i + 1, n) if abs(angle[i] - angle[j]) < 0.0012} and stripe < n


def test_a_row_is_sent_for_a_fixed_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST", 5)
    for n in (80, 320):
        rows = spark.createDataFrame([(i, [math.cos(i * 0.7), math.sin(i * 0.7), 0.01 * i]) for i in range(n)], "vec_id int, embedding array<float>")
        groups = {(r.a, r.b): r["count"] for r in similarity._block_pairs(rows, "vec_id", "embedding", None).count().collect()}
        assert sum(groups.values()) == similarity.BLOCKS * n and len(groups) == similarity.BLOCKS * (similarity.BLOCKS + 1) // 2
        for ask in (lambda block, rows=rows: similarity.similar_pairs(rows, 0.9, block=block), lambda block, rows=rows: similarity.nearest(rows, 3, block=block)):
            assert sorted(map(tuple, ask(None).collect())) == sorted(map(tuple, ask(1000).collect())) != []


def test_store(spark):
    rows = spark.createDataFrame([("f", 1, "old"), ("f", 2, "new"), ("g", 1, "x")], "node string, seq int, v string")
    assert mapped(store.upsert(rows, ["node"], "seq"), "node", "v") == {"f": "new", "g": "x"}
    bag = "src string, dst string, weight double, metadata map<string,string>"
    base = spark.createDataFrame([("a", "b", 1.0, {"k": "1"})], bag)
    more = spark.createDataFrame([("a", "b", None, {"k": "1"}), ("a", "b", 1.0, {"k": "2"}), ("c", "d", None, None)], bag)
    assert store.add_edges(base, more).count() == 3
    nodes = spark.createDataFrame([("a", {"x": "1", "y": "1"}), ("b", None)], "node string, metadata map<string,string>")
    update = spark.createDataFrame([("a", {"y": "2", "z": "3"})], nodes.schema)
    assert mapped(store.merge_metadata(nodes, update, ["node"]), "node", "metadata") == {"a": {"x": "1", "y": "2", "z": "3"}, "b": None}
    gone = spark.createDataFrame([("a",)], "node string")
    left = store.remove_nodes(nodes, base, nodes, gone)
    assert [df.count() for df in left] == [1, 0, 1]
    assert store.listed(rows.withColumn("node_type", F.lit("t")), "t", 1).count() == 1 and store.listed(rows).count() == 3
    assert store.matching(rows, {"node": "f", "v": "new"}).count() == 1


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    store.save_snapshot({"nodes": df}, f"{tmp_path}/s", "m", 64)
    assert store.load_snapshot(spark, f"{tmp_path}/s", ["nodes"], 64)["nodes"].count() == 1
    assert store.load_snapshot(spark, f"{tmp_path}/s", ["nodes"], 32) is None


def test_stale(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, hash string")
    old = spark.createDataFrame([(1, "a"), (2, "x")], "id int, hash string")
    assert mapped(store.stale(now, old, "id"), "id", "status") == {2: "changed", 3: "new"}


def test_budget_and_tail(spark):
    rows = [("c", i, r, "x" * n) for i, (r, n) in enumerate([("system", 10), ("user", 10), ("assistant", 30), ("assistant", 30), ("assistant", 15)])]
    df = spark.createDataFrame(rows, "s string, turn int, role string, text string")
    kept = timeline.within_budget(df, "s", "turn", "role", "text", 70)
    assert sorted(r.turn for r in kept.collect()) == [0, 1, 3, 4]
    assert sorted(r.turn for r in timeline.last_messages(df, "s", "turn", "role", 1).collect()) == [0, 4]


def test_islands(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([None, None, "a", "a", None])], "k string, t int, v string")
    assert sorted((r.first, r.last, r.n) for r in timeline.islands(df, "k", ["t"], "v").collect()) == [(0, 1, 2), (2, 3, 2), (4, 4, 1)]


def test_equivalence(spark):
    rows = [(1, "py", '["call",{},"f"]'), (2, "js", '["call",{},"f"]'), (3, "js", '["call",{},"g"]'), (4, "js", '["loop",{}]'), (5, "js", '"x"')]
    df = spark.createDataFrame(rows, "id int, language string, tree string")
    assert {(r.id, r.other) for r in equivalence.equivalents(df).collect()} == {(1, 2), (2, 1)}
    assert mapped(equivalence.search(df, rows[0][2], ["js"], least=0.0), "id", "score") == pytest.approx({2: 1.0, 3: 1.0, 4: 0.3, 5: 0.0})
    assert [r.id for r in df.where(equivalence.matches(F.col("tree"), ["call", None, "g"])).collect()] == [3]
    assert sorted((r.first, r.n) for r in equivalence.groups(df).collect()) == [(1, 2), (3, 1), (4, 1), (5, 1)]


# --- sources --------------------------------------------------------------------------------------------------------


def test_source_tree(spark, tmp_path):
    files = {
        "app/main.py": "import os\nfrom .x import y\n\ndef run(a, b):\n    return helper(a)\n\ndef helper(a):\n    return a\n",
        "app/bad.py": "def (:\n", "web/a.js": "import x from 'lib'\nexport function go(a, b) {}\nconst f = (q) => q\nclass C {}\n",
        "deps/x.py": "a = 1\n", ".hidden/y.py": "a = 1\n", "app/readme.md": "text",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode() + (b"# \xff\n" if name == "app/main.py" else b""))
    tree = code.scan(spark, str(tmp_path))
    assert {r.path for r in tree.collect()} == {"app/main.py", "app/bad.py", "web/a.js"}
    found = code.entities(tree).collect()
    of = lambda kind: {(r.path, r.name or r.target or r.module) for r in found if r.kind == kind}
    assert of("function") == {("app/main.py", "run"), ("app/main.py", "helper"), ("web/a.js", "go"), ("web/a.js", "f")}
    assert of("import") == {("app/main.py", "os"), ("app/main.py", ".x"), ("web/a.js", "lib")}
    assert [r.path for r in found if r.kind == "error"] == ["app/bad.py"]
    nodes, links = code.graph_of(code.entities(tree))
    assert ("app.main.run/2", "app.main.helper/1", "calls") in {(r.src, r.dst, r.edge_type) for r in links.collect()}
    assert nodes.where("node_type = 'module'").count() == 3
    old = spark.createDataFrame([("app/main.py", "x"), ("gone.py", "y")], "path string, hash string")
    assert mapped(code.changed(tree, old), "path", "status") == {"app/main.py": "changed", "app/bad.py": "new", "web/a.js": "new", "gone.py": "deleted"}


def test_json_sources(spark, tmp_path):
    index = {"documents": [{"relativePath": "a.ts", "language": "ts", "symbols": [{"symbol": "pkg a/f().", "documentation": ["d"]}],
        "occurrences": [{"symbol": "pkg a/f().", "symbolRoles": 1, "range": [0, 1, 2]}, {"symbol": "pkg b/g().", "range": [3, 0, 1]}]}]}
    (tmp_path / "i.json").write_text(json.dumps(index, indent=1))
    symbols, seen = documents.symbol_index(spark, f"{tmp_path}/i.json")
    assert symbols.first().name == "f" and seen.where("is_definition").count() == 1
    assert [tuple(r) for r in documents.symbol_calls(seen).collect()] == [("pkg a/f().", "pkg b/g().")]
    (tmp_path / "g.json").write_text(json.dumps([{"query": "q", "relevant": [{"type": "function", "id": "x", "grade": 3}, {"type": "module", "id": "y"}]}]))
    assert mapped(documents.golden_set(spark, f"{tmp_path}/g.json"), "id", "grade") == {"function:x": 3, "module:y": 1}


def test_commit_log(spark):
    text = "\x1f".join(["s1", "Ann", "a@x", "2024-01-02T03:04:05+00:00", "first"]) + "\nM\ta.py\nR100\told.py\tnew.py\nD\tgone.py"
    history = documents.commits(spark.createDataFrame([(text,)], "value string"))
    touched = documents.changed_files(history)
    assert {(r.file, r.status) for r in touched.collect()} == {("a.py", "M"), ("new.py", "R")}
    owner = documents.file_owners(touched, F.lit("2024-01-12").cast("timestamp")).where("file = 'a.py'").first()
    assert (owner.last_author, owner.age_days, owner.commits) == ("Ann", 10, 1)
    blame = spark.createDataFrame([("f", i, s, "Ann") for i, s in enumerate("aabba")], "file string, line int, sha string, author string")
    assert sorted((r.first, r.last, r.sha) for r in documents.blame_runs(blame).collect()) == [(0, 1, "a"), (2, 3, "b"), (4, 4, "a")]


# --- streaming ------------------------------------------------------------------------------------------------------


def test_debounced_watch_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(base + dt.timedelta(milliseconds=m), p, k) for m, p, k in [(0, "a.ex", "modified"), (200, "b.py", "created"), (450, "a.ex", "modified"), (2000, "c.js", "deleted"), (3000, "d.ts", "modified"), (3100, "e.md", "modified")]]
    rows.append((base + dt.timedelta(minutes=5), "last.py", "created"))  # moves the watermark on
    schema = "ts timestamp, path string, kind string, project string"
    spark.createDataFrame([(*r, "p") for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = streams.finished(streams.changed_files(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "append")
    assert sorted(tuple(r.paths) for r in out.collect()) == [("a.ex", "b.py"), ("d.ts",)]


def test_incremental_refresh_stream(spark, tmp_path):
    schema = "id int, hash string, ts timestamp"
    now = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", now), (2, "b", now), (2, "c", now + dt.timedelta(seconds=1)), (3, "z", now)], schema).write.parquet(f"{tmp_path}/in")
    seen = []
    stored = lambda: spark.createDataFrame([(1, "a"), (2, "b")], "id int, hash string")
    query = streams.refresh(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), stored, "id", lambda df, n: seen.extend(r.id for r in df.collect()), f"{tmp_path}/cp")
    query.awaitTermination()
    assert sorted(seen) == [2, 3]


def test_user_sessions_stream(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    out = streams.finished(streams.user_sessions(streams.event_stream(spark, sf_dir)), "append")
    assert 0 < out.select("user_id").distinct().count() <= batch


BAD_VECTORS = [(90, None), (91, [1.0, None, 0.0]), (92, [float("nan"), 1.0, 0.0]), (93, [float("inf"), 1.0, 0.0]), (94, [1.0]), (95, []), (None, [1.0, 0.0, 0.0])]


def test_searches_leave_bad_vectors_out(spark):
    good = [(i, [float(i), 1.0, float(i % 3)]) for i in range(9)] + [(20, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + BAD_VECTORS, "vec_id int, embedding array<double>")
    clean = spark.createDataFrame(good, "vec_id int, embedding array<double>")
    for block in (2, 2048):
        want = {(r.query_id, r.rank, r.id, r.score) for r in similarity.nearest(clean, 3).collect()}
        assert {(r.query_id, r.rank, r.id, r.score) for r in similarity.nearest(df, 3, block=block).collect()} == want and len(want) == 30
        pairs = {(r.id1, r.id2) for r in similarity.similar_pairs(df, 0.9, block=block).collect()}
        assert pairs == {(r.id1, r.id2) for r in similarity.similar_pairs(clean, 0.9).collect()} and pairs
    none = df.where("false")
    assert similarity.nearest(none, 3).count() == similarity.similar_pairs(none, 0.5).count() == 0
    assert similarity.nearest(df.where("vec_id >= 90"), 3).count() == 0


def test_trailing_windows_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(0, 3000), float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, at long, amount double")
    for r in timeline.trailing(df, "k", "at", "amount", {"short": 10, "long": 200}).collect():
        for name, span in (("short", 10), ("long", 200)):
            seen = [v for _, k, at, v in rows if k == r.k and r.at - span <= at <= r.at]
            assert (r[f"n_{name}"], r[f"sum_{name}"]) == (len(seen), sum(seen))


def test_label_metrics_are_those_of_the_pairs(spark):
    items = spark.createDataFrame([(i, "xyzw"[min(i % 4, 2)] if i else "w") for i in range(30)], "vec_id int, label string")
    results = spark.createDataFrame([(q, r, (q * 7 + r * r) % 31) for q in range(30) for r in range(1, 13)], "query_id int, rank int, id int").where("query_id <> id")
    pairs = items.alias("a").join(items.alias("b"), "label").where("a.vec_id <> b.vec_id").selectExpr("a.vec_id AS query_id", "b.vec_id AS id", "1 AS grade")
    rows = lambda df: sorted((r.query_id, round(r.ndcg, 5), r.mrr, r.precision, round(r.recall, 9)) for r in df.collect())
    assert rows(retrieval.label_metrics(results, items)) == rows(retrieval.relevance_metrics(results, pairs))


def test_packing_skips_pieces_that_repeat_lines(spark):
    import random

    rng = random.Random(2)
    rows = [(q, r, rng.randint(1, 3), s := rng.randint(1, 60), s + rng.randint(0, 30), rng.randint(10, 90)) for q in range(8) for r in range(1, 21)]
    df = spark.createDataFrame(rows, "query_id int, rank int, id long, start int, end int, size long")
    want = set()
    for q in range(8):
        used, kept = 0, []
        for _, r, i, s, e, size in [x for x in rows if x[0] == q]:
            repeats = any(i == j and (min(e, f) - max(s, t) + 1) / (min(e - s, f - t) + 1) >= 0.6 for j, t, f in kept)
            if used + size <= 400 and not repeats:
                used, kept = used + size, [*kept, (i, s, e)]
                want.add((q, r))
    assert {(r.query_id, r.rank) for r in retrieval.packed_ranges(df, 400).collect()} == want and len(want) < len(rows)


def test_affected_tests_and_names(spark):
    fns = spark.createDataFrame([(1, "A", "core", 0), (2, "B", "use", 1), (3, "BTest", "checks", 0), (4, "C", "test_all", 0), (5, "C", "use", 2), (6, "B", "use", 0)], "fn int, module string, name string, arity int")
    calls = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 1)], "src int, dst int")
    target = spark.createDataFrame([(1,)], "node int")
    assert sorted((r.fn, r.level) for r in analysis.affected_tests(calls, fns, target).collect()) == [(3, 2), (4, 3)]
    assert sorted(r.fn for r in analysis.affected_tests(calls, fns, target, depth=3).collect()) == [3]
    wanted = spark.createDataFrame([("B", "use"), ("Z", "none")], "module string, name string")
    assert [(r.fn, r.arity) for r in store.find_functions(fns, wanted).collect()] == [(6, 0)]


def test_smells_and_trackers(spark):
    rows = spark.createDataFrame([("a", 51, 4, 6, 15), ("b", 50, 5, 5, 99)], "path string, statements int, nesting int, parameters int, cognitive int")
    assert sorted((r.path, r.smell, r.over) for r in analysis.smells(rows).collect()) == [("a", "parameters", 1), ("a", "statements", 1), ("b", "cognitive", 84), ("b", "nesting", 1)]
    status = spark.createDataFrame([("a", "changed"), ("b", "unchanged"), ("c", "deleted"), ("d", "new")], "path string, status string")
    entities = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "path string")
    assert store.tracker_stats(status, entities).first().asDict() == {
        "total_files": 3, "changed_files": 1, "unchanged_files": 1, "deleted_files": 1, "total_entities": 3, "stale_entities": 2,
    }
    none = store.tracker_stats(status.where("false"), entities).first()
    assert none.total_files == none.stale_entities == 0


def test_strings_and_comments(spark):
    python = "# one\n# two\nx = 'abc' + \"de\"\n\n  # three\ny = \"a \\\" b\""
    script = "// first\nlet s = `tpl ${x}`, t = 'it'\n# no comment"
    df = spark.createDataFrame([("p", "python", python), ("j", "javascript", script), ("r", "ruby", "# x")], "path string, language string, content string")
    assert sorted((r.path, r.line, r.content) for r in code.string_literals(df).collect()) == [("j", 2, "tpl ${x}"), ("p", 3, "abc"), ("p", 6, 'a \\" b')]
    assert sorted((r.path, r.line, r.content) for r in code.comment_blocks(df).collect()) == [("j", 1, "first"), ("p", 2, "one two"), ("p", 5, "three")]


def test_requests_of_blamed_lines(spark):
    rows = [json.dumps({"number": i, "title": f"t{i}", "state": "MERGED", "mergeCommit": {"oid": s}, "comments": [{"path": "f", "line": i, "body": "b"}]}) for i, s in [(1, "x"), (2, "x"), (3, "y")]]
    rows += [json.dumps({"number": 4, "title": "open", "state": "OPEN", "mergeCommit": None, "comments": []})]
    requests, comments = documents.pull_requests(spark.createDataFrame([(r,) for r in rows], "value string"), known=1)
    assert sorted(r.number for r in requests.collect()) == [2, 3, 4] and sorted(r.line for r in comments.collect()) == [2, 3]
    blame = spark.createDataFrame([("f", 1, "x"), ("f", 2, "z")], "file string, line int, sha string")
    assert sorted((r.line, r.pr_number) for r in documents.blame_requests(blame, requests).collect()) == [(1, 2), (2, None)]


def test_search_leaves_chunks_out_unless_asked_for(spark):
    rows = [(i, "chunk" if i % 2 else "function", [1.0, i / 10], i - 1) for i in range(1, 30)] + [(99, "function", None, 0)]
    df = spark.createDataFrame(rows, "id int, node_type string, embedding array<double>, parent int")
    probe = F.array(F.lit(1.0), F.lit(0.0))
    assert [r.id for r in similarity.search(df, probe, 3).collect()] == [2, 4, 6]
    assert [(r.id, r.chunk_parent) for r in similarity.search(df, probe, 3, include_chunks=True).collect()] == [(1, 0), (2, None), (3, 2)]
    assert [r.id for r in similarity.search(df, probe, 2, node_type="chunk").collect()] == [1, 3]


def test_rounds_until_nothing_moves(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 5, 1.0), (5, 6, 1.0), (6, 4, 1.0), (3, 4, 0.1)], "src int, dst int, weight double")
    settled = {r.node: r.community for r in graph.local_moves(edges, rounds=None).collect()}
    assert settled[1] == settled[2] == settled[3] != settled[4] == settled[5] == settled[6]
    with pytest.raises(RuntimeError):
        graph.label_propagation(spark.createDataFrame([(1, 2)], "src int, dst int"), iterations=None, limit=3)  # the two change places
    ring = spark.createDataFrame([(i, i % 4 + 1) for i in range(1, 5)], "src int, dst int")
    assert [r.cycle for r in graph.simple_cycles(ring, max_length=None).collect()] == [[1, 2, 3, 4]]
    assert graph.simple_cycles(ring, max_length=3).count() == 0


def test_features_of_trees(spark):
    rows = [('["binary_op",{"category":"boolean","operator":"and"}]',), ('["binary_op",{"operator":"<<"}]',), ('["child_spec",{"module":"M"}]',), ('["container",{"container_type":"fsm","name":"N"}]',), ('["lambda",{}]',), ("text",)]
    got = [r.f for r in spark.createDataFrame(rows, "t string").select(equivalence.features(F.col("t")).alias("f")).collect()]
    assert got == [["boolean", "logic", "and"], ["operation", "<<"], ["child_spec", "supervision", "otp", "worker", "M"], ["container", "N", "state_machine", "fsm", "transitions"], ["lambda", "function", "closure", "anonymous"], ["code", "construct"]]


def test_nearest_rows_are_chosen_in_single_precision_and_scored_in_double(monkeypatch):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(3500, 24))
    y[200:260] = y[200] * rng.uniform(1, 2, (60, 1))  # more ties than are asked for
    y[300:304] = y[300] + rng.normal(size=(4, 24)) * 1e-7  # apart only in double precision
    y[400:403] = 0
    ids = np.arange(3500) * 3
    ids[500:503] = ids[500]
    y = np.divide(y, size := np.sqrt((y * y).sum(axis=1, keepdims=True)), out=np.zeros_like(y), where=size > 0)
    whole, stripes = [], similarity._stripes

    def counted(x, other, digits):
        whole.append(len(x))
        return stripes(x, other, digits)

    monkeypatch.setattr(similarity, "_stripes", counted)
    for digits in (6, 9):
        got = [np.concatenate(part) for part in zip(*similarity._best(ids[:900], y[:900], ids, y, 4, digits), strict=True)]
        scores = np.round(y[:900] @ y.T, digits)
        scores[ids[:900, None] == ids] = -np.inf
        best = np.array([np.lexsort((ids, -row))[:4] for row in scores])
        want = [(ids[i], ids[j], round(scores[i, j], digits)) for i, row in enumerate(best) for j in row]
        assert sorted((a, b, round(c, digits)) for a, b, c in zip(*got, strict=True)) == sorted(want)
        assert 60 <= whole.pop() < 100  # the ties, zeros and repeated ids; all others by a few candidates
