"""Graph queries over the module and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources import adapters as a
from ..sources.adapters import sql_with


def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-, out- and total degree of every function, those without calls included."""
    return g.degree_centrality(a.calls(spark, sf_dir), a.functions(spark, sf_dir).select(F.col("fn").alias("node")))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean degree and density of modules and functions with their imports and calls."""
    fns = a.functions(spark, sf_dir).select(F.col("fn").cast("string").alias("node"))
    nodes = fns.unionByName(a.modules(spark, sf_dir).select(F.col("module").alias("node")))
    calls = a.calls(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return g.graph_stats(nodes, calls.unionByName(a.imports(spark, sf_dir).select("src", "dst")))


def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type."""
    fns = a.functions(spark, sf_dir).select(F.lit("function").alias("node_type"))
    return fns.unionByName(a.modules(spark, sf_dir).select(F.lit("module").alias("node_type"))).groupBy("node_type").count().withColumnRenamed("count", "n")


def pagerank_10it(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of functions after ten iterations."""
    return g.pagerank(a.calls(spark, sf_dir), max_iterations=10, tolerance=None).select("node", F.round("score", 8).alias("score"))


def pagerank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten modules of highest rank after twenty iterations."""
    scores = g.pagerank(a.imports(spark, sf_dir), max_iterations=20, tolerance=None)
    return scores.select("node", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "node").limit(10)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every function in the undirected call graph."""
    return g.components(a.calls(spark, sf_dir))


def supply_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each component of the graph of suppliers and the parts they supply."""
    li = a.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    edges = li.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return g.components(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and number of shortest paths between all modules."""
    return g.shortest_paths(a.imports(spark, sf_dir))


def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness of every module."""
    return g.closeness_centrality(a.imports(spark, sf_dir)).select("node", F.round("closeness", 6).alias("closeness"))


def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of every module."""
    return g.betweenness_centrality(a.imports(spark, sf_dir)).select("node", F.round("betweenness", 6).alias("betweenness"))


def paths_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All simple paths of up to four imports."""
    paths = g.simple_paths(a.imports(spark, sf_dir), max_depth=4)
    return paths.select("src", "dst", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("length"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All module cycles of two to four dependencies."""
    found = g.simple_cycles(a.module_dependencies(spark, sf_dir), max_length=4)
    return found.select(F.array_join("cycle", ">").alias("cycle"), F.size("cycle").alias("length"))


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many functions each function reaches and is reached by."""
    pairs = g.reachable(a.calls(spark, sf_dir))
    both = pairs.select("node", F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("reached", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("reaches"), F.sum("i").alias("reached_by"))


def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is affected by a change of each private function, five levels deep."""
    targets = a.functions(spark, sf_dir).where("visibility = 'private'").select(F.col("fn").alias("node"))
    return g.affected(a.calls(spark, sf_dir), targets, depth=5)


def impact_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules within two imports of each module, in either direction."""
    nodes = a.modules(spark, sf_dir).select(F.col("module").alias("node"))
    return g.neighbourhood(a.imports(spark, sf_dir), nodes, depth=2)


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the import graph with areas as communities."""
    areas = a.modules(spark, sf_dir).select(F.col("module").alias("node"), F.col("area").alias("community"))
    return g.modularity(a.imports(spark, sf_dir), areas).select(F.round("modularity", 6).alias("modularity"))


def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of functions after five synchronous rounds."""
    return g.label_propagation(a.calls(spark, sf_dir), iterations=5)


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of functions after four rounds of local moving."""
    return g.local_moves(a.calls(spark, sf_dir), rounds=4)


def module_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies between modules: imports, and calls lifted to modules."""
    return a.module_dependencies(spark, sf_dir)


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import graph as JSON lines, read again: nodes with rank, degree and community, links with their weight."""
    j = lambda c: F.get_json_object("json", f"$.{c}")
    return g.export_d3(a.imports(spark, sf_dir)).select(
        "kind", F.coalesce(j("id"), j("source")).alias("id"), j("target").alias("target"), F.coalesce(j("pagerank"), j("weight")).cast("double").alias("value"),
        j("degree").cast("long").alias("degree"), j("community").alias("community"),
    )


def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import graph as DOT statements."""
    return g.export_dot(a.imports(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        degree_centrality, graph_stats, node_counts, pagerank_10it, pagerank_top10, components, supply_components, shortest_paths,
        closeness, betweenness, paths_bounded, cycles, reachability, impact_bfs, impact_radius, modularity,
        label_propagation, communities, module_adjacency, graph_export, graph_dot,
    )
}


def pagerank_sql(edges: str, iterations: int) -> str:
    steps = [
        "e AS (SELECT DISTINCT src, dst FROM " + edges + ")",
        "v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)",
        "o AS (SELECT src, count(*) AS n FROM e GROUP BY src)",
        "p0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS score FROM v)",
    ]
    for i in range(iterations):
        steps.append(
            f"""p{i + 1} AS (SELECT v.node, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * coalesce(f.flow, 0) AS score
            FROM v LEFT JOIN (SELECT e.dst, sum(p.score / o.n) AS flow FROM e JOIN p{i} p ON e.src = p.node JOIN o ON o.src = e.src GROUP BY e.dst) f ON v.node = f.dst)"""
        )
    return ",\n".join(steps)


def _levels_sql(depth: int) -> str:
    """Shortest paths as one table ``sp`` of unrolled levels over ``imports``."""
    steps = [
        "e AS (SELECT DISTINCT src, dst FROM imports)",
        "v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)",
        "s0 AS (SELECT node AS source, node, 0 AS dist, 1::BIGINT AS sigma FROM v)",
    ]
    for i in range(1, depth + 1):
        steps.append(
            f"""s{i} AS (SELECT * FROM s{i - 1} UNION ALL
            SELECT s.source, e.dst, {i}, CAST(sum(s.sigma) AS BIGINT) FROM s{i - 1} s JOIN e ON s.node = e.src
            WHERE s.dist = {i - 1} AND (s.source, e.dst) NOT IN (SELECT (source, node) FROM s{i - 1}) GROUP BY 1, 2)"""
        )
    return ",\n".join([*steps, f"sp AS MATERIALIZED (SELECT * FROM s{depth})"])


def _label_sql(rounds: int) -> str:
    steps = [
        "near AS (SELECT DISTINCT src AS node, dst AS near FROM calls UNION ALL SELECT DISTINCT dst, src FROM calls)",
        "l0 AS (SELECT DISTINCT node, node AS label FROM near)",
    ]
    for i in range(rounds):
        steps.append(
            f"""l{i + 1} AS (SELECT node, label FROM (SELECT near.node, l.label, row_number() OVER (PARTITION BY near.node ORDER BY count(*) DESC, l.label) AS r
            FROM near JOIN l{i} l ON near.near = l.node GROUP BY near.node, l.label) WHERE r = 1)"""
        )
    return ",\n".join(steps)


def _moves_sql(rounds: int) -> str:
    steps = [
        "near AS (SELECT src AS node, dst AS near, weight FROM calls UNION ALL SELECT dst, src, weight FROM calls WHERE src <> dst)",
        "c0 AS (SELECT DISTINCT node, node AS community FROM near)",
    ]
    for i in range(rounds):
        steps.append(
            f"""pull{i} AS (SELECT near.node, c.community AS dest, sum(weight) AS w FROM near JOIN c{i} c ON near.near = c.node GROUP BY 1, 2),
            own{i} AS (SELECT c.node, c.community, coalesce(p.w, 0) AS own FROM c{i} c LEFT JOIN pull{i} p ON c.node = p.node AND c.community = p.dest),
            best{i} AS (SELECT node, dest FROM (SELECT o.node, p.dest, row_number() OVER (PARTITION BY o.node ORDER BY p.w DESC, p.dest) AS r
              FROM own{i} o JOIN pull{i} p ON o.node = p.node WHERE p.w > o.own) WHERE r = 1),
            c{i + 1} AS (SELECT o.node, CASE WHEN b.dest < o.community THEN b.dest ELSE o.community END AS community FROM own{i} o LEFT JOIN best{i} b ON o.node = b.node)"""
        )
    return ",\n".join(steps)


ORACLE = {
    "degree_centrality": sql_with("calls", "functions")
    + """ SELECT fn AS node, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree,
            CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS BIGINT) AS total_degree
          FROM functions LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM calls GROUP BY dst) i ON i.dst = fn
          LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM calls GROUP BY src) o ON o.src = fn""",
    "graph_stats": sql_with("calls", "imports", "functions")
    + """, c AS (SELECT (SELECT count(*) FROM functions) + (SELECT count(*) FROM modules) AS n,
              (SELECT count(*) FROM calls) + (SELECT count(*) FROM imports) AS m)
          SELECT CAST(n AS BIGINT) AS node_count, CAST(m AS BIGINT) AS edge_count, round(2.0::DOUBLE * m / n, 2) AS average_degree,
            round(m::DOUBLE / (n * (n - 1)), 4) AS density FROM c""",
    "node_counts": "SELECT 'function' AS node_type, count(*) AS n FROM part UNION ALL SELECT 'module', count(*) FROM nation",
    "pagerank_10it": sql_with("calls") + ", " + pagerank_sql("calls", 10) + " SELECT node, round(score, 8) AS score FROM p10",
    "pagerank_top10": sql_with("imports") + ", " + pagerank_sql("imports", 20)
    + " SELECT node, round(score, 8) AS score FROM p20 ORDER BY round(score, 8) DESC, node LIMIT 10",
    "components": sql_with("calls", recursive=True)
    + """, near AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls),
          r AS (SELECT a AS node, a AS other FROM near UNION SELECT r.node, near.b FROM r JOIN near ON r.other = near.a)
          SELECT node, min(other) AS component FROM r GROUP BY node""",
    "shortest_paths": sql_with("imports") + ", " + _levels_sql(10) + " SELECT source, node, dist, sigma FROM sp",
    "closeness": sql_with("imports") + ", " + _levels_sql(10)
    + """ SELECT source AS node, round(CASE WHEN sum(dist) > 0 THEN count(*) FILTER (dist > 0) / sum(dist)::DOUBLE
            * count(*) FILTER (dist > 0) / ((SELECT count(*) FROM v) - 1) ELSE 0 END, 6) AS closeness FROM sp GROUP BY source""",
    "betweenness": sql_with("imports") + ", " + _levels_sql(10)
    + """, n AS (SELECT count(*) AS n FROM v),
          b AS (SELECT x.node, sum(x.sigma * y.sigma / z.sigma::DOUBLE) AS b FROM sp x JOIN sp y ON x.node = y.source
                JOIN sp z ON z.source = x.source AND z.node = y.node
                WHERE x.source <> x.node AND x.node <> y.node AND x.source <> y.node AND x.dist + y.dist = z.dist GROUP BY x.node)
          SELECT v.node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM v LEFT JOIN b ON v.node = b.node, n""",
    "paths_bounded": sql_with("imports", recursive=True)
    + """, p AS (SELECT src, dst, [src, dst] AS path FROM imports WHERE src <> dst UNION ALL
            SELECT p.src, i.dst, list_append(p.path, i.dst) FROM p JOIN imports i ON p.dst = i.src
            WHERE len(p.path) <= 4 AND NOT list_contains(p.path, i.dst))
          SELECT src, dst, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM p""",
    "cycles": sql_with("module_dependencies", recursive=True)
    + """, e AS (SELECT src, dst FROM module_dependencies WHERE src <> dst),
          p AS (SELECT src, dst, [src, dst] AS path FROM e WHERE dst > src UNION ALL
            SELECT p.src, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.dst = e.src
            WHERE len(p.path) < 4 AND e.dst > p.src AND NOT list_contains(p.path, e.dst))
          SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INTEGER) AS length FROM p JOIN e ON p.dst = e.src AND e.dst = p.src""",
    "reachability": sql_with("calls", recursive=True)
    + """, r AS (SELECT src AS node, dst AS reached FROM calls UNION SELECT r.node, c.dst FROM r JOIN calls c ON r.reached = c.src),
          u AS (SELECT node, 1 AS o, 0 AS i FROM r UNION ALL SELECT reached, 0, 1 FROM r)
          SELECT node, CAST(sum(o) AS BIGINT) AS reaches, CAST(sum(i) AS BIGINT) AS reached_by FROM u GROUP BY node""",
    "impact_bfs": sql_with("calls", "functions", recursive=True)
    + """, r AS (SELECT fn AS target, fn AS node, 0 AS level FROM functions WHERE visibility = 'private' UNION
            SELECT r.target, c.src, r.level + 1 FROM r JOIN calls c ON r.node = c.dst WHERE r.level < 4)
          SELECT target, node, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY target, node""",
    "impact_radius": sql_with("imports", recursive=True)
    + """, near AS (SELECT src AS a, dst AS b FROM imports UNION SELECT dst, src FROM imports),
          r AS (SELECT module AS target, module AS node, 0 AS level FROM modules UNION
            SELECT r.target, near.b, r.level + 1 FROM r JOIN near ON r.node = near.a WHERE r.level < 2)
          SELECT target, node, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY target, node""",
    "modularity": sql_with("imports")
    + """, n AS (SELECT weight, a.area AS a, b.area AS b FROM imports JOIN modules a ON src = a.module JOIN modules b ON dst = b.module),
          d AS (SELECT c, sum(weight) AS degree FROM (SELECT a AS c, weight FROM n UNION ALL SELECT b, weight FROM n WHERE a <> b) GROUP BY c)
          SELECT round((SELECT sum(weight) FILTER (a = b) / sum(weight) FROM n) - (SELECT sum(degree * degree) FROM d) / (2 * pow((SELECT sum(weight) FROM n), 2)), 6) AS modularity""",
    "label_propagation": sql_with("calls") + ", " + _label_sql(5) + " SELECT node, label FROM l5",
    "communities": sql_with("calls") + ", " + _moves_sql(4) + " SELECT node, community FROM c4",
    "supply_components": """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem),
          near AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
          hops AS (SELECT a AS s, least(a, min(b)) AS label FROM near GROUP BY a),
          h1 AS MATERIALIZED (SELECT n.a AS s, least(min(h.label), min(o.label)) AS label FROM near n JOIN hops h ON n.b = h.s JOIN hops o ON n.a = o.s GROUP BY n.a),
          h2 AS MATERIALIZED (SELECT n.a AS s, least(min(h.label), min(o.label)) AS label FROM near n JOIN h1 h ON n.b = h.s JOIN h1 o ON n.a = o.s GROUP BY n.a),
          h3 AS MATERIALIZED (SELECT n.a AS s, least(min(h.label), min(o.label)) AS label FROM near n JOIN h2 h ON n.b = h.s JOIN h2 o ON n.a = o.s GROUP BY n.a),
          h4 AS MATERIALIZED (SELECT n.a AS s, least(min(h.label), min(o.label)) AS label FROM near n JOIN h3 h ON n.b = h.s JOIN h3 o ON n.a = o.s GROUP BY n.a),
          h5 AS MATERIALIZED (SELECT n.a AS s, least(min(h.label), min(o.label)) AS label FROM near n JOIN h4 h ON n.b = h.s JOIN h4 o ON n.a = o.s GROUP BY n.a),
          h6 AS (SELECT n.a AS s, least(min(h.label), min(o.label)) AS label FROM near n JOIN h5 h ON n.b = h.s JOIN h5 o ON n.a = o.s GROUP BY n.a)
          SELECT label AS component, count(*) AS nodes FROM h6 GROUP BY label""",
    "graph_export": sql_with("imports", recursive=True) + ", " + pagerank_sql("imports", 10)
    + """, d AS (SELECT node, sum(n) AS degree FROM (SELECT src AS node, count(DISTINCT dst) AS n FROM imports GROUP BY src UNION ALL SELECT dst, count(DISTINCT src) FROM imports GROUP BY dst) GROUP BY node),
          near AS (SELECT src AS a, dst AS b FROM imports UNION SELECT dst, src FROM imports),
          r AS (SELECT a AS node, a AS other FROM near UNION SELECT r.node, near.b FROM r JOIN near ON r.other = near.a),
          c AS (SELECT node, min(other) AS community FROM r GROUP BY node)
          SELECT 'node' AS kind, node AS id, NULL AS target, round(score, 6) AS value, CAST(degree AS BIGINT) AS degree, community FROM p10 JOIN d USING (node) JOIN c USING (node)
          UNION ALL SELECT 'link', src, dst, weight, NULL, NULL FROM imports""",
    "graph_dot": sql_with("imports") + ", " + pagerank_sql("imports", 10)
    + """ SELECT '"' || node || '" [intensity=' || format('{:.3f}', score / max(score) OVER ()) || '];' AS line FROM p10
          UNION ALL SELECT '"' || src || '" -> "' || dst || '" [penwidth=' || format('{:.2f}', 1 + 2 * (weight - 1)) || '];' FROM imports""",
    "module_adjacency": sql_with("module_dependencies") + " SELECT src, dst FROM module_dependencies",
}
