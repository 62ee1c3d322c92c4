"""Communities in levels, paths between modules, approximate neighbours and clones of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, communities, equivalence, leaders, neighbour_graph, paths
from ..sources import adapters as a
from ..sources.adapters import sql_with, table
from .retrieval_queries import _PAIRS


def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of functions in two levels, four rounds each, with the modularity of each level."""
    found = communities.louvain(a.calls(spark, sf_dir), max_levels=2, rounds=4)
    return found.select("level", "node", "community", F.round("modularity", 6).alias("modularity"))


def find_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five import paths of up to four edges between any two modules, itself included."""
    nodes = a.modules(spark, sf_dir).select("module")
    pairs = nodes.select(F.col("module").alias("src")).join(nodes.select(F.col("module").alias("dst")))  # the question: all pairs of 25 modules
    found = paths.find_paths(a.imports(spark, sf_dir), pairs, max_depth=4, max_paths=5)
    return found.select("src", "dst", F.array_join("path", ">").alias("path"), "length", "number")


def path_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules from which paths over imports and calls may be many."""
    e = a.module_dependencies(spark, sf_dir)
    return paths.density_warnings(e, e)


def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors found near every fiftieth vector by walking a neighbour graph, and how many were compared."""
    emb = table(spark, sf_dir, "embeddings")
    graph = neighbour_graph.build(emb, k=20)
    return neighbour_graph.search(emb, graph, F.col("vec_id") % 50 == 0, k=10, beam=100, open_at_once=8)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return clones.token_files(docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"))


def clone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal spans of twelve words or more that two documents share."""
    return clones.clone_spans(_files(spark, sf_dir))


def clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are clones as a whole: as written, in canonical form, or for four fifths of their runs."""
    files = _files(spark, sf_dir)
    return clones.clone_pairs(files, clones.shared_runs(files, threshold=0.8))


def _order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as syntax trees: a definition with a call for each line, which holds its quantity."""
    call = F.concat(
        F.lit('["function_call",{"name":"'), "l_returnflag", F.lit('","at":{"line":'), F.col("l_linenumber").cast("string"), F.lit('}},["literal",{},'), F.col("l_quantity").cast("long").cast("string"), F.lit("]]")
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), call.alias("call"))
    by = lines.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("call")), ",").alias("calls"))
    head = F.concat(F.lit('["function_def","'), "o_orderstatus", F.lit('",'), "calls", F.lit("]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(by, "o_orderkey").select(F.col("o_orderkey").alias("id"), head.alias("tree"))


PATTERNS = {
    "anything": "_",
    "any_call": ["function_call", "_", "_"],
    "first_return": ["function_call", {"name": "R", "at": {"line": 1}}, "_"],
    "finished": ["function_def", "F", "_", "_"],
    "seven": ["literal", {}, 7],
}


def tree_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many subtrees of orders as syntax trees each of five patterns describes, and in how many trees."""
    found = equivalence.find_patterns(equivalence.tree_nodes(_order_trees(spark, sf_dir)), PATTERNS)
    return found.groupBy("pattern").agg(F.count("*").alias("nodes"), F.count_distinct("id").alias("trees"), F.max("depth").alias("deepest"))


def similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in groups around leaders, each with a cosine of 0.3 or more to its leader."""
    return leaders.vector_leaders(table(spark, sf_dir, "embeddings"), 0.3)


QUERIES = {f.__name__: f for f in (louvain, find_paths, path_warnings, ann_search, clone_spans, clone_pairs, tree_patterns, similarity_groups)}


def _louvain_sql(levels: int, rounds: int) -> str:
    """Tables ``near1`` to ``c{levels}_{rounds}`` and the modularity ``m1`` of each level."""
    steps = ["near1 AS MATERIALIZED (SELECT node, near, sum(weight) AS weight FROM (SELECT src AS node, dst AS near, weight FROM calls UNION ALL SELECT dst, src, weight FROM calls) GROUP BY ALL)"]

    def named(name: str, level: int, where: str) -> list[str]:
        return [
            f"{name} AS MATERIALIZED (SELECT n.node, n.near, n.weight, a.community, b.community AS dest FROM near{level} n JOIN {where} a ON a.node = n.node JOIN {where} b ON b.node = n.near)",
            f"""q{name} AS MATERIALIZED (SELECT sum(d) * sum(i) - sum(d * d) AS q, sum(d) AS m FROM (
                  SELECT sum(weight) AS d, coalesce(sum(weight) FILTER (community = dest), 0) AS i FROM {name} GROUP BY community))""",
        ]

    for level in range(1, levels + 1):
        steps.append(f"c{level}_0 AS MATERIALIZED (SELECT DISTINCT node, node AS community FROM near{level})")
        for r in range(rounds):
            n, side = f"n{level}_{r}", "<" if r % 2 == 0 else ">"
            steps += named(n, level, f"c{level}_{r}")
            steps += [
                f"p{n} AS (SELECT node, community, dest, coalesce(sum(weight) FILTER (node <> near), 0) AS w, sum(weight) AS whole FROM {n} GROUP BY ALL)",
                f"d{n} AS MATERIALIZED (SELECT node, community, sum(whole) AS degree, coalesce(sum(w) FILTER (dest = community), 0) AS own FROM p{n} GROUP BY ALL)",
                f"s{n} AS MATERIALIZED (SELECT community, sum(degree) AS total FROM d{n} GROUP BY ALL)",
                f"""g{n} AS (SELECT p.node, p.dest, (SELECT m FROM q{n}) * (p.w - d.own) - d.degree * (t.total - s.total + d.degree) AS gain
                    FROM p{n} p JOIN d{n} d ON d.node = p.node JOIN s{n} s ON s.community = d.community JOIN s{n} t ON t.community = p.dest WHERE p.dest {side} p.community AND p.w > 0)""",
                f"b{n} AS (SELECT node, dest FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, dest) AS r FROM g{n} WHERE gain > 0) WHERE r = 1)",
                f"t{n} AS MATERIALIZED (SELECT d.node, coalesce(b.dest, d.community) AS community FROM d{n} d LEFT JOIN b{n} b ON b.node = d.node)",
            ]
            steps += named(f"x{n}", level, f"t{n}")
            steps.append(f"c{level}_{r + 1} AS MATERIALIZED (SELECT c.node, CASE WHEN (SELECT q FROM qx{n}) > (SELECT q FROM q{n}) THEN t.community ELSE c.community END AS community FROM c{level}_{r} c JOIN t{n} t ON t.node = c.node)")
        steps += named(f"e{level}", level, f"c{level}_{rounds}")
        steps.append(f"m{level} AS (SELECT q / (m * m) AS modularity FROM qe{level})")
        steps.append(f"near{level + 1} AS MATERIALIZED (SELECT community AS node, dest AS near, sum(weight) AS weight FROM e{level} GROUP BY ALL)")
    return ",\n".join(steps)


_SPANS = r"""
        files AS (
          SELECT source || '/' || doc_id AS path, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS raw FROM documents WHERE text IS NOT NULL),
        tokens AS MATERIALIZED (
          SELECT path, raw, list_transform(raw, lambda x: regexp_replace(translate(lower(x), '123456789', '000000000'), '[^\p{L}0]', '', 'g')) AS tokens FROM files),
        classes AS MATERIALIZED (SELECT path, raw, tokens, min(path) OVER (PARTITION BY tokens) AS first FROM tokens),
        runs AS MATERIALIZED (
          SELECT path, pos, hash(list_slice(tokens, pos + 1, pos + 8)) AS h, hash(list_slice(raw, pos + 1, pos + 8)) AS e
          FROM (SELECT path, raw, tokens, unnest(range(len(tokens) - 7)) AS pos FROM classes WHERE path = first AND len(tokens) >= 8)),
        along AS (SELECT x.path AS file1, y.path AS file2, x.pos AS start1, y.pos - x.pos AS shift, x.e = y.e AS same FROM runs x JOIN runs y ON x.h = y.h AND x.path < y.path),
        islands AS (SELECT *, start1 - row_number() OVER (PARTITION BY file1, file2, shift ORDER BY start1) AS island FROM along),
        spans AS MATERIALIZED (
          SELECT file1, file2, CASE WHEN bool_and(same) THEN 'I' ELSE 'II' END AS kind, min(start1) AS start1, min(start1) + shift AS start2, count(*) + 7 AS tokens
          FROM islands GROUP BY file1, file2, shift, island HAVING count(*) >= 5)"""

ORACLE = {
    "louvain": sql_with("calls") + ", " + _louvain_sql(2, 4)
    + """ SELECT 1 AS level, node, community, round(modularity, 6) AS modularity FROM c1_4, m1
          UNION ALL SELECT 2, c1_4.node, c2_4.community, round(m2.modularity, 6) FROM c1_4 JOIN c2_4 ON c1_4.community = c2_4.node, m1, m2 WHERE m2.modularity - m1.modularity > 0.0001""",
    "find_paths": sql_with("imports", recursive=True)
    + """, e AS (SELECT DISTINCT src, dst FROM imports),
          p AS (SELECT module AS src, module AS dst, [module] AS path FROM modules UNION ALL
            SELECT p.src, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.dst = e.src WHERE len(p.path) <= 4 AND NOT list_contains(p.path, e.dst)),
          n AS (SELECT src, dst, path, len(path) - 1 AS length, row_number() OVER (PARTITION BY src, dst ORDER BY len(path), path) AS number FROM p)
          SELECT src, dst, array_to_string(path, '>') AS path, CAST(length AS INTEGER) AS length, CAST(number AS INTEGER) AS number FROM n WHERE number <= 5""",
    "path_warnings": sql_with("module_dependencies")
    + """ SELECT src AS node, count(*) AS out_degree, CASE WHEN count(*) >= 20 THEN 'dense' ELSE 'moderate' END AS level
          FROM module_dependencies GROUP BY src HAVING count(*) >= 10""",
    "clone_spans": "WITH " + _SPANS + """
        SELECT file1, file2, kind, CAST(start1 AS INTEGER) AS start1, CAST(start2 AS INTEGER) AS start2, tokens FROM spans""",
    "clone_pairs": "WITH " + _SPANS + """,
        equal AS (SELECT c.first AS file1, c.path AS file2, CASE WHEN c.raw = f.raw THEN 'I' ELSE 'II' END AS kind, 1.0::DOUBLE AS similarity
          FROM classes c JOIN classes f ON f.path = c.first WHERE c.path <> c.first),
        covered AS (SELECT file1, file2, count(DISTINCT pos) AS shared FROM (SELECT file1, file2, unnest(range(start1, start1 + tokens - 7)) AS pos FROM spans) GROUP BY ALL),
        shares AS (SELECT file1, file2, round(shared / greatest(len(a.tokens) - 7, len(b.tokens) - 7)::DOUBLE, 6) AS similarity
          FROM covered JOIN classes a ON a.path = file1 JOIN classes b ON b.path = file2)
        SELECT file1, file2, kind, similarity FROM equal UNION ALL SELECT file1, file2, 'III', similarity FROM shares WHERE similarity >= 0.8""",
    "similarity_groups": f"""WITH RECURSIVE {_PAIRS}, linked AS (SELECT id1 AS id, id2 AS other FROM pairs WHERE score >= 0.3 UNION ALL SELECT id2, id1 FROM pairs WHERE score >= 0.3),
        near AS (SELECT id, list(other) AS l FROM linked GROUP BY id),
        n AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS k, coalesce(l, []) AS l FROM embeddings LEFT JOIN near ON id = vec_id),
        walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS led, 0::BIGINT AS node, 0::BIGINT AS leader
          UNION ALL SELECT k, CASE WHEN own IS NULL THEN list_append(led, id) ELSE led END, id, coalesce(own, id) FROM (
            SELECT n.k, n.id, w.led, list_min(list_intersect(n.l, w.led)) AS own FROM walk w JOIN n ON n.k = w.k + 1))
        SELECT node, leader FROM walk WHERE k > 0""",
    "tree_patterns": """WITH l AS (SELECT l_orderkey AS id, l_returnflag, l_linenumber, CAST(l_quantity AS BIGINT) AS q, o_orderstatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        n AS (SELECT DISTINCT id, 0 AS depth, 'anything' AS pattern, 0 AS k FROM l UNION ALL SELECT DISTINCT id, 0, 'finished', 0 FROM l WHERE s = 'F'
          UNION ALL SELECT id, 1, 'anything', 1 FROM l UNION ALL SELECT id, 2, 'anything', 2 FROM l UNION ALL SELECT id, 1, 'any_call', 0 FROM l
          UNION ALL SELECT id, 1, 'first_return', 0 FROM l WHERE l_returnflag = 'R' AND l_linenumber = 1 UNION ALL SELECT id, 2, 'seven', 0 FROM l WHERE q = 7)
        SELECT pattern, count(*) AS nodes, count(DISTINCT id) AS trees, CAST(max(depth) AS INTEGER) AS deepest FROM n GROUP BY pattern""",
}
