"""Affected tests, chunk search, fusion of four lists, scopes, smells, trackers, requests, strings and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.vectors import cosine
from ..operators import analysis as n
from ..operators import equivalence
from ..operators import graph as g
from ..operators import retrieval as r
from ..operators import similarity as s
from ..operators import store
from ..sources import adapters as a
from ..sources import code, documents
from ..sources.adapters import sql_with, table
from .graph_queries import pagerank_sql
from .retrieval_queries import _BM25, _COS


def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test functions that a change of a private function reaches, ten levels deep."""
    fns = a.functions(spark, sf_dir)
    return n.affected_tests(a.calls(spark, sf_dir), fns, fns.where("visibility = 'private'").select(F.col("fn").alias("node")))


def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen vectors nearest to vector 0, every third one a chunk of the vector before it."""
    emb = table(spark, sf_dir, "embeddings")
    probe = F.array(*[F.lit(x) for x in emb.where("vec_id = 0").select("embedding").first()[0]])  # one vector
    kind = F.when(F.col("vec_id") % 3 == 1, "chunk").otherwise("function")
    rows = emb.where("vec_id <> 0").select(F.col("vec_id").alias("id"), kind.alias("node_type"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") - 1).alias("parent"))
    return s.search(rows, probe.cast("array<double>"), 15, include_chunks=True)


def _near_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    probe = emb.where("vec_id = 0").limit(1).select(F.col("embedding").alias("probe"))
    return emb.where("vec_id <> 0").join(F.broadcast(probe)).select(F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("probe")), 6).alias("score"))


def four_list_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a vector, the public functions, the full text and the ranks of functions agree on, fused by reciprocal ranks."""
    near = _near_probe(spark, sf_dir)
    public = a.functions(spark, sf_dir).where("visibility = 'public'").select(F.col("fn").alias("id"))
    items = table(spark, sf_dir, "benchmark")
    asked = items.join(F.broadcast(items.agg(F.min("item_id").alias("item_id"))), "item_id")  # one item, before anything is scored
    text = r.bm25(table(spark, sf_dir, "documents"), asked).select("id", "score")
    pagerank = g.pagerank(a.calls(spark, sf_dir), max_iterations=10, tolerance=None).select(F.col("node").alias("id"), F.round("score", 8).alias("score"))
    lists = [near, near.join(public, "id", "left_semi"), text, pagerank]
    fused = r.reciprocal_rank_fusion([r.ranked(x.withColumn("query_id", F.lit(0)), 30) for x in lists], limit=20)
    return fused.select(F.col("rank").cast("int").alias("rank"), "id", "score")


def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best English documents of each benchmark item."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "language")
    hits = r.bm25(docs, table(spark, sf_dir, "benchmark"), scope=r.in_scope({"language": "en"}))
    return r.ranked(hits, 5).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")  # statements; commas of the first one are parameters, the most of a sentence its nesting
    count = lambda x, p: F.regexp_count(x, F.lit(p))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.size(lines).alias("statements"), F.array_max(F.transform(F.split("text", r"[.!?\n]"), lambda x: count(x, ","))).alias("nesting"),
        count(lines[0], ",").alias("parameters"), count(F.col("text"), "[;!?]").alias("cognitive"),
    )


def smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents above the limits of statements, nesting, parameters and cognitive count."""
    return n.smells(_metrics(spark, sf_dir))


def smell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells by kind, and in how many documents."""
    return n.smells(_metrics(spark, sf_dir)).groupBy("smell").agg(F.count("*").alias("n"), F.max("over").alias("worst"))


def tracker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tracked files: every seventh changed, ids above the rest deleted; lines are their entities."""
    docs = table(spark, sf_dir, "documents")
    now = docs.select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"))
    seen = docs.where("doc_id % 10 < 8").select(
        F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("old/"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(F.md5("text")).alias("hash"),
    )
    entities = docs.select(F.col("doc_id").cast("string").alias("path"), F.explode(F.split("text", "\n")))
    return store.tracker_stats(code.changed(now, seen), entities)


def functions_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``run`` and ``load`` of every module, whatever their arity."""
    fns = a.functions(spark, sf_dir)
    wanted = a.modules(spark, sf_dir).select("module", F.explode(F.array(F.lit("run"), F.lit("load"), F.lit("absent"))).alias("name"))
    return store.find_functions(fns, wanted).select("module", "name", "arity", "fn")


def coupling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten modules that depend on most, by number of dependencies."""
    return n.sorted_coupling(n.coupling(a.module_dependencies(spark, sf_dir), a.modules(spark, sf_dir)), "efferent", True, 10)


def operation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour of the day as target, with their weekdays as frameworks."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.hour("ts").alias("target"), F.dayofweek("ts").alias("framework"))
    return n.operation_counts(ev).select("operation", "target", F.size("frameworks").alias("frameworks"), "n")


def line_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as blamed lines, their suppliers as commits; every third supplier was merged by a request."""
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(
        F.to_json(F.struct(F.col("s_suppkey").cast("int").alias("number"), F.col("s_name").alias("title"), F.lit("MERGED").alias("state"), F.struct(F.col("s_suppkey").cast("string").alias("oid")).alias("mergeCommit"))).alias("value")
    )
    requests, _ = documents.pull_requests(rows, known=3)
    blame = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").cast("string").alias("sha"))
    return documents.blame_requests(blame, requests).groupBy("pr_number", "pr_title").agg(F.count("*").alias("lines"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "javascript").when(F.col("lang") == "fr", "elixir").otherwise("erlang")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), language.alias("language"), F.col("text").alias("content"))


def string_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted strings in documents, whose language stands for one of code."""
    return code.string_literals(_files(spark, sf_dir))


def comment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of documents as code: a line that begins with a capital is one, and those below each other are together."""
    commented = F.array_join(F.transform(F.split("content", "\n"), lambda x: F.regexp_replace(x, "^[A-Z]", "# ")), "\n")
    found = code.comment_blocks(_files(spark, sf_dir).withColumns({"content": commented, "language": F.lit("python")}))
    return found.select("path", "line", F.md5("content").alias("digest"))


def _event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"view": '["loop",{"loop_type":"for"}]', "signup": '["function_def",{"name":"signup"}]', "click": '["collection_op",{"op_type":"map"}]', "purchase": '["container",{"container_type":"actor"}]'}
    tree = F.lit('["other",{}]')
    for name, text in kinds.items():
        tree = F.when(F.col("event_type") == name, F.lit(text)).otherwise(tree)
    return table(spark, sf_dir, "events").select("event_type", tree.alias("tree"))


def tree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of events as syntax trees, and how many events have each."""
    return _event_trees(spark, sf_dir).select(F.explode(equivalence.features(F.col("tree"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def enriched_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as queries, with the brands of their parts as features."""
    by = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("query")).agg(F.array_sort(F.collect_set("p_brand")).alias("features"))
    return by.select("query", lx.enrich_query(F.col("query"), F.col("features"), 3).alias("enriched"))


def move_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moving each module to the area of the one it imports most would gain."""
    edges = a.imports(spark, sf_dir)
    areas = a.modules(spark, sf_dir).select(F.col("module").alias("node"), F.col("area").alias("community"))
    first = edges.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("weight")).alias("w"), "dst")).alias("dst"))
    moves = first.join(areas.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.col("community").alias("to"))
    return g.move_gain(edges, areas, moves).select("node", "to", F.round("gain", 6).alias("gain"))


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every caller of every called function, with the caller's node data."""
    fns = a.functions(spark, sf_dir).select(F.col("fn").alias("caller"), F.col("module").alias("caller_module"), F.col("name").alias("caller_name"), F.col("arity").alias("caller_arity"))
    return a.calls(spark, sf_dir).select(F.col("dst").alias("node"), F.col("src").alias("caller"), "weight").join(fns, "caller", "left")


def filtered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to vector 0 whose function is public and of Asia."""
    nodes = store.matching(a.functions(spark, sf_dir), {"visibility": "public", "area": "ASIA"})
    hits = _near_probe(spark, sf_dir).join(nodes.select(F.col("fn").alias("id"), "module", "name"), "id")
    return hits.orderBy(F.desc("score"), "id").limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        affected_tests, chunk_search, four_list_fusion, scoped_search, smells, smell_summary, tracker_stats, functions_by_name, coupling_order,
        operation_counts, line_requests, string_literals, comment_blocks, tree_features, enriched_queries, move_gains, callers, filtered_hits,
    )
}

_SMELLS = r"""m AS (SELECT doc_id AS path, len(string_split(text, chr(10))) AS statements, list_max(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: len(regexp_extract_all(x, ',')))) AS nesting,
        len(regexp_extract_all(string_split(text, chr(10))[1], ',')) AS parameters, len(regexp_extract_all(text, '[;!?]')) AS cognitive FROM documents),
    smells AS (""" + " UNION ALL ".join(
    f"SELECT path, '{k}' AS smell, CAST({k} AS BIGINT) AS value, CAST({k} - {v} AS BIGINT) AS over FROM m WHERE {k} > {v}" for k, v in n.SMELL_LIMITS.items()
) + ")"
_TEST = "(module LIKE '%Test' OR module LIKE '%.Test.%' OR starts_with(name, 'test_') OR contains(name, 'Test') OR contains(name, '_test'))"

ORACLE = {
    "affected_tests": sql_with("calls", "functions", recursive=True)
    + f""", r AS (SELECT fn AS target, fn AS node, 0 AS level FROM functions WHERE visibility = 'private' UNION
            SELECT r.target, c.src, r.level + 1 FROM r JOIN calls c ON r.node = c.dst WHERE r.level < 9)
          SELECT target, node AS fn, CAST(min(level) AS INTEGER) AS level FROM r JOIN functions f ON f.fn = node WHERE {_TEST} GROUP BY target, node""",
    "chunk_search": f"""WITH q AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0),
        t AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 1 THEN 'chunk' ELSE 'function' END AS node_type, CASE WHEN vec_id % 3 = 1 THEN vec_id - 1 END AS chunk_parent,
          {_COS.format(a='embedding', b='probe')} AS score FROM embeddings, q WHERE vec_id <> 0)
        SELECT * FROM t ORDER BY score DESC, id LIMIT 15""",
    "four_list_fusion": sql_with("calls", "functions") + ", " + pagerank_sql("calls", 10) + f""", {_BM25},
        probe AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0),
        near AS (SELECT vec_id AS id, {_COS.format(a='embedding', b='probe')} AS score FROM embeddings, probe WHERE vec_id <> 0),
        every AS (SELECT 1 AS list, id, score FROM near UNION ALL SELECT 2, id, score FROM near WHERE id IN (SELECT fn FROM functions WHERE visibility = 'public')
          UNION ALL SELECT 3, id, score FROM bm25 WHERE query_id = (SELECT min(item_id) FROM benchmark) UNION ALL SELECT 4, node, round(score, 8) FROM p10),
        placed AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) AS place FROM every),
        fused AS (SELECT id, round(sum(1.0::DOUBLE / (place - 1 + 60)), 6) AS score FROM placed WHERE place <= 30 GROUP BY id)
        SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM fused) WHERE rank <= 20""",
    "scoped_search": f"""WITH {_BM25}, inside AS (SELECT * FROM bm25 WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en'))
        SELECT query_id, rank, id, score FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM inside) WHERE rank <= 5""",
    "callers": sql_with("calls", "functions")
    + " SELECT c.dst AS node, c.src AS caller, c.weight, f.module AS caller_module, f.name AS caller_name, f.arity AS caller_arity FROM calls c LEFT JOIN functions f ON f.fn = c.src",
    "filtered_hits": sql_with("functions") + f""", q AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0)
        SELECT vec_id AS id, {_COS.format(a='embedding', b='probe')} AS score, module, name FROM embeddings JOIN functions ON fn = vec_id, q
        WHERE vec_id <> 0 AND visibility = 'public' AND area = 'ASIA' ORDER BY score DESC, id LIMIT 10""",
    "smells": f"WITH {_SMELLS} SELECT path, smell, value, over FROM smells",
    "smell_summary": f"WITH {_SMELLS} SELECT smell, count(*) AS n, max(over) AS worst FROM smells GROUP BY smell",
    "tracker_stats": """WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS hash, len(string_split(text, chr(10))) AS lines FROM documents),
        t AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'old/' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS path, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE md5(text) END AS hash FROM documents WHERE doc_id % 10 < 8),
        s AS (SELECT t.path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN n.hash = t.hash THEN 'unchanged' ELSE 'changed' END AS status, coalesce(lines, 0) AS lines FROM t LEFT JOIN n USING (path))
        SELECT count(*) AS total_files, count(*) FILTER (status = 'changed') AS changed_files, count(*) FILTER (status = 'unchanged') AS unchanged_files, count(*) FILTER (status = 'deleted') AS deleted_files,
          CAST(sum(lines) AS BIGINT) AS total_entities, CAST(coalesce(sum(lines) FILTER (status <> 'unchanged'), 0) AS BIGINT) AS stale_entities FROM s""",
    "functions_by_name": sql_with("functions")
    + """ SELECT module, name, arity, fn FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY arity, fn) AS k FROM functions WHERE name IN ('run', 'load', 'absent')) WHERE k = 1""",
    "coupling_order": sql_with("module_dependencies", "modules")
    + """, e AS (SELECT DISTINCT src, dst FROM module_dependencies),
          c AS (SELECT module, (SELECT count(*) FROM e WHERE dst = module) AS afferent, (SELECT count(*) FROM e WHERE src = module) AS efferent FROM (SELECT DISTINCT module FROM modules))
          SELECT module, CAST(afferent AS BIGINT) AS afferent, CAST(efferent AS BIGINT) AS efferent, CASE WHEN afferent + efferent > 0 THEN round(efferent / (afferent + efferent)::DOUBLE, 4) ELSE 0.0::DOUBLE END AS instability
          FROM c ORDER BY efferent DESC, module DESC LIMIT 10""",
    "operation_counts": """SELECT event_type AS operation, CAST(hour(ts) AS INTEGER) AS target, CAST(count(DISTINCT dayofweek(ts)) AS INTEGER) AS frameworks, count(*) AS n FROM events GROUP BY 1, 2""",
    "tree_features": """SELECT feature, count(*) AS n FROM (SELECT unnest(CASE event_type WHEN 'view' THEN ['loop', 'iteration', 'repeat', 'for', 'iterate'] WHEN 'signup' THEN ['function', 'definition', 'def', 'signup']
        WHEN 'click' THEN ['collection', 'iteration', 'transform', 'map', 'transform', 'apply'] WHEN 'purchase' THEN ['container', 'unknown', 'actor', 'genserver', 'process'] ELSE ['code', 'construct'] END) AS feature FROM events) GROUP BY feature""",
    "enriched_queries": """WITH f AS (SELECT p_type AS query, list_sort(list(DISTINCT p_brand)) AS b FROM part GROUP BY 1)
        SELECT query, query || ' ' || array_to_string(list_filter(b, lambda x: NOT contains(lower(query), lower(x)))[1:3], ' ') AS enriched FROM f""",
    "move_gains": sql_with("imports")
    + """, near AS (SELECT src AS node, dst AS near, weight FROM imports WHERE src <> dst UNION ALL SELECT dst, src, weight FROM imports WHERE src <> dst),
          pull AS (SELECT node, area, sum(weight) AS w FROM near JOIN modules ON near = module GROUP BY 1, 2),
          f AS (SELECT src AS node, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM imports) WHERE k = 1)
          SELECT f.node, t.area AS to, round((coalesce(p.w, 0) - coalesce(o.w, 0)) / (SELECT sum(weight) FROM imports), 6) AS gain
          FROM f JOIN modules t ON f.dst = t.module JOIN modules m ON f.node = m.module LEFT JOIN pull p ON p.node = f.node AND p.area = t.area LEFT JOIN pull o ON o.node = f.node AND o.area = m.area""",
    "string_literals": "WITH l AS (SELECT doc_id AS path, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), "
    + "s AS (SELECT path, line, unnest(CASE lang "
    + " ".join(f"WHEN '{k}' THEN regexp_extract_all(text, '{code.STRINGS[v].replace(chr(39), chr(39) * 2)}')" for k, v in (("en", "python"), ("de", "javascript"), ("fr", "elixir")))
    + f" ELSE regexp_extract_all(text, '{code.STRINGS['erlang']}') END) AS content FROM l)"
    + """ SELECT path, CAST(line AS INTEGER) AS line, c AS content FROM (SELECT path, line, regexp_replace(content, '^[\"''`]+|[\"''`]+$', '', 'g') AS c FROM s) WHERE length(c) >= 3""",
    "comment_blocks": r"""WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        c AS (SELECT path, line, trim(regexp_extract(regexp_replace(text, '^[A-Z]', '# '), '^\s*#\s*(.*)$', 1)) AS content FROM l),
        b AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS block FROM c WHERE content <> '')
        SELECT path, CAST(max(line) AS INTEGER) AS line, md5(string_agg(content, ' ' ORDER BY line)) AS digest FROM b GROUP BY path, block""",
    "line_requests": """SELECT CAST(s.s_suppkey AS INTEGER) AS pr_number, s.s_name AS pr_title, count(*) AS lines FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey > 3) s ON l_suppkey = s.s_suppkey GROUP BY 1, 2""",
}
