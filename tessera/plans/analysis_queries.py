"""Code analytics queries: coupling, dead code, impact, cohesion, quality, findings, suggestions, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import strings
from ..operators import analysis as n
from ..operators import graph as g
from ..operators import store
from ..sources import adapters as a
from ..sources.adapters import sql_with, table
from .graph_queries import pagerank_sql


def _coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.coupling(a.module_dependencies(spark, sf_dir), a.modules(spark, sf_dir))


def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies in both directions and instability of every module."""
    return _coupling(spark, sf_dir)


def god_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with 15 dependencies or more."""
    return n.god_modules(_coupling(spark, sf_dir), 15)


def unused_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that no module imports, tests and tasks left out."""
    return n.unused_modules(a.modules(spark, sf_dir), a.imports(spark, sf_dir).select(F.col("dst").alias("module")))


def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without callers that are likely dead."""
    return n.dead_functions(a.functions(spark, sf_dir), a.calls(spark, sf_dir), 0.0, 0.0)


def removal_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to remove or review, a row a module."""
    return n.removal_suggestions(n.dead_functions(a.functions(spark, sf_dir), a.calls(spark, sf_dir)))


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of changing each function."""
    return n.risk_scores(a.functions(spark, sf_dir).select(F.col("fn").alias("node")), a.calls(spark, sf_dir))


def refactoring_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that each refactoring of each function takes."""
    return n.refactoring_effort(a.functions(spark, sf_dir).select(F.col("fn").alias("node")), a.calls(spark, sf_dir))


def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohesion of every module from the calls inside it."""
    return n.cohesion(a.functions(spark, sf_dir), a.calls(spark, sf_dir), a.modules(spark, sf_dir))


def decoupling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import cycles of up to four modules, god modules, unstable and unused modules."""
    cycles = g.simple_cycles(a.imports(spark, sf_dir), max_length=4)
    return n.decoupling_suggestions(cycles, _coupling(spark, sf_dir), unused_modules(spark, sf_dir))


def module_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each module imports and what imports it, as sorted lists."""
    e = g.distinct_edges(a.module_dependencies(spark, sf_dir))
    out = e.groupBy(F.col("src").alias("module")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("depends_on"))
    into = e.groupBy(F.col("dst").alias("module")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("used_by"))
    mods = a.modules(spark, sf_dir).select("module")
    return mods.join(out, "module", "left").join(into, "module", "left").select("module", F.coalesce("depends_on", F.lit("")).alias("depends_on"), F.coalesce("used_by", F.lit("")).alias("used_by"))


def function_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node data and numbers of callers and callees for every function that is called."""
    calls = a.calls(spark, sf_dir)
    called = calls.select(F.col("dst").alias("node")).distinct()
    return store.enriched(called, a.functions(spark, sf_dir).withColumnRenamed("fn", "node"), calls)


def external_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to private functions from other modules: what making them private would break."""
    fns = a.functions(spark, sf_dir)
    return (
        a.calls(spark, sf_dir).select("src", "dst")
        .join(fns.where("visibility = 'private'").select(F.col("fn").alias("dst"), F.col("module").alias("module")), "dst")
        .join(fns.select(F.col("fn").alias("src"), F.col("module").alias("caller_module")), "src")
        .where("module <> caller_module")
    )


def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that share module, name and arity."""
    keys = ["module", "name", "arity"]
    return a.functions(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"), F.min("fn").alias("first")).where("n > 1")


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module names of the same area at most four edits apart."""
    m = a.modules(spark, sf_dir)
    other = m.select("area", F.col("module").alias("other"))
    return m.join(other, "area").where("module < other").select("module", "other", F.levenshtein("module", "other").alias("edits")).where("edits <= 4")


def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of the modules around each module: rank of its importers summed, and their mean degree."""
    e = a.imports(spark, sf_dir)
    rank = g.pagerank(e, max_iterations=10, tolerance=None)
    degree = g.degree_centrality(e).select("node", "total_degree")
    core = g.affected(e, a.modules(spark, sf_dir).select(F.col("module").alias("node")), depth=2)
    joined = core.join(rank, "node").join(degree, "node")
    risk = F.least(F.lit(1.0), (100 * F.sum("score") + F.avg("total_degree")) / 100)
    return joined.groupBy("target").agg(F.count("*").alias("n"), F.round(risk, 6).alias("risk"))


def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together: how many orders hold both."""
    return n.co_changes(_baskets(spark, sf_dir))


def cochange_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's three most frequent partners, two orders at least."""
    return n.co_change_partners(n.co_changes(_baskets(spark, sf_dir)))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each document as a file: own definitions, counted from its text."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    warnings = F.filter(
        F.array(F.when(F.col("n_chars") > 10000, F.lit("long")), F.when(F.contains("text", F.lit("|")), F.lit("table"))), lambda w: w.isNotNull()
    )
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("language"),
        (F.regexp_count("text", F.lit(r"[.]")) + 1).alias("cyclomatic"),
        F.regexp_count("text", F.lit(",")).alias("cognitive"),
        F.regexp_count("text", F.lit("\n")).alias("max_nesting"),
        words.cast("long").alias("loc"),
        warnings.alias("warnings"),
        (~F.col("text").rlike("[0-9]")).alias("pure"),
    )


def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics over all documents, with the score."""
    return n.quality_score(n.quality_stats(quality_rows(spark, sf_dir)))


def quality_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics by language, with the score."""
    return n.quality_score(n.quality_stats(quality_rows(spark, sf_dir), "language"))


def complex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a cyclomatic count above 30 or with warnings that are not pure."""
    rows = quality_rows(spark, sf_dir)
    found = n.by_threshold(rows, "cyclomatic", 30, "gt").unionByName(rows.where((F.size("warnings") > 0) & ~F.col("pure")))
    return found.select("path", "cyclomatic", F.array_join("warnings", ",").alias("warnings"), "pure").distinct()


def most_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of highest cognitive count."""
    return quality_rows(spark, sf_dir).select("path", "cognitive").orderBy(F.desc("cognitive"), "path").limit(10)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: the type decides severity and category, the user is the file."""
    t = F.col("event_type")
    severity = F.when(t == "error", "critical").when(t == "purchase", "high").when(t == "click", "medium").when(t == "view", "low").otherwise("info")
    category = F.when(t.isin("error", "signup"), "security").otherwise("usage")
    return table(spark, sf_dir, "events").select(severity.alias("severity"), t.alias("kind"), category.alias("category"), F.col("user_id").alias("file"), "value")


def findings_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and files by severity, by kind, by category and over all."""
    return n.finding_counts(findings(spark, sf_dir))


def worst_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest severity of each category."""
    return n.worst_severity(findings(spark, sf_dir))


def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status that the findings add up to."""
    return n.audit_status(findings(spark, sf_dir))


def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of medium severity or higher, by file."""
    return n.at_least(findings(spark, sf_dir), "medium").groupBy("file").agg(F.count("*").alias("n"))


def semantic_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations by domain, all seven domains; an event's type says its domain."""
    t = F.col("event_type")
    domain = F.when(t == "signup", "auth").when(t == "view", "cache").when(t == "purchase", "db").when(t == "click", "http")
    return n.domain_counts(table(spark, sf_dir, "events").select(domain.alias("domain")).where("domain IS NOT NULL"))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rows(spark, sf_dir)
    rules = F.filter(
        F.array(
            F.when(F.col("cyclomatic") > 15, F.lit("simplify_complexity")),
            F.when(F.col("loc") > 500, F.lit("split_module")),
            F.when(F.col("max_nesting") > 5, F.lit("reduce_nesting")),
            F.when(F.col("cognitive") == 0, F.lit("remove_dead_code")),
        ),
        lambda r: r.isNotNull(),
    )
    risks = strings(("low", "medium", "high", "critical"))
    return rows.select(
        "path",
        F.explode(rules).alias("pattern"),
        F.least(F.col("cyclomatic") / 40.0, F.lit(1.0)).alias("benefit"),
        F.least(F.col("cognitive") / 60.0, F.lit(1.0)).alias("confidence"),
        F.least(F.col("loc") / 2000.0, F.lit(1.0)).alias("effort"),
        (F.col("max_nesting") + 1).alias("affected_files"),
        F.element_at(risks, F.least(F.floor(F.col("max_nesting") / 10), F.lit(3)).cast("int") + 1).alias("risk"),
    )


def suggestion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refactoring suggestions with priority and return."""
    return n.ranked_suggestions(_suggestions(spark, sf_dir)).select("path", "pattern", "priority_score", "priority", "roi")


def suggestion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions by priority."""
    return n.suggestion_stats(n.ranked_suggestions(_suggestions(spark, sf_dir)))


def state_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events take three states or more, as candidates for a state machine."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("states"), F.count_distinct("event_type").alias("n"))
    return by.where("n >= 3")


def stale_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash is not the one stored with their label: new without a label, changed where quality is 0."""
    current = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    known = current.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("hash")).otherwise(F.sha2(F.lit(""), 256)).alias("hash"))
    return store.stale(current, known, "doc_id")


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer: an upsert by customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return store.upsert(rows, ["o_custkey"], "o_orderkey")


def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between segments and part types before and after 1996: added, removed, unchanged."""
    rows = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
        .join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    )
    middle = F.lit("1996-01-01").cast("timestamp_ntz")
    return store.diff(rows.where(F.col("o_orderdate") < middle), rows.where(F.col("o_orderdate") >= middle), ["c_mktsegment", "l_suppkey"]).groupBy("change").count().withColumnRenamed("count", "n")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of functions, calls and vectors once private functions are removed."""
    fns = a.functions(spark, sf_dir).withColumnRenamed("fn", "node")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"))
    gone = fns.where("visibility = 'private'").select("node")
    left = store.remove_nodes(fns, a.calls(spark, sf_dir), emb, gone)
    counts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in zip(("nodes", "edges", "embeddings"), left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


QUERIES = {
    f.__name__: f
    for f in (
        coupling, god_modules, unused_modules, dead_code, removal_suggestions, risk_score, refactoring_effort, cohesion, decoupling_suggestions,
        module_profile, function_context, external_callers, name_conflicts, similar_names, impact_risk, cochange_pairs, cochange_partners,
        quality_stats, quality_by_language, complex_files, most_complex, findings_grouping_sets, worst_by_category, audit_status, severity_filter,
        semantic_operations, suggestion_rank, suggestion_stats, state_machines, stale_entities, upsert_orders, edge_diff, cascade_delete,
    )
}

_COUPLING = """, deg AS (SELECT module, CAST(coalesce(i.n, 0) AS BIGINT) AS afferent, CAST(coalesce(o.n, 0) AS BIGINT) AS efferent FROM modules
        LEFT JOIN (SELECT dst, count(*) AS n FROM module_dependencies GROUP BY dst) i ON i.dst = module
        LEFT JOIN (SELECT src, count(*) AS n FROM module_dependencies GROUP BY src) o ON o.src = module),
      metrics AS (SELECT *, CASE WHEN afferent + efferent > 0 THEN round(efferent / (afferent + efferent)::DOUBLE, 4) ELSE 0 END AS instability FROM deg)"""
_UNUSED = "SELECT module FROM modules WHERE module NOT IN (SELECT dst FROM imports) AND NOT suffix(module, 'Test') AND NOT contains(module, '.Test.') AND NOT prefix(module, 'Mix.Tasks.')"
_DEAD = f"""scored AS (SELECT *, round(greatest(0, least(1, 1.0::DOUBLE - CASE WHEN visibility = 'public' THEN 0.2::DOUBLE ELSE 0 END
          - CASE WHEN list_contains([{", ".join(f"'{c}'" for c in n.CALLBACKS)}], name || '/' || arity) THEN 0.7::DOUBLE ELSE 0 END
          - CASE WHEN regexp_matches(name, '{n.ENTRY_POINTS}') THEN 0.5::DOUBLE ELSE 0 END
          - CASE WHEN suffix(module, 'Test') OR contains(module, '.Test.') THEN 0.3::DOUBLE WHEN prefix(module, 'Mix.Tasks.') THEN 0.4::DOUBLE ELSE 0 END)), 4) AS confidence
        FROM functions WHERE fn NOT IN (SELECT dst FROM calls)),
      dead AS (SELECT fn, module, name, arity, visibility, confidence, CASE WHEN confidence > 0.8 THEN 'never_called'
          WHEN confidence > 0.5 THEN 'never_called_may_start_outside' ELSE 'likely_called_from_outside' END AS reason FROM scored)"""
_DEGREES = """(SELECT dst, count(*) AS n FROM calls GROUP BY dst) i ON i.dst = fn"""
_QUALITY = r"""q AS (SELECT source || '/' || doc_id AS path, lang AS language, CAST(len(regexp_extract_all(text, '[.]')) + 1 AS INTEGER) AS cyclomatic,
        CAST(len(regexp_extract_all(text, ',')) AS INTEGER) AS cognitive, CAST(len(regexp_extract_all(text, chr(10))) AS INTEGER) AS max_nesting,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS loc,
        list_filter([CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda w: w IS NOT NULL) AS warnings,
        NOT regexp_matches(text, '[0-9]') AS pure FROM documents)"""
_STATS = "count(*) AS files, " + ", ".join(
    f"CAST(round(CAST(avg({m}) AS DECIMAL(18, 8)), 2) AS DOUBLE) AS avg_{m}, min({m}) AS min_{m}, max({m}) AS max_{m}" for m in ("cyclomatic", "cognitive", "max_nesting")
) + ", count(*) FILTER (len(warnings) > 0) AS with_warnings, count(*) FILTER (NOT pure) AS impure"
_SCORE = """CAST(greatest(0, least(100, round(greatest(0, 100 - 5 * avg_cyclomatic) - least(20.0, greatest(0, 2.0 * (max_cyclomatic - 15)))
        - least(15.0, greatest(0, avg_cognitive - 10))))) AS INTEGER) AS score"""
_FINDINGS = """f AS (SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
        event_type AS kind, CASE WHEN event_type IN ('error', 'signup') THEN 'security' ELSE 'usage' END AS category, user_id AS file FROM events)"""
_UNIT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"
_SUGGEST = f"""WITH {_QUALITY}, s AS (SELECT path, cyclomatic, cognitive, loc, max_nesting, unnest(list_filter([CASE WHEN cyclomatic > 15 THEN 'simplify_complexity' END,
          CASE WHEN loc > 500 THEN 'split_module' END, CASE WHEN max_nesting > 5 THEN 'reduce_nesting' END, CASE WHEN cognitive = 0 THEN 'remove_dead_code' END], lambda r: r IS NOT NULL)) AS pattern FROM q),
      v AS (SELECT path, pattern, least(cyclomatic / 40.0::DOUBLE, 1) AS benefit, least(cognitive / 60.0::DOUBLE, 1) AS confidence, least(loc / 2000.0::DOUBLE, 1) AS effort,
          round(least(ln(max_nesting + 2.0::DOUBLE) / ln(11.0::DOUBLE), 1), 2) AS impact, CASE least(max_nesting // 10, 3) WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 1 END AS risk FROM s),
      b AS (SELECT *, round({_UNIT.format('benefit * 0.4::DOUBLE + impact * 0.2::DOUBLE - risk * 0.2::DOUBLE - effort * 0.1::DOUBLE + confidence * 0.1::DOUBLE')}, 2) AS base FROM v),
      c AS (SELECT *, round({_UNIT.format("base + CASE pattern WHEN 'remove_dead_code' THEN 0.1::DOUBLE WHEN 'simplify_complexity' THEN 0.05::DOUBLE WHEN 'split_module' THEN -0.05::DOUBLE ELSE 0 END")}, 2) AS priority_score FROM b),
      r AS (SELECT path, pattern, priority_score, CASE WHEN priority_score > 0.8 THEN 'critical' WHEN priority_score > 0.6 THEN 'high' WHEN priority_score > 0.4 THEN 'medium' WHEN priority_score > 0.2 THEN 'low' ELSE 'info' END AS priority,
          round(benefit / greatest(effort, 0.1::DOUBLE), 2) AS roi FROM c)"""
_BASKETS = """files AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem),
      fit AS (SELECT c FROM files GROUP BY c HAVING count(*) BETWEEN 2 AND 50),
      pairs AS (SELECT x.f AS a, y.f AS b, count(*) AS n FROM files x JOIN files y ON x.c = y.c AND x.f < y.f WHERE x.c IN (SELECT c FROM fit) GROUP BY 1, 2)"""

ORACLE = {
    "coupling": sql_with("module_dependencies") + _COUPLING + " SELECT * FROM metrics",
    "god_modules": sql_with("module_dependencies") + _COUPLING + " SELECT *, afferent + efferent AS total FROM metrics WHERE afferent + efferent >= 15",
    "unused_modules": sql_with("imports") + " " + _UNUSED,
    "dead_code": sql_with("functions", "calls") + ", " + _DEAD + " SELECT * FROM dead",
    "removal_suggestions": sql_with("functions", "calls") + ", " + _DEAD
    + """, g AS (SELECT module, count(*) AS n, CAST(round(CAST(avg(confidence) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS confidence, count(*) FILTER (confidence > 0.8) AS high,
          count(*) FILTER (confidence > 0.5 AND confidence <= 0.8) AS medium, count(*) FILTER (confidence <= 0.5) AS low FROM dead
          WHERE confidence >= CASE WHEN visibility = 'private' THEN 0.7 ELSE 0.5 END GROUP BY module)
        SELECT module, CASE WHEN n > 1 THEN 'review_function' WHEN high > 0 THEN 'remove_function' WHEN medium > 0 THEN 'review_function' ELSE 'potential_callback' END AS kind,
          confidence, n, high, medium, low FROM g""",
    "risk_score": sql_with("functions", "calls")
    + f""", d AS (SELECT fn AS node, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM functions LEFT JOIN {_DEGREES}
          LEFT JOIN (SELECT src, count(*) AS n FROM calls GROUP BY src) o ON o.src = fn),
        s AS (SELECT node, least(callers / 100.0::DOUBLE, 1) AS importance, least((callers + callees) / 50.0::DOUBLE, 1) AS coupling FROM d),
        t AS (SELECT *, round((importance + coupling + 0.5::DOUBLE) / 3, 6) AS overall FROM s)
        SELECT *, CASE WHEN overall >= 0.8 THEN 'critical' WHEN overall >= 0.6 THEN 'high' WHEN overall >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM t""",
    "refactoring_effort": sql_with("functions", "calls")
    + f""", d AS (SELECT fn AS node, coalesce(i.n, 0) AS n FROM functions LEFT JOIN {_DEGREES}),
        o AS (SELECT node, 'rename_function' AS operation, n + 1 AS changes FROM d UNION ALL SELECT node, 'rename_module', n * 3 FROM d UNION ALL SELECT node, 'extract_function', greatest(n, 5) FROM d
          UNION ALL SELECT node, 'inline_function', n FROM d UNION ALL SELECT node, 'move_function', n + 5 FROM d UNION ALL SELECT node, 'change_signature', n FROM d)
        SELECT *, CASE WHEN changes < 5 THEN 'low' WHEN changes < 20 THEN 'medium' WHEN changes < 50 THEN 'high' ELSE 'very_high' END AS effort FROM o""",
    "cohesion": sql_with("functions", "calls", recursive=True)
    + """, inner_calls AS (SELECT src, dst FROM calls JOIN functions a ON src = a.fn JOIN functions b ON dst = b.fn WHERE a.module = b.module),
        near AS (SELECT src AS a, dst AS b FROM inner_calls UNION SELECT dst, src FROM inner_calls),
        r AS (SELECT fn AS node, fn AS other FROM functions UNION SELECT r.node, near.b FROM r JOIN near ON r.other = near.a),
        c AS (SELECT node, min(other) AS component FROM r GROUP BY node),
        s AS (SELECT module, component, count(*) AS s FROM functions JOIN c ON fn = node GROUP BY 1, 2),
        m AS (SELECT module, sum(s) AS n, count(*) AS c, sum(s * (s - 1) / 2.0::DOUBLE) AS linked FROM s GROUP BY 1),
        x AS (SELECT modules.module, coalesce(n, 0) AS n, coalesce(c, 0) AS c, CASE WHEN n IS NULL THEN 1 ELSE 1.0::DOUBLE / c END AS fci,
          CASE WHEN coalesce(n, 0) <= 1 THEN 1 ELSE linked / (n * (n - 1) / 2.0::DOUBLE) END AS tcc FROM modules LEFT JOIN m USING (module))
        SELECT module, CAST(n AS BIGINT) AS functions, CAST(c AS BIGINT) AS components, round(fci, 6) AS fci, round(tcc, 6) AS tcc, round((fci + tcc) / 2, 6) AS score FROM x""",
    "decoupling_suggestions": sql_with("module_dependencies", recursive=True) + _COUPLING
    + f""", e AS (SELECT src, dst FROM imports WHERE src <> dst),
        p AS (SELECT src, dst, [src, dst] AS path FROM e WHERE dst > src UNION ALL
          SELECT p.src, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.dst = e.src WHERE len(p.path) < 4 AND e.dst > p.src AND NOT list_contains(p.path, e.dst))
        SELECT 'circular_dependency' AS kind, CASE WHEN len(path) >= 5 THEN 'high' WHEN len(path) >= 3 THEN 'medium' ELSE 'low' END AS severity, array_to_string(path, '>') AS entity
          FROM p JOIN e ON p.dst = e.src AND e.dst = p.src
        UNION ALL SELECT 'god_module', CASE WHEN afferent + efferent >= 30 THEN 'high' WHEN afferent + efferent >= 20 THEN 'medium' ELSE 'low' END, module FROM metrics WHERE afferent + efferent >= 15
        UNION ALL SELECT 'unstable_module', 'medium', module FROM metrics WHERE instability > 0.8
        UNION ALL SELECT 'unused_module', 'low', module FROM ({_UNUSED})""",
    "module_profile": sql_with("module_dependencies")
    + """ SELECT module, coalesce(o.l, '') AS depends_on, coalesce(i.l, '') AS used_by FROM modules
          LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS l FROM module_dependencies GROUP BY src) o ON o.src = module
          LEFT JOIN (SELECT dst, string_agg(src, ',' ORDER BY src) AS l FROM module_dependencies GROUP BY dst) i ON i.dst = module""",
    "function_context": sql_with("functions", "calls")
    + f""" SELECT fn AS node, module, area, name, arity, visibility, i.n AS callers, coalesce(o.n, 0) AS callees FROM functions JOIN {_DEGREES}
          LEFT JOIN (SELECT src, count(*) AS n FROM calls GROUP BY src) o ON o.src = fn""",
    "external_callers": sql_with("functions", "calls")
    + " SELECT src, dst, b.module, a.module AS caller_module FROM calls JOIN functions a ON src = a.fn JOIN functions b ON dst = b.fn WHERE b.visibility = 'private' AND a.module <> b.module",
    "name_conflicts": sql_with("functions") + " SELECT module, name, arity, count(*) AS n, min(fn) AS first FROM functions GROUP BY ALL HAVING count(*) > 1",
    "similar_names": sql_with("modules")
    + " SELECT a.module, b.module AS other, CAST(levenshtein(a.module, b.module) AS INTEGER) AS edits FROM modules a JOIN modules b ON a.area = b.area AND a.module < b.module WHERE levenshtein(a.module, b.module) <= 4",
    "impact_risk": sql_with("imports") + ", " + pagerank_sql("imports", 10)
    + """, d AS (SELECT node, sum(c) AS degree FROM (SELECT src AS node, count(*) AS c FROM e GROUP BY 1 UNION ALL SELECT dst, count(*) FROM e GROUP BY 1) GROUP BY node),
        core AS (SELECT module AS target, module AS node FROM modules UNION SELECT dst, src FROM e)
        SELECT target, count(*) AS n, round(least(1.0, (100 * sum(score) + avg(degree)) / 100), 6) AS risk FROM core JOIN p10 USING (node) JOIN d USING (node) GROUP BY target""",
    "cochange_pairs": f"WITH {_BASKETS} SELECT * FROM pairs",
    "cochange_partners": f"""WITH {_BASKETS}, both_ways AS (SELECT a AS file, b AS partner, n FROM pairs UNION ALL SELECT b, a, n FROM pairs)
        SELECT file, partner, n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, partner) AS p FROM both_ways WHERE n >= 2) WHERE p <= 3""",
    "quality_stats": f"WITH {_QUALITY}, s AS (SELECT {_STATS} FROM q) SELECT *, {_SCORE} FROM s",
    "quality_by_language": f"WITH {_QUALITY}, s AS (SELECT language, {_STATS} FROM q GROUP BY language) SELECT *, {_SCORE} FROM s",
    "complex_files": f"WITH {_QUALITY} SELECT path, cyclomatic, array_to_string(warnings, ',') AS warnings, pure FROM q WHERE cyclomatic > 30 OR (len(warnings) > 0 AND NOT pure)",
    "most_complex": f"WITH {_QUALITY} SELECT path, cognitive FROM q ORDER BY cognitive DESC, path LIMIT 10",
    "findings_grouping_sets": f"WITH {_FINDINGS} SELECT severity, kind, category, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY GROUPING SETS ((severity), (kind), (category), ())",
    "worst_by_category": f"WITH {_FINDINGS} SELECT category, arg_max(severity, list_position(['info', 'low', 'medium', 'high', 'critical'], severity)) AS worst, count(*) AS n FROM f GROUP BY category",
    "audit_status": f"""WITH {_FINDINGS}, c AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM f)
        SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'at_risk' WHEN medium > 0 THEN 'needs_attention' ELSE 'good' END AS status FROM c""",
    "severity_filter": f"WITH {_FINDINGS} SELECT file, count(*) AS n FROM f WHERE severity IN ('medium', 'high', 'critical') GROUP BY file",
    "semantic_operations": """WITH o AS (SELECT CASE event_type WHEN 'signup' THEN 'auth' WHEN 'view' THEN 'cache' WHEN 'purchase' THEN 'db' WHEN 'click' THEN 'http' END AS domain FROM events)
        SELECT d.domain, count(o.domain) AS n FROM (SELECT unnest(['auth', 'cache', 'db', 'external_api', 'file', 'http', 'queue']) AS domain) d LEFT JOIN o USING (domain) GROUP BY d.domain""",
    "suggestion_rank": _SUGGEST + " SELECT * FROM r",
    "suggestion_stats": _SUGGEST + " SELECT priority, count(*) AS n, CAST(round(CAST(avg(priority_score) AS DECIMAL(18, 8)), 3) AS DOUBLE) AS avg_score, CAST(round(CAST(avg(roi) AS DECIMAL(18, 8)), 3) AS DOUBLE) AS avg_roi FROM r GROUP BY priority",
    "state_machines": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS states, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3",
    "stale_entities": "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'changed' END AS status FROM documents LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality <> 1",
    "upsert_orders": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "edge_diff": """WITH r AS (SELECT DISTINCT c_mktsegment, l_suppkey, o_orderdate < TIMESTAMP '1996-01-01' AS old FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey),
        s AS (SELECT c_mktsegment, l_suppkey, CASE WHEN count(*) = 2 THEN 'unchanged' WHEN bool_and(old) THEN 'removed' ELSE 'added' END AS change FROM r GROUP BY 1, 2)
        SELECT change, count(*) AS n FROM s GROUP BY change""",
    "cascade_delete": sql_with("functions", "calls")
    + """, gone AS (SELECT fn FROM functions WHERE visibility = 'private')
        SELECT 'nodes' AS part, count(*) AS n FROM functions WHERE fn NOT IN (SELECT fn FROM gone) UNION ALL
        SELECT 'edges', count(*) FROM calls WHERE src NOT IN (SELECT fn FROM gone) AND dst NOT IN (SELECT fn FROM gone) UNION ALL
        SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT fn FROM gone)""",
}
