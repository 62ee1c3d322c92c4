"""Names, contexts, compaction and equivalents across languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import equivalence
from ..sources import adapters as a
from ..sources.adapters import sql_with, table


def jaro_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of the same brand and size with a Jaro similarity above 0.8; two names are compared once, however many parts have them."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_name").where("p_name IS NOT NULL")
    names = parts.select("p_brand", "p_size", "p_name").distinct()
    pairs = names.join(names.withColumnRenamed("p_name", "other_name"), ["p_brand", "p_size"])
    scored = pairs.select("p_name", "other_name").distinct().withColumn("score", F.round(x.jaro("p_name", "other_name"), 6))
    near = pairs.join(scored.where("score > 0.8"), ["p_name", "other_name"])
    other = parts.withColumnsRenamed({"p_partkey": "other", "p_name": "other_name"})
    met = parts.join(near, ["p_brand", "p_size", "p_name"]).join(other, ["p_brand", "p_size", "other_name"])
    return met.where("p_partkey < other").select("p_partkey", "other", "score")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.split("text", "\n"), lambda line: F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).cast("string"))
    tree = F.to_json(F.concat(F.array(F.lit("text"), F.lit("meta")), words))  # a leaf a line: its words
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), tree.alias("tree"))


def cross_language_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same shape in two languages, counted by language pair."""
    found = equivalence.equivalents(_trees(spark, sf_dir).groupBy("language", "tree").agg(F.min("id").alias("id")))
    return found.groupBy("language", "other_language").agg(F.count("*").alias("n"))


def equivalence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of one shape, with their languages."""
    out = equivalence.groups(_trees(spark, sf_dir))
    return out.select("first", "n", F.array_join("languages", ",").alias("languages"))


def recent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events of users that changed something on the last day: findings in the changed set only."""
    ev = table(spark, sf_dir, "events")
    last = ev.agg(F.max("ts").alias("now"))
    changed = ev.join(F.broadcast(last)).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 DAY")).select("user_id").distinct()
    return ev.where("event_type = 'error'").join(changed, "user_id", "left_semi").select("event_id", "user_id")


def compact_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two callers of each called function, and how many more there are."""
    edges = a.calls(spark, sf_dir).select("src", F.col("dst").alias("node"))
    two = a.top_per(edges, "node", 2, F.asc("src")).groupBy("node").agg(F.array_sort(F.collect_list("src")).alias("first"))
    by = edges.groupBy("node").agg(F.count("*").alias("n")).join(two, "node")
    names = F.transform("first", lambda c: c.cast("string"))
    return by.select("node", F.array_join(x.compact_first(names, F.col("n"), 2), ", ").alias("callers"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document as a context of at most 8,000 characters under its source as heading."""
    out = x.context_text(F.col("source"), F.col("text"), 8000)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), F.length(out).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (jaro_names, cross_language_equivalents, equivalence_groups, recent_findings, compact_callers, contexts)
}

_TREES = r"""t AS (SELECT doc_id AS id, lang AS language, array_to_string(list_transform(string_split(text, chr(10)),
        lambda line: len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))), '/') AS tree FROM documents)"""

ORACLE = {
    "jaro_names": """SELECT a.p_partkey, b.p_partkey AS other, round(jaro_similarity(a.p_name, b.p_name), 6) AS score FROM part a JOIN part b
        ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE round(jaro_similarity(a.p_name, b.p_name), 6) > 0.8""",
    "cross_language_equivalents": f"""WITH {_TREES}, d AS (SELECT DISTINCT language, tree FROM t)
        SELECT a.language, b.language AS other_language, count(*) AS n FROM d a JOIN d b ON a.tree = b.tree AND a.language <> b.language GROUP BY 1, 2""",
    "equivalence_groups": f"WITH {_TREES} SELECT min(id) AS first, count(*) AS n, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM t GROUP BY tree",
    "recent_findings": """SELECT event_id, user_id FROM events WHERE event_type = 'error'
        AND user_id IN (SELECT user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY)""",
    "compact_callers": sql_with("calls")
    + """, g AS (SELECT dst AS node, list_sort(list(DISTINCT src)) AS c FROM calls GROUP BY dst)
        SELECT node, array_to_string(list_transform(c[1:2], lambda v: CAST(v AS VARCHAR)), ', ') || CASE WHEN len(c) > 2 THEN ', ... ' || (len(c) - 2) || ' more' ELSE '' END AS callers FROM g""",
    "contexts": """SELECT doc_id, md5(left('## ' || source || chr(10) || text, 8000)) AS digest, CAST(length(left('## ' || source || chr(10) || text, 8000)) AS INTEGER) AS n_chars FROM documents""",
}
