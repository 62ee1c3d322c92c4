"""Vector, full-text and hybrid retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.vectors import cosine
from ..operators import graph as g
from ..operators import retrieval as r
from ..operators import similarity as s
from ..session import cut
from ..sources import adapters as a
from ..sources.adapters import sql_with, table
from .graph_queries import pagerank_sql


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every vector."""
    return s.nearest(table(spark, sf_dir, "embeddings"), 5).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with a cosine of 0.3 or more."""
    return s.similar_pairs(table(spark, sf_dir, "embeddings"), 0.3)


def similar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs by kind of clone: same label or not, and how close."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    pairs = (
        s.similar_pairs(table(spark, sf_dir, "embeddings"), 0.3)
        .join(label.select(F.col("vec_id").alias("id1"), F.col("label").alias("a")), "id1")
        .join(label.select(F.col("vec_id").alias("id2"), F.col("label").alias("b")), "id2")
    )
    kind = F.when(F.col("score") >= 0.4, "type_iii").otherwise("type_iv")
    return pairs.groupBy(kind.alias("kind"), (F.col("a") == F.col("b")).alias("same_label")).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score")
    )


def semantic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors nearest to vector 0 with a score of 0.05 or more, of some labels only, boosted by their metadata."""
    emb = table(spark, sf_dir, "embeddings")
    probe = emb.where("vec_id = 0").limit(1).select(F.col("embedding").alias("probe"))
    level = F.element_at(lx.strings(("core", "extended", "native")), (F.col("label") % 3 + 1).cast("int"))
    boost = lx.meta_boost(level, F.col("vec_id") % 2 == 0, F.col("label"), lx.INTENT_BOOSTS["explain"])
    hits = emb.join(F.broadcast(probe)).where("vec_id <> 0 AND label <> 7").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("probe")), 6).alias("score"), F.round(boost, 6).alias("boost")
    )
    boosted = hits.where("score >= 0.05").withColumn("boosted_score", F.round(F.col("score") * F.col("boost"), 4))
    return boosted.orderBy(F.desc("boosted_score"), "vec_id").limit(20)


def graph_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public functions as candidates, joined with their vectors and scored against vector 0."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    probe = emb.where("vec_id = 0").limit(1).select(F.col("embedding").alias("probe"))
    candidates = a.functions(spark, sf_dir).where("visibility = 'public'").select("fn", "module", "name")
    return (
        candidates.join(emb, F.col("fn") == F.col("vec_id"))
        .join(F.broadcast(probe))
        .select("fn", "module", "name", F.round(cosine(F.col("embedding"), F.col("probe")), 6).alias("score"))
        .where("score >= 0.0")
    )


def graph_algo_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by 0.7 of their cosine to vector 0 and 0.3 of their PageRank."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    probe = emb.where("vec_id = 0").limit(1).select(F.col("embedding").alias("probe"))
    rank = g.pagerank(a.calls(spark, sf_dir), max_iterations=10, tolerance=None)
    top = rank.select("node", F.round("score", 8).alias("pagerank")).orderBy(F.desc("pagerank"), "node").limit(30)
    scored = top.join(emb, F.col("node") == F.col("vec_id")).join(F.broadcast(probe))
    cos = cosine(F.col("embedding"), F.col("probe"))
    return scored.select("node", "pagerank", F.round(0.7 * cos + 0.3 * F.col("pagerank"), 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for each benchmark item, by BM25."""
    return r.ranked(_bm25(spark, sf_dir), 10).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 scores of the fifty best documents of each item, between 0 and 1."""
    top = r.ranked(_bm25(spark, sf_dir), 50)
    return r.normalised(top).select("query_id", "id", F.round("score", 5).alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and term overlap fused by reciprocal ranks, ten documents an item."""
    hits = cut(_bm25(spark, sf_dir))
    lists = [r.ranked(hits, 100), r.ranked(hits.select("query_id", "id", F.col("shared").alias("score")), 100)]
    return r.reciprocal_rank_fusion(lists).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents of each item, normalised and blended with their quality label as the given score."""
    hits = r.normalised(r.ranked(_bm25(spark, sf_dir), 20)).withColumn("score", F.round("score", 6))
    given = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 10.0).alias("given"))
    return r.blend(hits, given).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twenty lines of each item's ten best documents that fit 8,000 bytes and repeat each other little."""
    hits = cut(r.ranked(_bm25(spark, sf_dir), 10).select("query_id", "id", F.col("rank").alias("_rank")))
    docs = table(spark, sf_dir, "documents").join(hits.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    windows = r.chunks(docs, size=20, overlap=14, min_lines=10)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_rank", "chunk_index"))
    pieces = hits.join(windows, "id").select(
        "query_id", place.alias("rank"), "id", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.octet_length("chunk").alias("size")
    )
    return r.packed_ranges(pieces.where("rank <= 60"), 8000)


def _results(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, dims).alias("embedding"))
    return s.nearest(emb, 10)


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG, MRR, precision and recall at 10 of the nearest neighbours; the same label is relevant."""
    return r.macro_average(r.label_metrics(_results(spark, sf_dir, 64), table(spark, sf_dir, "embeddings")))


def strategy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What using all dimensions changes in the metrics against using the first 32."""
    items = table(spark, sf_dir, "embeddings")
    half, whole = (r.macro_average(r.label_metrics(_results(spark, sf_dir, d), items)) for d in (32, 64))
    b = whole.select(*[F.col(c).alias(f"{c}_b") for c in whole.columns])
    return half.join(b).select(*[F.round(F.col(f"{c}_b") - F.col(c), 4).alias(f"{c}_delta") for c in half.columns])


def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 lines, 5 of them shared, of every document."""
    parts = r.chunks(table(spark, sf_dir, "documents"), size=20, overlap=5, min_lines=10)
    return parts.select("id", "chunk_index", "start_line", "end_line", F.md5("chunk").alias("digest"))


def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest boost of each keyword over document texts (doc) and source names (name), and how many documents have it."""
    docs = table(spark, sf_dir, "documents").select(
        F.array_distinct(lx.text_tokens(F.col("text"))).alias("text"), F.array_distinct(lx.name_tokens(F.col("source"))).alias("name")
    )
    boosted = lambda tokens, kind: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(lx.BOOSTS[kind]).alias("weight")))
    none = F.array().cast("array<string>")
    text, name = F.coalesce("text", none), F.coalesce("name", none)
    each = docs.select(F.inline(F.concat(boosted(text, "doc"), boosted(F.array_except(name, text), "name"))))
    return each.groupBy("token").agg(F.max("weight").alias("weight"), F.count("*").alias("n_docs"))


def string_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that contain ``license``, in any case."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.contains(F.lower("line"), F.lit("license")))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event and part types as queries, with both intents and the expanded query."""
    texts = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.lit("filter list")).alias("query")).union(
        table(spark, sf_dir, "part").select("p_type")
    ).union(table(spark, sf_dir, "events").select("event_type"))
    q = F.col("query")
    return texts.distinct().select(
        "query", lx.intent(q, lx.EXPANSION_INTENTS).alias("intent"), lx.intent(q, lx.RANKING_INTENTS).alias("ranking_intent"), lx.expand_query(q).alias("expanded")
    )


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same text: digest, size and smallest id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


QUERIES = {
    f.__name__: f
    for f in (
        knn_batch, similar_pairs, similar_summary, semantic_first, graph_first, graph_algo_blend, bm25_topk, bm25_normalised, rrf_fusion,
        rerank_blend, context_packing, ir_metrics, strategy_delta, chunk_docs, keyword_weights, string_search, query_expansion, exact_duplicates,
    )
}

_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"
_PAIRS = f"pairs AS (SELECT x.vec_id AS id1, y.vec_id AS id2, x.label AS a, y.label AS b, {_COS.format(a='x.embedding', b='y.embedding')} AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"
_TERMS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_BM25 = f"""asked AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
    split AS MATERIALIZED (SELECT doc_id AS id, {_TERMS} AS terms FROM documents),
    sizes AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM split),
    counts AS MATERIALIZED (SELECT id, term, size, count(*) AS tf FROM (SELECT id, len(terms) AS size, unnest(terms) AS term FROM split)
               WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    rare AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, mean FROM counts, sizes GROUP BY term, n, mean),
    bm25 AS MATERIALIZED (SELECT query_id, id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score
             FROM counts JOIN rare USING (term) JOIN asked USING (term) GROUP BY query_id, id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm25)"""
_NORMAL = "(score - min(score) OVER q) / greatest(max(score) OVER q - min(score) OVER q, 1e-9)"


def _metrics_sql(name: str, dims: int) -> str:
    cos = _COS.format(a=f"x.embedding[1:{dims}]", b=f"y.embedding[1:{dims}]")
    return f"""r{name} AS (SELECT * FROM (SELECT x.vec_id AS q, y.vec_id AS id, x.label = y.label AS hit,
        row_number() OVER (PARTITION BY x.vec_id ORDER BY {cos} DESC, y.vec_id) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) WHERE rank <= 10),
      f{name} AS (SELECT q, sum(CASE WHEN hit THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg, min(rank) FILTER (hit) AS first, count(*) FILTER (hit) AS hits FROM r{name} GROUP BY q),
      m{name} AS (SELECT round(dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 1 + least(10, n)) t(i)), 6) AS ndcg, coalesce(1.0::DOUBLE / first, 0) AS mrr,
        hits / 10.0::DOUBLE AS precision, hits / n::DOUBLE AS recall FROM f{name} JOIN (SELECT x.vec_id AS q, count(*) AS n FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY 1) USING (q)),
      a{name} AS (SELECT CAST(round(CAST(avg(ndcg) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS ndcg, CAST(round(CAST(avg(mrr) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS mrr, CAST(round(CAST(avg(precision) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS precision, CAST(round(CAST(avg(recall) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS recall FROM m{name})"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(words) -> str:
    return "MAP {" + ", ".join(f"'{k}': {_list(v)}" for k, v in words.items()) + "}"


def _intent_sql(lexicon) -> str:
    arms = " ".join(f"WHEN len(list_filter({_list(v)}, lambda w: contains(lower(query), w))) > 0 THEN '{k}'" for k, v in lexicon.items())
    return f"CASE {arms} ELSE 'general' END"


def _words_sql(words) -> str:
    """Distinct words in order of their first place."""
    return f"""list_filter(flatten(list_transform(terms, lambda t: coalesce(element_at({_map(words)}, t)[1], CAST([] AS VARCHAR[])))), lambda x: true)"""


def _ordered_distinct(expr: str) -> str:
    return f"list_transform(list_filter(list_zip({expr}, range(1, len({expr}) + 1)), lambda p: list_position({expr}, p[1]) = p[2]), lambda p: p[1])"


_TOKENS = r"""list_filter(list_transform(string_split_regex(regexp_replace(replace(regexp_replace(text, '[^a-zA-Z0-9_\s-]', ' ', 'g'), '_', ' '), '([a-z])([A-Z])', '\1 \2', 'g'), '\s+'), lambda t: lower(t)), lambda t: len(t) >= 2 AND NOT list_contains(STOP, t))""".replace(
    "STOP", _list(sorted(set(lx.STOP_WORDS)))
)

ORACLE = {
    "knn_batch": f"""WITH p AS (SELECT x.vec_id AS query_id, y.vec_id, {_COS.format(a='x.embedding', b='y.embedding')} AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) WHERE rank <= 5""",
    "similar_pairs": f"WITH {_PAIRS} SELECT id1, id2, score FROM pairs WHERE score >= 0.3",
    "similar_summary": f"""WITH {_PAIRS} SELECT CASE WHEN score >= 0.4 THEN 'type_iii' ELSE 'type_iv' END AS kind, a = b AS same_label, count(*) AS n, CAST(round(CAST(avg(score) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS mean_score
        FROM pairs WHERE score >= 0.3 GROUP BY 1, 2""",
    "semantic_first": f"""WITH q AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0),
        h AS (SELECT vec_id, {_COS.format(a='embedding', b='probe')} AS score,
          round((CASE label % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 0.8::DOUBLE END) * (CASE WHEN vec_id % 2 = 0 THEN 1.4::DOUBLE ELSE 1 END) * (1 - least(label * 0.03::DOUBLE, 0.5)), 6) AS boost
          FROM embeddings, q WHERE vec_id <> 0 AND label <> 7)
        SELECT *, round(score * boost, 4) AS boosted_score FROM h WHERE score >= 0.05 ORDER BY boosted_score DESC, vec_id LIMIT 20""",
    "graph_first": sql_with("functions")
    + f""", q AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0)
        SELECT * FROM (SELECT fn, module, name, {_COS.format(a='embedding', b='probe')} AS score FROM functions JOIN embeddings ON fn = vec_id, q WHERE visibility = 'public') WHERE score >= 0""",
    "graph_algo_blend": sql_with("calls") + ", " + pagerank_sql("calls", 10)
    + """, q AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0),
        t AS (SELECT node, round(score, 8) AS pagerank FROM p10 ORDER BY round(score, 8) DESC, node LIMIT 30)
        SELECT node, pagerank, round(0.7::DOUBLE * list_cosine_similarity(embedding::DOUBLE[], probe::DOUBLE[]) + 0.3::DOUBLE * pagerank, 6) AS score
        FROM t JOIN embeddings ON node = vec_id, q""",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rank, id, score FROM ranked WHERE rank <= 10",
    "bm25_normalised": f"WITH {_BM25} SELECT query_id, id, round({_NORMAL}, 5) AS score FROM ranked WHERE rank <= 50 WINDOW q AS (PARTITION BY query_id)",
    "rrf_fusion": f"""WITH {_BM25}, shared AS (SELECT query_id, id, count(*) AS score FROM (SELECT id, unnest(list_distinct(terms)) AS term FROM split) JOIN asked USING (term) GROUP BY ALL),
        mixed AS (SELECT query_id, id, 1.0::DOUBLE / (rank - 1 + 60) AS part FROM ranked WHERE rank <= 100 UNION ALL
          SELECT query_id, id, 1.0::DOUBLE / (rank - 1 + 60) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM shared) WHERE rank <= 100),
        fused AS (SELECT query_id, id, round(sum(part), 6) AS score FROM mixed GROUP BY ALL)
        SELECT query_id, rank, id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused) WHERE rank <= 10""",
    "rerank_blend": f"""WITH {_BM25}, n AS (SELECT query_id, id, round({_NORMAL}, 6) AS score FROM ranked WHERE rank <= 20 WINDOW q AS (PARTITION BY query_id)),
        b AS (SELECT query_id, id, round(0.6::DOUBLE * coalesce(quality * 10.0::DOUBLE, 5.0) / 10 + (1 - 0.6::DOUBLE) * score, 6) AS score FROM n LEFT JOIN labels ON doc_id = id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM b""",
    "context_packing": f"""WITH RECURSIVE {_BM25}, l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IN (SELECT id FROM ranked WHERE rank <= 10)),
        c AS (SELECT id, lines, CASE WHEN len(lines) < 10 THEN [0] ELSE range(0, len(lines), 6) END AS starts, CASE WHEN len(lines) < 10 THEN len(lines) ELSE 20 END AS width FROM l),
        u AS (SELECT id, lines, width, unnest(starts) AS start, generate_subscripts(starts, 1) AS chunk_index FROM c),
        p AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_index) AS place, id, start + 1 AS s, least(start + width, len(lines)) AS e,
          strlen(array_to_string(lines[start + 1:start + width], chr(10))) AS size FROM ranked JOIN u USING (id) WHERE rank <= 10),
        walk AS (SELECT query_id, 0::BIGINT AS place, 0::BIGINT AS id, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS size, 0::BIGINT AS used, [(0::BIGINT, 0::BIGINT, 0::BIGINT)][:0] AS kept, false AS taken FROM (SELECT DISTINCT query_id FROM p)
          UNION ALL SELECT query_id, place, id, s, e, size, CASE WHEN ok THEN used + size ELSE used END, CASE WHEN ok THEN list_append(kept, (id, s, e)) ELSE kept END, ok FROM (
            SELECT h.*, w.used, w.kept, w.used + h.size <= 8000 AND len(list_filter(w.kept, lambda k: k[1] = h.id
              AND (least(k[3], h.e) - greatest(k[2], h.s) + 1) / (least(k[3] - k[2], h.e - h.s) + 1)::DOUBLE >= 0.6)) = 0 AS ok
            FROM walk w JOIN p h ON h.query_id = w.query_id AND h.place = w.place + 1 WHERE h.place <= 60))
        SELECT query_id, CAST(place AS INTEGER) AS rank, id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", size FROM walk WHERE taken""",
    "ir_metrics": f"WITH {_metrics_sql('x', 64)} SELECT * FROM ax",
    "strategy_delta": f"""WITH {_metrics_sql('x', 32)}, {_metrics_sql('y', 64)}
        SELECT round(ay.ndcg - ax.ndcg, 4) AS ndcg_delta, round(ay.mrr - ax.mrr, 4) AS mrr_delta, round(ay.precision - ax.precision, 4) AS precision_delta, round(ay.recall - ax.recall, 4) AS recall_delta FROM ax, ay""",
    "chunk_docs": """WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents),
        c AS (SELECT id, lines, CASE WHEN len(lines) < 10 THEN [0] ELSE range(0, len(lines), 15) END AS starts, CASE WHEN len(lines) < 10 THEN len(lines) ELSE 20 END AS width FROM l),
        u AS (SELECT id, lines, width, unnest(starts) AS start, generate_subscripts(starts, 1) - 1 AS chunk_index FROM c)
        SELECT id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start + 1 AS INTEGER) AS start_line, CAST(least(start + width, len(lines)) AS INTEGER) AS end_line,
          md5(array_to_string(lines[start + 1:start + width], chr(10))) AS digest FROM u""",
    "keyword_weights": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token, 1.5::DOUBLE AS weight FROM documents
          UNION ALL SELECT doc_id, source, 1.0 FROM documents WHERE length(source) >= 2),
        o AS (SELECT token, doc_id, max(weight) AS weight FROM t GROUP BY ALL)
        SELECT token, max(weight) AS weight, count(*) AS n_docs FROM o GROUP BY token""",
    "string_search": """SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE contains(lower(line), 'license')""",
    "query_expansion": f"""WITH t AS (SELECT event_type || ' filter list' AS query FROM events UNION SELECT p_type FROM part UNION SELECT event_type FROM events),
        i AS (SELECT query, {_intent_sql(lx.EXPANSION_INTENTS)} AS intent, {_intent_sql(lx.RANKING_INTENTS)} AS ranking_intent,
          list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') AS terms FROM t),
        w AS (SELECT *, {_words_sql(lx.SYNONYMS)} AS syn, {_words_sql(lx.CROSS_LANGUAGE)} AS xl FROM i),
        d AS (SELECT *, list_concat(list_concat(element_at({_map(lx.INTENT_TERMS)}, intent)[1], {_ordered_distinct('syn')}), {_ordered_distinct('xl')})[1:5] AS found FROM w)
        SELECT query, intent, ranking_intent, query || ' ' || array_to_string({_ordered_distinct('found')}, ' ') AS expanded FROM d""",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
}
