"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .codes import vector_codes
from .cover_tree import exact_topk
from .divergence import source_divergence
from .html_text import extract_pages
from .learned_partitions import approximate_topk
from .line_dedup import dedup_lines
from .mixing import mix_plan
from .pieces import token_digests
from .quality import fit_quality, score_quality
from .secrets import secret_spans
from .simhash import fingerprint_hex, near_components
from .substring_dedup import dedup_substrings
from .toxicity import fit_toxicity, held_out, score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document, learnt from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs.select("doc_id", "text"), model, score_col="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix_plan(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors found for every twentieth vector."""
    return approximate_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeat earlier spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "text", F.col("_units_removed").alias("n_removed"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of each document and the component of its near copies."""
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def piece_model_path() -> str:
    """Where the public tokenizer's model file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each document."""
    return token_digests(table(spark, sf_dir, "documents"), piece_model_path())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: counts, digest and spans."""
    return secret_spans(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sites or more."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_lines_removed").cast("long").alias("lines_removed"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document, learnt from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text", *model.metadata_cols), model, score_col="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ: pairs of sources, and terms of a source against its language."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by four codebooks, with their errors; ``tried`` of 1,024 distances were computed."""
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("tried")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_exact_topk": op4_exact_topk,
    "op5_ann": op5_ann,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality": op11_quality,
    "op12_divergence": op12_divergence,
    "op13_codes": op13_codes,
}


def codes_sql(rounds: int = 4) -> str:
    """SQL of the vector codes, the rounds written out one after another."""
    assign = """
        a{i} AS MATERIALIZED (
          SELECT vec_id, part, entry, d FROM (
            SELECT x.vec_id, x.part, c.entry, x.w - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS d,
                   row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY x.w - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v), c.entry) AS r
            FROM parts x JOIN c{i} c ON x.part = c.part) WHERE r = 1)"""
    move = """
        m{i} AS (
          SELECT part, entry, list(s ORDER BY pos) AS v FROM (
            SELECT p.part, a.entry, pos, CAST(floor(sum(x) / count(*)) AS DOUBLE) AS s
            FROM (SELECT vec_id, part, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM parts) p
            JOIN a{i} a ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL) GROUP BY ALL),
        c{j} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)"""
    steps = ",".join(assign.format(i=i) + "," + move.format(i=i, j=i + 1) for i in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS (SELECT vec_id, part, list_slice(q, CAST(part * len(q) // 4 + 1 AS BIGINT), CAST((part + 1) * len(q) // 4 AS BIGINT)) AS v FROM kept, range(4) t(part)),
        parts AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS w FROM cut),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256),
        c0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN first USING (vec_id)),{steps},{assign.format(i=rounds)},
        coded AS (
          SELECT vec_id, string_agg(format('{{:02x}}', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM a{rounds} GROUP BY vec_id),
        labelled AS (SELECT kept.label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY ALL),
        digest AS (
          SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256
          FROM c{rounds})
        SELECT vec_id, code, error, label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id) JOIN labelled l ON l.label IS NOT DISTINCT FROM kept.label, digest"""


ORACLE = {
    "op2_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source IS NULL AS is_null, coalesce(source, '') AS src,
                 CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                 left(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 16) AS k
          FROM documents),
        totals AS (SELECT is_null, src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
        weighed AS (
          SELECT *, CASE (row_number() OVER (ORDER BY is_null, src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                 source_size * 2.0::DOUBLE AS cap FROM totals),
        levels AS (
          SELECT *, cap / weight AS ratio,
                 (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
          FROM weighed WINDOW b AS (ORDER BY cap / weight, is_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        top AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS t FROM levels),
        targets AS (SELECT is_null, src, source_size, least(cap, coalesce(t * weight, cap)) AS target FROM top),
        placed AS (
          SELECT s.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
                 sum(s.size) OVER (PARTITION BY s.is_null, s.src ORDER BY s.k, s.doc_id NULLS FIRST, s.size
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
          FROM sized s JOIN targets t USING (is_null, src)),
        cuts AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
        SELECT doc_id, size, source_size, target,
               CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
        FROM cuts""",
    "op4_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_line_dedup": r"""
        WITH split AS (
          SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos
          FROM documents WHERE text IS NOT NULL),
        lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM split),
        spread AS (
          SELECT body, min((doc_id, pos)) AS first FROM lines WHERE body <> ''
          GROUP BY body HAVING count(DISTINCT coalesce('s' || source, '')) >= 10),
        marked AS (
          SELECT l.*, s.body IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone
          FROM lines l LEFT JOIN spread s ON l.body = s.body),
        built AS (
          SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
                 count(*) FILTER (gone) AS lines_removed
          FROM marked GROUP BY doc_id)
        SELECT doc_id, text, lines_removed FROM built
        UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL""",
    "op12_divergence": r"""
        WITH d AS MATERIALIZED (
          SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        o AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
        kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        l AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS nl FROM kept GROUP BY ALL),
        g AS MATERIALIZED (
          SELECT lang, source, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl, coalesce(s, 0) AS s
          FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)
          LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS s FROM n GROUP BY ALL) USING (lang, source)),
        p AS MATERIALIZED (
          SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS c,
                 CAST(1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (g.s + g.v) AS BIGINT) AS p,
                 CAST(1 + (1000000000::HUGEINT * (kept.total + 1)) // (g.nl + g.v) AS BIGINT) AS q
          FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
        pair AS (
          SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_codes": codes_sql(),
}
