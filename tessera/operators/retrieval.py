"""Ranking: BM25, rank fusion, normalisation, reranking, context packing and retrieval quality."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: A term: letters and digits of any script.
TERM = r"[\p{L}\p{N}]+"
#: Counts of terms in documents that one task scores.
TASK_COUNTS = 100_000
#: Distinct terms of all queries up to which they are broadcast; beyond, they are joined.
BROADCAST_TERMS = 200_000


def terms(text: Column) -> Column:
    """Lower-case letters and digits in runs."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(
    docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", query_id: str = "item_id", k1: float = 1.2, b: float = 0.75,
    scope: Column | None = None,
) -> DataFrame:
    """``query_id, id, score, shared`` of every document that shares terms with a query: six digits, and how many terms.

    Only the queries' terms leave the documents' tasks: their number is counted first, and
    up to ``BROADCAST_TERMS`` they are broadcast.  The counts are written once, for the
    document frequencies and for the scores.  Scores of few queries are summed where the documents' counts are, in
    as many tasks as there are counts, so that only counts are shuffled and not a row for each query and term.  With a ``scope``, a condition on the documents, only
    those inside are scored, by the frequencies and the mean size of the whole corpus.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    wanted = cut(asked.select("term").distinct())
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    lengths = docs.select(F.col(doc_id).alias("id"), "text", inside.alias("inside"), F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).alias("size"))
    sizes = lengths.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    counts = cut(
        lengths.select("id", "size", "inside", F.explode(terms(F.col("text"))).alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy("id", "term", "size", "inside")
        .agg(F.count("*").alias("tf"))
    )
    spread = counts.groupBy("term").agg(F.count("*").alias("df"))
    rare = spread.join(F.broadcast(sizes)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    # of a term: a row for each query that asks it, so that a document's row meets no more rows than there are queries
    scored, weighed = counts.where("inside"), asked.join(rare, "term")
    if asked.count() <= BROADCAST_TERMS:
        scored = scored.repartition(max(1, -(-counts.count() // TASK_COUNTS)), "id")
        weighed = F.broadcast(weighed)
    parts = scored.join(weighed, "term").select("query_id", "id", weight.alias("weight"))
    return parts.groupBy("query_id", "id").agg(F.round(F.sum("weight"), 6).alias("score"), F.count("*").cast("double").alias("shared"))


def ranked(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """``hits`` with ``rank`` from 1 within each query, by score, ties to the smaller id; the first ``limit`` only."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def normalised(hits: DataFrame) -> DataFrame:
    """``hits`` with ``score`` between 0 and 1 within each query; the range is at least 1e-9."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9)))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, limit: int = 10) -> DataFrame:
    """``query_id, rank, id, score`` of fused lists of ``query_id, rank, id``, whose ranks start at 1; a rank counts from 0."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "id", (F.lit(1.0) / (F.col("rank") - 1 + k)).alias("part")) for x in lists])
    return ranked(every.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score")), limit)


def blend(hits: DataFrame, scores: DataFrame, alpha: float = 0.6, missing: float = 5.0, first: int = 20) -> DataFrame:
    """Rerank the first ``first`` hits by ``alpha * given / 10 + (1 - alpha) * score``; a missing given score is 5."""
    top = ranked(hits, first).drop("rank").join(scores.select("id", "given"), "id", "left")
    mixed = alpha * F.coalesce("given", F.lit(missing)) / 10 + (1 - alpha) * F.col("score")
    return ranked(top.select("query_id", "id", F.round(mixed, 6).alias("score")))


def packed_ranges(hits: DataFrame, budget: int = 8000, overlap: float = 0.6) -> DataFrame:
    """``query_id, rank, id, start, end, size`` of the pieces that fit, best first, without those that repeat lines.

    Takes ``query_id, rank, id, start, end, size`` (lines, both ends included, and bytes) with a bounded number of
    pieces a query.  A piece that does not fit is skipped, and so is one that shares ``overlap`` or more of the lines of
    the shorter of the two with a piece of the same ``id`` that is taken already.
    """
    piece = "struct<rank: int, id: bigint, start: int, `end`: int, size: bigint>"
    columns = [F.col(c).cast(k).alias(c) for c, k in (("rank", "int"), ("id", "bigint"), ("start", "int"), ("end", "int"), ("size", "bigint"))]
    items = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))

    def take(acc: Column, x: Column) -> Column:
        def shares(y: Column) -> Column:
            lines = F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) + 1
            shorter = F.least(x["end"] - x["start"], y["end"] - y["start"]) + 1
            return (x["id"] == y["id"]) & (lines / shorter >= overlap)

        fits = (acc["used"] + x["size"] <= budget) & ~F.exists(acc["kept"], shares)
        return F.when(fits, F.struct((acc["used"] + x["size"]).alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    none = F.from_json(F.lit('{"used": 0, "kept": []}'), f"struct<used: bigint, kept: array<{piece}>>")
    return items.select("query_id", F.inline(F.aggregate("items", none, take)["kept"]))


def in_scope(scope: dict[str, object]) -> Column:
    """Whether a row has all the values of ``scope``."""
    return reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in scope.items()], F.lit(True))


def scoped(hits: DataFrame, items: DataFrame, scope: dict[str, object]) -> DataFrame:
    """Hits whose item has all the values of ``scope``; items are ``id`` and any columns."""
    return hits.join(items.where(in_scope(scope)).select("id"), "id", "left_semi")


def packed(hits: DataFrame, budget: int = 8000) -> DataFrame:
    """``query_id, rank, id, size`` of the hits that fit, best first; one that does not fit is skipped and later ones may.

    Takes ``query_id, rank, id, size`` with a bounded number of hits a query.
    """
    state = "struct<used: bigint, kept: array<struct<rank: int, id: bigint, size: bigint>>>"
    items = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").cast("bigint").alias("id"), F.col("size").cast("bigint").alias("size")))).alias("items")
    )

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["size"]).alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    none = F.from_json(F.lit('{"used": 0, "kept": []}'), state)
    return items.select("query_id", F.inline(F.aggregate("items", none, take)["kept"]))


def relevance_metrics(results: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, ndcg, mrr, precision, recall`` at ``k``, for every query of ``golden`` (``query_id, id, grade``).

    Results that are not golden have grade 0; a query without relevant items has recall 1 and nDCG 0.
    """
    gain = F.pow(F.lit(2.0), "grade") - 1
    found = (
        results.where(F.col("rank") <= k)
        .join(golden, ["query_id", "id"], "left")
        .withColumn("grade", F.coalesce("grade", F.lit(0)))
        .groupBy("query_id")
        .agg(
            F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"),
            F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
            F.count_if(F.col("grade") > 0).alias("hits"),
        )
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = (
        golden.withColumn("place", F.row_number().over(best))
        .groupBy("query_id")
        .agg(F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") > 0).alias("relevant"))
    )
    zero = F.lit(0)
    return ideal.join(found, "query_id", "left").select(
        "query_id",
        F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("hits", zero) / k).alias("precision"),
        F.when(F.col("relevant") > 0, F.coalesce("hits", zero) / F.col("relevant")).otherwise(1.0).alias("recall"),
    )


def label_metrics(results: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """``relevance_metrics`` where what has the query's label is relevant, with grade 1, without listing such pairs.

    A result meets the labels of its query and of itself; of a label only the number of its items is needed.
    Queries that share their label with nothing have no relevant items and give no row.
    """
    labels = items.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    relevant = labels.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    asked = labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    same = results.where(F.col("rank") <= k).join(labels, "id").join(asked, "query_id").where("label = wanted")
    found = same.groupBy("query_id").agg(
        F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("hits")
    )
    # the best gain of up to k relevant items, a row of k numbers
    gains = F.array(*[F.lit(sum(1 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(k + 1)])
    ideal = F.get(gains, F.least(F.col("relevant"), F.lit(k)).cast("int"))
    every = asked.join(relevant, F.col("wanted") == F.col("label")).where("relevant > 0").select("query_id", "relevant").join(found, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return every.select(
        "query_id",
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (hits / k).alias("precision"),
        (hits / F.col("relevant")).alias("recall"),
    )


def macro_average(metrics: DataFrame) -> DataFrame:
    """The means of the metrics over all queries, four digits; zeros without queries."""
    return metrics.agg(*[F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c) for c in ("ndcg", "mrr", "precision", "recall")])


def chunks(docs: DataFrame, *, id_col: str = "doc_id", size: int = 60, overlap: int = 15, min_lines: int = 30) -> DataFrame:
    """``id, chunk_index, start_line, end_line, chunk``: overlapping windows of lines; a text of under ``min_lines`` is one."""
    lines = F.split("text", "\n")
    starts = F.when(F.size(lines) < min_lines, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size - overlap)))
    width = F.when(F.size(lines) < min_lines, F.size(lines)).otherwise(F.lit(size))
    parts = docs.select(F.col(id_col).alias("id"), lines.alias("lines"), width.alias("width"), F.posexplode(starts).alias("chunk_index", "start"))
    last = F.least(F.col("start") + F.col("width"), F.size("lines"))
    return parts.select(
        "id", "chunk_index", (F.col("start") + 1).alias("start_line"), last.alias("end_line"),
        F.array_join(F.slice("lines", F.col("start") + 1, F.col("width")), "\n").alias("chunk"),
    )
