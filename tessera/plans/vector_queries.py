"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.tables import table


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to vector 0 by cosine, score at least 0.1."""
    emb = table(spark, sf_dir, "embeddings")
    probe = emb.where("vec_id = 0").limit(1).select(F.col("embedding").alias("probe"))
    scored = emb.where("vec_id <> 0").join(F.broadcast(probe)).select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("probe")), 6).alias("score")
    )
    return scored.where("score >= 0.1").orderBy(F.desc("score"), "vec_id").limit(10)


QUERIES = {"vector_topk": vector_topk}

ORACLE = {
    "vector_topk": """
        WITH q AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], probe::DOUBLE[]), 6) AS score
        FROM embeddings, q WHERE vec_id <> 0
          AND round(list_cosine_similarity(embedding::DOUBLE[], probe::DOUBLE[]), 6) >= 0.1
        ORDER BY score DESC, vec_id LIMIT 10""",
}
