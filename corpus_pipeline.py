"""The corpus pipeline: documents to tokens in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``, with ``n_chars`` brought up to date where a text
changed.  ``run`` applies them to the documents of a data folder, each stage on a
checkpoint of what the stage before it kept.

Defined cases: a null text counts as the empty text for scores, copies and tokens, and
is kept as null by the line stage; texts without words are copies of each other and
leave the mix; rows without a ``doc_id`` are copies of nothing; rows that repeat one are
one document from the simhash stage on; ties go to the smaller id; texts of any length
are taken whole; other columns are carried up to the last stage, whatever their names;
empty tables, labels included, give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix_documents
from tessera.llm.near_copies import dedup_near_copies
from tessera.llm.pieces import token_digests
from tessera.llm.queries import piece_model_path
from tessera.llm.toxicity import reject_toxic
from tessera.session import cut
from tessera.sources.tables import table

#: Entries of the tables in Python workers, which outlive a stage: features counted, and segments with their tokens.
HELD, KEPT = 100_000, 40_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the folder."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"), held=HELD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeats of lines that stand on many sites; no document goes."""
    out = dedup_lines(docs).drop("_lines_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of a Jaccard similarity of 0.8 or more."""
    return dedup_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix of sources takes them."""
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of ids and decoded text."""
    return token_digests(docs, piece_model_path(), with_ids=True, kept=KEPT)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
