"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys, are dealt into key ranges within each source,
and a prefix sum of their word counts, taken over ranges first and then inside
each range, says where each source's budget cuts.  No group is as large as a
source: a range holds about 1/4096 of it.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; sources without words get target 0; a null ``doc_id`` sorts by an
empty key; rows that repeat a ``doc_id`` are counted one by one; equal keys go by
``doc_id`` and size; a very long text is one row, counted as a whole; an empty table
gives an empty result.  Columns besides those named are ignored by ``mix_plan``
and carried by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)

def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, range_digits: int, *carried: Column) -> DataFrame:
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.select(
        *carried,
        F.col(id_col).alias("_id"),
        word_count(F.col(text_col)).alias("_size"),
        F.col(source_col).isNull().alias("_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
        F.left(key, F.lit(16)).alias("_key"),
        F.left(key, F.lit(range_digits)).alias("_range"),
    )


def source_targets(totals: DataFrame, share: float, max_epochs: int, weights: tuple[float, ...]) -> DataFrame:
    """Targets by source: ``min(cap, level * weight)`` with the level that spends the whole budget.

    ``totals`` has ``_null, _src, source_size``, a row a source, so the ordered
    windows here see as many rows as there are sources.  Sorted by cap over weight,
    the capped sources come first; the level is the one that the first source
    that is not capped agrees with.
    """
    by_name = Window.orderBy("_null", "_src")
    by_ratio = Window.orderBy("ratio", "_null", "_src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("_turn", (F.row_number().over(by_name) - 1) % len(weights)).withColumn(
        "weight", F.get(weight, F.col("_turn"))
    )
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn(
        "ratio", F.col("cap") / F.col("weight")
    )
    levels = capped.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    spent = levels.withColumn("top", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return spent.select(
        "_null", "_src", "source_size", F.least("cap", F.coalesce(F.col("top") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _planned(keyed: DataFrame, share: float, max_epochs: int, weights: tuple[float, ...]) -> DataFrame:
    """``keyed`` with its source's size and target and the words taken of each row."""
    ranges = cut(keyed.groupBy("_null", "_src", "_range").agg(F.sum("_size").alias("_in_range")))
    targets = source_targets(
        ranges.groupBy("_null", "_src").agg(F.sum("_in_range").alias("source_size")), share, max_epochs, weights
    )
    earlier = Window.partitionBy("_null", "_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0))).join(
        targets, ["_null", "_src"]
    )
    within = (
        Window.partitionBy("_null", "_src", "_range")
        .orderBy("_key", F.col("_id").asc_nulls_first(), "_size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = keyed.withColumn("_upto", F.sum("_size").over(within)).join(
        offsets.drop("_in_range"), ["_null", "_src", "_range"]
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    start = F.col("_offset") + F.col("_upto") - F.col("_size")
    last = F.greatest(F.lit(0), F.least(F.col("_size"), rest - start))
    return placed.withColumn("_taken", (F.col("_size") * epochs + last).cast("long"))


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    range_digits: int = 3,
) -> DataFrame:
    """How many words the mix takes of each document: ``doc_id, size, source_size, target, taken``.

    ``range_digits`` hexadecimal digits of the key name a range: 3 give 4096 ranges
    a source; a corpus whose largest source has over 10^10 documents takes 4.
    """
    keyed = cut(_keyed(docs, id_col, text_col, source_col, seed, range_digits))
    plan = _planned(keyed, share, max_epochs, weights)
    return plan.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    range_digits: int = 3,
) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken.

    A document that its source's budget cuts keeps its first words; one that is
    not taken goes; a document without words goes too, as no budget takes it.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")  # no column of the documents meets one of the plan
    keyed = _keyed(docs, id_col, text_col, source_col, seed, range_digits, whole)
    plan = _planned(keyed, share, max_epochs, weights).where(F.col("_taken") > 0)
    again = plan.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_epoch") - 1) * F.col("_size"))
    old = F.col("_doc")[text_col]
    out = again.select("_doc", F.when(words < F.col("_size"), first_words(old, words)).otherwise(old).alias("_text"))
    new = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
