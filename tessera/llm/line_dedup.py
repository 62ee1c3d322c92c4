"""Line dedup by distinct-site spread, with DataFrame functions only.

A line that stands on many sites is boilerplate.  A HyperLogLog sketch of the
sites for each line hash merges by aggregation; lines whose estimate is near the
threshold get an exact distinct count.  Of a boilerplate line the first
occurrence, by document id and then place, stays, so that no content is lost; all
others go.

Defined cases: a null text stays null; null sources are one site; blank lines are
never boilerplate; a document without ``doc_id`` is known by a hash of its text;
ids may be numbers or text, which is ordered as text; rows that repeat a ``doc_id``
and text are one document and are treated alike; a very long text is split as a whole,
inside its row; an empty table gives an empty result.  Other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .keys import document_key

#: Characters around a line that do not tell it from another.
BLANKS = " \t\r"


def _document_keys(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    return {"_t": F.xxhash64(F.col(text_col)), "_d": document_key(docs, id_col, text_col)}


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row for each line that is not blank: document key, place, site and 128 bits of hash."""
    keys = [c.alias(n) for n, c in _document_keys(docs, id_col, text_col).items()]
    lines = docs.select(
        *keys, F.col(site_col).cast("string").alias("_site"), F.posexplode(F.split(text_col, "\n")).alias("_pos", "_line")
    )
    line = F.btrim(F.col("_line"), F.lit(BLANKS))
    return lines.where(line != "").select(
        "_d",
        "_t",
        "_pos",
        F.coalesce(F.concat(F.lit("s"), F.col("_site")), F.lit("")).alias("_site"),
        F.xxhash64(line).alias("_h1"),
        F.xxhash64(F.lit(1), line).alias("_h2"),
    )


def boilerplate_lines(
    docs: DataFrame,
    *,
    min_sites: int = 10,
    margin: float = 0.25,
    lg_k: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """Occurrences of boilerplate lines: ``_d, _t, _pos, _first`` (the one that stays).

    ``margin`` is how far, as a share of ``min_sites``, an estimate may be off and
    still be settled by an exact count; at ``lg_k`` 12 a sketch's error is below 2 %.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    sites = lines.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", lg_k).alias("_sketch"))
    estimate = F.hll_sketch_estimate("_sketch")
    spread = cut(
        sites.select("_h1", "_h2", estimate.alias("_sites")).where(F.col("_sites") >= min_sites * (1 - margin))
    )
    hits = cut(lines.join(spread, ["_h1", "_h2"]))
    near = (
        hits.where(F.col("_sites") <= min_sites * (1 + margin))
        .groupBy("_h1", "_h2")
        .agg(F.count_distinct("_site").alias("_exact"))
        .where(F.col("_exact") >= min_sites)
        .select("_h1", "_h2")
    )
    sure = spread.where(F.col("_sites") > min_sites * (1 + margin)).select("_h1", "_h2")
    spread_lines = sure.unionByName(near)
    first = hits.groupBy("_h1", "_h2").agg(F.min(F.struct("_d", "_t", "_pos")).alias("_at"))
    # a table of its own, so that the join below is a plain one whose hot keys the adaptive skew join can split
    kept = cut(spread_lines.join(first, ["_h1", "_h2"]))
    return hits.join(kept, ["_h1", "_h2"]).select(
        "_d", "_t", "_pos", (F.struct("_d", "_t", "_pos") == F.col("_at")).alias("_first")
    )


def _without(lines: Column, gone: Column) -> Column:
    """An array without its elements at the sorted places ``gone`` (from 0), in time linear in both."""
    starts = F.concat(F.array(F.lit(-1)), gone)
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def dedup_lines(
    docs: DataFrame,
    *,
    min_sites: int = 10,
    margin: float = 0.25,
    lg_k: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus ``_lines_removed``."""
    found = boilerplate_lines(
        docs, min_sites=min_sites, margin=margin, lg_k=lg_k, id_col=id_col, text_col=text_col, site_col=site_col
    )
    gone = (
        found.where(~F.col("_first"))
        .distinct()
        .groupBy("_d", "_t")
        .agg(F.array_sort(F.collect_list("_pos")).alias("_gone"))
    )
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")  # no column of the documents meets one of the keys
    keyed = docs.select(whole, *[c.alias(n) for n, c in _document_keys(docs, id_col, text_col).items()])
    joined = keyed.join(gone, ["_d", "_t"], "left")
    old = F.col("_doc")[text_col]
    text = F.when(
        F.col("_gone").isNotNull(), F.array_join(_without(F.split(old, "\n"), F.col("_gone")), "\n")
    ).otherwise(old)
    return joined.select(
        *[(text if c == text_col else F.col("_doc")[c]).alias(c) for c in docs.columns if c != "_lines_removed"],
        F.coalesce(F.size("_gone"), F.lit(0)).alias("_lines_removed"),
    )
