"""Near copies: SimHash BK-trees, completed to an exact Jaccard similarity of word shingles.

Texts with the same set of shingles are one node.  Candidates come from two sides.  The
BK-trees of ``simhash`` link fingerprints of the same shingles that lie within three
bits.  At a similarity of 0.8 fingerprints are about ten of 64 bits apart, farther than
any tree can search without visiting all of it, so nodes also meet in buckets, each a
hash of ``ROWS`` of their least shingle hashes: two nodes of a similarity of 0.8 miss
each other in all ``BANDS`` buckets with a chance of 7 in a million, more similar ones
less often.  Every candidate is decided by the exact similarity of the two sets.

A bucket of near copies must not become all its pairs.  So a bucket's nodes are first
compared with its most usual one, that with the least share of shingles which stand in no
other set, and those that it does not link are compared once more with the most usual of
their own.  What is still apart after that is completed by prefixes.  With the
rarest shingles first, two sets of a similarity of 0.8 share a shingle so early in both
that enough of each is left after it; so a copy with many shingles of its own meets only
those that share one of these.  Nodes of different components are compared if they share
such a shingle and their places and sizes allow the similarity, which loses no link.

Defined cases: as in ``simhash``, a null or empty text, and one without words, is a copy
of the others like it, and fewer words than a shingle make one shingle; rows without a
``doc_id`` link nothing; rows that repeat a ``doc_id`` are one document; equal sizes and
shares are told apart by the node's hash; a very long text is hashed in blocks; a
text's shingles are told apart by hashes of 64 bits; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..session import cut
from .simhash import hashed_bits, keep_named, near_links

ROWS, BANDS = 5, 30
#: Shingles whose hashes are taken at a time; bounds the memory of a very long text.
_BLOCK = 1 << 12
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2)

#: 9 shared >= 4 (n_a + n_b) is shared / (n_a + n_b - shared) >= 0.8 in whole numbers.
_NEAR = "9L * shared >= 4L * (n_a + n_b)"
#: Sizes are alike up to one in so many.
_STEP = 1.02


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the different shingles of a text, in order."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxh64_intdigest, seed=seed), grams), np.uint64))


def bucket_hashes(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band, of the band and its least hashes; none for a text without words."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start : start + _BLOCK]
        np.minimum(least, (block * _FACTORS + _TERMS).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(bands)], np.uint64).view(np.int64)


def _sets(docs: DataFrame, shingle: int, with_set: bool) -> DataFrame:
    """``doc_id, node, fp`` and the node's shingles or buckets, for rows of ``doc_id, text``; with shingles, of the rows that are the ``wanted`` node."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                nodes, prints, lists, kept = [], [], [], []
                wanted = part.column(2).to_numpy().view(np.uint64) if with_set else None
                for i, cell in enumerate(part.column(1)):
                    found = shingle_set(cell.as_py(), shingle)
                    node = xxh64_intdigest(found.tobytes())
                    if with_set and node != wanted[i]:
                        continue
                    kept.append(i)
                    nodes.append(node)
                    prints.append(0 if with_set else hashed_bits(found))
                    lists.append(found.view(np.int64) if with_set else bucket_hashes(found))
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(kept, pa.int64())),
                        pa.array(np.array(nodes, np.uint64).view(np.int64)),
                        pa.array(np.array(prints, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *lists]))),
                    ],
                    ["doc_id", "node", "fp", "hashes"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("node", T.LongType()),
            T.StructField("fp", T.LongType()),
            T.StructField("hashes", T.ArrayType(T.LongType())),
        ]
    )
    return docs.mapInArrow(run, schema)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are near; only pairs of like sizes fetch their sets."""
    size = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    alike = pairs.join(size("a"), "a").join(size("b"), "b").where("5L * least(n_a, n_b) >= 4L * greatest(n_a, n_b)")
    of_a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_b"))
    both = alike.join(of_a, "a").join(of_b, "b")
    shared = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("_a", "_b")).alias("shared"))
    return shared.where(_NEAR).select("a", "b")


def _tree_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that the BK-trees link: through one node of each fingerprint, and with it the others of the fingerprint."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    a = heads.select(F.col("fp").alias("a"), F.col("head").alias("_a"))
    b = heads.select(F.col("fp").alias("b"), F.col("head").alias("_b"))
    apart = near_links(heads).join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return apart.unionByName(same)


def _prefix_pairs(rare: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that a shared shingle early in both may make near.

    ``rare`` has ``node, n, place, token``: the places of the shingles that stand in
    several sets, rarest first.  Of a pair the larger set, or at equal size that of the
    greater node, asks, for each size that its place leaves possible.
    """
    early = rare.where("5L * place <= n").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = early.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high")
    early = cut(early.join(cut(several.select("token")), "token"))
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(_STEP))).cast("int")
    # enough of both is left after the shared shingle: 9 (n - place) >= 4 (n_a + n_b)
    most = F.least(F.col("n"), F.expr("(5L * n - 9L * place) / 4"))
    larger = early.withColumn("_most", most).where("5 * _most >= 4 * n AND _most >= 1")
    asking = larger.select(
        "token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("_of_b"),
        F.explode(F.sequence(step(F.greatest(F.lit(1.0), F.col("n") * 0.8 - 1e-9)), step(F.col("_most") + 1e-9))).alias("class"),
    )
    smaller = early.where("9L * place <= n").select(
        "token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("component").alias("_of_a"), step(F.col("n")).alias("class")
    )
    met = smaller.join(asking, ["token", "class"]).where(
        "_of_a <> _of_b AND (n_a < n_b OR n_a = n_b AND a < b) AND 5L * n_a >= 4L * n_b"
        " AND 9L * least(n_a - place_a, n_b - place_b) >= 4L * (n_a + n_b)"
    )
    return met.select("a", "b").distinct()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``doc_id, component_id`` for every row with an id: components of the links of a Jaccard of 0.8 or more."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_sets(texts, shingle, False)).withColumn("_row", F.monotonically_increasing_id())  # of a checkpoint, so always the same
    # one row stands for a node, so that no array is ever a state of an aggregation
    nodes = cut(rows.groupBy("node", "fp").agg(F.min(F.struct("doc_id", "_row")).alias("_first")).select("node", "fp", F.col("_first.doc_id").alias("least"), F.col("_first._row").alias("_row")))
    trees = cut(_tree_pairs(nodes.select("node", "fp")))
    members = rows.join(nodes.select("_row"), "_row", "left_semi").select("node", F.explode("hashes").alias("bucket"))
    several = members.groupBy("bucket").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).where("_low < _high")
    # counts and pivots are tables of their own, so that joins with them are plain ones whose hot keys the adaptive skew join can split
    met = cut(members.join(cut(several.select("bucket")), "bucket"))
    wanted = met.select("node").unionByName(trees.select(F.col("a").alias("node"))).unionByName(trees.select(F.col("b").alias("node"))).distinct()
    asked = nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("doc_id"), F.col("node").alias("wanted"))
    found = _sets(texts.join(asked, "doc_id").select("doc_id", "text", "wanted"), shingle, True)
    if rows.groupBy("doc_id", "node").agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count():  # rows that repeat an id and a text
        once = F.row_number().over(Window.partitionBy("node").orderBy("doc_id"))
        found = found.withColumn("_once", once).where("_once = 1")
    sets = cut(found.select("node", F.size("hashes").alias("n"), "hashes"))

    # places of the shingles that stand in several sets, behind those that stand in no other
    tokens = sets.select("node", "n", F.explode("hashes").alias("token"))
    counts = cut(tokens.groupBy("token").count().where("count > 1"))
    shared = cut(tokens.join(counts, "token"))
    by_rarity = Window.partitionBy("node").orderBy("count", "token")
    ranked = shared.withColumn("_rank", F.row_number().over(by_rarity)).withColumn("_shared", F.count("*").over(Window.partitionBy("node")))
    rare = ranked.select("node", "n", "token", (F.col("n") - F.col("_shared") + F.col("_rank") - 1).alias("place"), (F.col("n") - F.col("_shared")).alias("alone"))
    rare = cut(rare.where("5L * place <= n OR place = alone"))
    alone = rare.where("place = alone").select("node", F.expr("alone / n").alias("alone"))
    placed = met.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(1.0)))

    # each bucket's nodes against its most usual one, then those that it does not link against the most usual of them
    links, apart = None, placed
    for _ in range(2):
        pivot = apart.groupBy("bucket").agg(F.min(F.struct("alone", "node")).alias("_p"), F.max("node").alias("_high"), F.min("node").alias("_low"))
        pivot = cut(pivot.where("_low < _high").select("bucket", F.col("_p.node").alias("a")))
        asked = cut(apart.join(pivot, "bucket").where("node <> a").select("bucket", "a", F.col("node").alias("b"), "alone"))
        pairs = asked.select("a", "b")
        found = cut(_linked((pairs.unionByName(trees) if links is None else pairs).distinct(), sets))
        links = found if links is None else links.unionByName(found)
        apart = asked.join(found, ["a", "b"], "left_anti").select("bucket", F.col("b").alias("node"), "alone")
    groups = cut(connected_components(links, "a", "b"))
    more = cut(_linked(_prefix_pairs(rare.where("5L * place <= n").select("node", "n", "place", "token"), groups), sets))
    if more.limit(1).count():
        groups = connected_components(links.unionByName(more), "a", "b")

    named = nodes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(names, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def dedup_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; rows without one stay."""
    return keep_named(docs, near_copies(docs, id_col=id_col, text_col=text_col, shingle=shingle), id_col, text_col)
