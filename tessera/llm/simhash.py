"""SimHash near-dedup with BK-trees.

Fingerprints come from whole texts.  Equal fingerprints are one node.  Two
fingerprints within ``radius`` bits agree in one of ``radius + 1`` bands, so the
nodes are dealt into a shard for each band and value; a shard too large for one
tree is dealt again by the bands of its remaining bits, which loses no link.  Each
task builds the BK-trees of its shards one after another (a shard's tree goes only
to the tasks that hold its queries: all trees together would grow with the data,
so they are shuffled by shard instead of broadcast whole) and follows only edges
within the radius.  A shard reports a spanning forest of its links, at most one row
for each node and shard, so a group of near copies never becomes all its pairs.
Components are then found over all forests.

Defined cases: a null or empty text, and one without words, has fingerprint zero
and links like any other; fewer words than a shingle make one shingle; a null
``doc_id`` gets a fingerprint and takes part, but names no component; rows that
repeat a ``doc_id`` each get a row; a very long text is hashed in blocks; other columns
are ignored, and carried by ``dedup_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..session import cut

BITS = 64
#: Shingles whose bits are added at a time; bounds the memory of a very long text.
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text: bit set where over half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    digests = map(partial(xxh64_intdigest, seed=seed), shingles)
    return _majority((np.fromiter(digests, np.uint64, min(_BLOCK, n - start)) for start in range(0, n, _BLOCK)), n)


def _majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The bits that over half of ``n`` hashes have."""
    ones = np.zeros(BITS, np.int64)
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def hashed_bits(hashes: np.ndarray) -> int:
    """SimHash of a text whose shingles are hashed already; 0 for none."""
    return _majority((hashes[start : start + _BLOCK] for start in range(0, len(hashes), _BLOCK)), len(hashes))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class BKTree:
    """Integers by Hamming distance: a child's key is its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Put in a value that is not there yet."""
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        if not node:
            return
        at = 0
        while True:
            edge = (self.values[at] ^ value).bit_count()
            if (below := self.children[at].get(edge)) is None:
                self.children[at][edge] = node
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` away."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            below = children[at]
            if len(below) > 2 * radius + 1:
                todo.extend(below[e] for e in range(distance - radius, distance + radius + 1) if e in below)
            else:
                todo.extend(node for e, node in below.items() if -radius <= e - distance <= radius)
        return found


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct values, by a BK-tree grown value by value."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        parent.append(i)
        for j in tree.within(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield value, values[j]
        tree.add(value)


def _deal(nodes: DataFrame, width: int, bands: int) -> DataFrame:
    """Rows of ``fp, shard, rest`` for each band of the ``bands * width`` bits in ``rest``."""
    mask = (1 << width) - 1
    dealt = []
    for b in range(bands):
        low, high = b * width, (b + 1) * width
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit(mask))
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", high), low) if b < bands - 1 else F.lit(0).cast("long")
        shard = F.shiftleft(F.col("shard") * bands + b, width).bitwiseOR(value)
        dealt.append(F.struct(shard.alias("shard"), above.bitwiseOR(below).alias("rest")))
    return nodes.withColumn("_d", F.explode(F.array(*dealt))).select("fp", F.col("_d.shard").alias("shard"), F.col("_d.rest").alias("rest"))


def near_links(nodes: DataFrame, radius: int = 3, max_shard: int = 4096) -> DataFrame:
    """Links ``a, b`` among the distinct fingerprints ``fp`` that join exactly what lies within ``radius``.

    A shard of over ``max_shard`` nodes is dealt again by its remaining bits, twice at most
    (64 bits: 16 of 64, then 12 of 48, then 9 of 36); what is left shares 37 bits and is one tree.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be between 0 and 3")
    bands = 4
    level = _deal(nodes.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest")), 16, bands)
    found = []
    for depth, width in enumerate((12, 9, 0)):
        crowded = cut(level.groupBy("shard").count().where(F.col("count") > max_shard).select("shard"))
        last = width == 0 or crowded.limit(1).count() == 0
        found.append((level if last else level.join(crowded, "shard", "left_anti")).select("shard", "fp", F.lit(depth).alias("depth")))
        if last:
            break
        level = _deal(level.join(crowded, "shard", "left_semi").select("fp", "shard", "rest"), width, bands)
    shards = found[0]
    for more in found[1:]:
        shards = shards.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(values: list[int]) -> pa.RecordBatch | None:
            if len(values) < 2:
                return None
            if not (links := list(shard_links(values, radius))):
                return None
            pairs = np.array(links, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[int] = []
        key = None
        for batch in batches:
            depth, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            edges = np.flatnonzero((depth[1:] != depth[:-1]) | (shard[1:] != shard[:-1])) + 1
            starts = [0, *edges.tolist(), len(fp)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if lo == hi:
                    continue
                at = (int(depth[lo]), int(shard[lo]))
                if at != key:
                    if (out := flush(held)) is not None:
                        yield out
                    held, key = [], at
                held += fp[lo:hi]
        if (out := flush(held)) is not None:
            yield out

    sorted_shards = (
        shards.select("depth", "shard", "fp").repartition("depth", "shard").sortWithinPartitions("depth", "shard", "fp")
    )
    return sorted_shards.mapInArrow(run, "a long, b long")


def near_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, max_shard: int = 4096
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; a component is named by its smallest ``doc_id``."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_links(nodes, radius, max_shard)
    groups = connected_components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("group"))
    # a group's members are counted by partial sums, so a group of any size meets as one row a task
    grouped = cut(nodes.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    names = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "group").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest ``doc_id``.

    Rows that repeat a ``doc_id`` are one document and keep one row, the first by
    its text; rows without a ``doc_id`` cannot be named as copies and stay.
    """
    return keep_named(docs, near_components(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius), id_col, text_col)


def keep_named(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents that name a component of ``found``, one row each, and the rows without an id."""
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi")
    rest = [text_col, *[c for c in docs.columns if c not in (id_col, text_col)]]
    ordered = [c for c in rest if not re.search("map|variant", docs.schema[c].dataType.simpleString())]
    first = F.min(F.struct(*rest)) if ordered == rest else F.min_by(F.struct(*rest), F.struct(*ordered))
    one = named.groupBy(id_col).agg(first.alias("_row"))
    one = one.select(*[F.col(id_col) if c == id_col else F.col("_row")[c].alias(c) for c in docs.columns])
    return one.unionByName(docs.where(F.col(id_col).isNull()))


def fingerprint_hex(fp: Column) -> Column:
    """A signed long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
