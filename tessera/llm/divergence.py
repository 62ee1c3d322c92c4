"""Source divergence audit: how the sources of a language differ in their terms.

Terms are found by iceberg prefix refinement.  One pass over the texts counts, in each
task, the documents of every term and of its byte prefixes of 4, 8, 16, ... bytes; a
document lies in one task, so these counts add up exactly.  Then level by level only
prefixes whose parent is left are summed, and those in fewer than ``min_docs`` documents are
discarded with all that they begin; at the end the complete terms under the prefixes left
are summed, and those of ``min_docs`` documents or more are kept; a term or prefix that has so many
in one task is kept outright.  So the long tail of rare terms never meets in a shuffle by whole
terms, and only the terms that are kept bring their counts along.

Divergences of two groups need only the terms that one of them has: a sum over the different
counts of a group stands for the terms that the other group lacks, and terms of both are
corrected one by one.  All of it is done in whole numbers.

Defined cases: null texts, languages and sources count as ''; a text without terms leaves its
group without counts, not out of the result; every row is a document, also one that repeats
another's id; texts of any length are taken whole; ties of values go to the item first in
UTF-8; an empty table gives an empty result; other columns are ignored, whatever their names.
Numbers are longs: a language may hold up to 5 * 10^8 kept terms; sources are told apart by
hashes of 64 bits.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: p of a group is 1 + floor(SCALE * (count + 1) / (N + V)).
SCALE = 1_000_000_000
#: Bytes of the first level; each further level has twice as many.
FIRST = 4
#: Entries of a task's tables before they are handed on; bounds its memory.
_ENTRIES = 1_200_000
#: Pairs of counts of one term that are worked out at a time.
_PAIRS = 1 << 18
#: Groups of a batch whose pairs are summed in a table of them all.
_DENSE = 1024
#: Counts below it may be scaled in longs.
_NARROW = 9_000_000_000

_TERM = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_ROW = "lang string, level int, key binary, docs long, sources array<long>, counts array<int>"
_SUMS = "lang string, source long, item long, value long"
_GROUP, _COMPLETE = -1, 0


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder; compressed, where a checkpoint is not."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


class _Block:
    """Counts of a part of a task's documents."""

    def __init__(self) -> None:
        self.docs: dict[tuple[bytes, int], Counter] = defaultdict(Counter)
        self.counts: dict[bytes, dict[bytes, Counter]] = defaultdict(dict)
        self.groups: Counter = Counter()

    def add(self, text: bytes, lang: bytes, source: bytes) -> int:
        """Count a document; the number of its different terms."""
        self.groups[lang, source] += 1
        words = text.translate(_TERM).split()
        if not words:
            return 0
        own = set(words)
        of_source = self.counts[lang]
        of_source.setdefault(source, Counter()).update(words)
        self.docs[lang, _COMPLETE].update(own)
        level = FIRST
        while own := {w for w in own if len(w) >= level}:
            self.docs[lang, level].update({w[:level] for w in own})
            level *= 2
        return len(words)

    def entries(self) -> int:
        return sum(map(len, self.docs.values())) + sum(len(c) for by in self.counts.values() for c in by.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The block as rows: groups, prefixes, and complete terms with their counts by source."""
        from xxhash import xxh64_intdigest

        names = ["lang", "level", "key", "docs", "sources", "counts"]

        def batch(lang: list[bytes] | bytes, level: int, keys: list[bytes], docs: np.ndarray, sources: pa.Array | None = None, counts: pa.Array | None = None) -> pa.RecordBatch:
            n = len(keys)
            langs = pa.array(lang if isinstance(lang, list) else [lang] * n, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [
                    langs, pa.array(np.full(n, level, np.int32)), pa.array(keys, pa.binary()), pa.array(docs),
                    pa.nulls(n, pa.list_(pa.int64())) if sources is None else sources, pa.nulls(n, pa.list_(pa.int32())) if counts is None else counts,
                ],
                names,
            )

        if self.groups:
            langs, sources = [g[0] for g in self.groups], [g[1] for g in self.groups]
            hashes = pa.array(np.array([xxh64_intdigest(x) for x in sources], np.uint64).view(np.int64))
            ends = pa.array(np.arange(len(sources) + 1, dtype=np.int32))
            yield batch(langs, _GROUP, sources, np.array(list(self.groups.values()), np.int64), pa.ListArray.from_arrays(ends, hashes))
        for (lang, level), docs in self.docs.items():
            keys, n = list(docs), np.fromiter(docs.values(), np.int64, len(docs))
            if level != _COMPLETE:
                yield batch(lang, level, keys, n)
                continue
            place = dict(zip(keys, range(len(keys)), strict=True)).__getitem__
            by_source = self.counts[lang]
            term = np.concatenate([np.fromiter(map(place, c), np.int32, len(c)) for c in by_source.values()])
            count = np.concatenate([np.fromiter(c.values(), np.int32, len(c)) for c in by_source.values()])
            hashes = np.array([xxh64_intdigest(x) for x in by_source], np.uint64).view(np.int64)
            source = np.repeat(hashes, [len(c) for c in by_source.values()])
            order = np.argsort(term, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(keys)))]).astype(np.int32)
            sources, counts = (pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (source, count))
            for low in range(0, len(keys), 50_000):
                cut = slice(low, low + 50_000)
                yield batch(lang, level, keys[cut], n[cut], sources[cut], counts[cut])


def term_blocks(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, level, key, docs, sources, counts`` of each block of documents.

    Level -1 has the groups (key: the source, and its hash), level 0 complete terms with the counts
    by hashes of sources, the others the prefixes of so many bytes; docs are the block's documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, room = _Block(), _ENTRIES
        for rows in batches:
            for cells in zip(*(c.cast(pa.binary()) for c in rows.columns), strict=True):
                room -= block.add(*[x.as_py() or b"" for x in cells])
                if room <= 0 and (room := _ENTRIES - block.entries()) < _ENTRIES // 10:
                    yield from block.batches()
                    block, room = _Block(), _ENTRIES
        yield from block.batches()

    named = docs.select(*[F.col(c).cast("string") for c in (text_col, lang_col, source_col)])
    return named.mapInArrow(run, _ROW)


def kept_terms(blocks: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term`` of the complete terms that are kept."""
    prefixes = blocks.where(F.col("level") > 0).select("lang", "level", "key", "docs")
    longest = prefixes.agg(F.max("level")).first()[0] or 0
    left, parents, level = [], None, FIRST
    while level <= longest:
        rows = prefixes.where(F.col("level") == level)
        if parents is not None:  # only under prefixes that are left
            rows = rows.withColumn("_parent", F.substring("key", 1, level // 2)).join(parents, ["lang", "_parent"], "left_semi")
        found = stored(rows.groupBy("lang", "key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "key"))
        left.append(found.select("lang", F.lit(level).alias("_level"), F.col("key").alias("_prefix")))
        parents = found.withColumnRenamed("key", "_parent")
        level *= 2
    terms = blocks.where(F.col("level") == _COMPLETE).select("lang", F.col("key").alias("term"), "docs")
    size, many = F.octet_length("term"), F.col("docs") >= min_docs
    if left:
        reached = F.lit(0)
        for at in (FIRST * 2**i for i in range(len(left))):
            reached = F.when(size >= at, at).otherwise(reached)
        whole = left[0]
        for more in left[1:]:
            whole = whole.unionByName(more)
        under = terms.where((size >= FIRST) & ~many).withColumn("_level", reached).withColumn("_prefix", F.expr("substring(term, 1, _level)"))
        terms = terms.where((size < FIRST) | many).unionByName(under.join(whole, ["lang", "_level", "_prefix"], "left_semi").select(*terms.columns))
    return terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(many).select("lang", "term")


def _p(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / whole), by decimals where longs do not hold it."""
    wide = F.lit(SCALE).cast("decimal(20,0)") * (count + 1).cast("decimal(18,0)")
    narrow = F.call_function("div", F.lit(SCALE) * (count + 1), whole)
    return 1 + F.when(count < _NARROW, narrow).otherwise(F.call_function("div", wide, whole.cast("decimal(18,0)")))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _coded(lang: pa.Array, source: np.ndarray, size: np.ndarray) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The different groups of rows of terms with ``size`` sources each, and the place of each source's group among them."""
    langs = lang.dictionary_encode()
    sources, of_source = np.unique(source, return_inverse=True)
    group, code = np.unique(np.repeat(langs.indices.to_numpy().astype(np.int64), size) * len(sources) + of_source, return_inverse=True)
    names = langs.dictionary.to_pylist()
    return [(names[g // len(sources)], int(sources[g % len(sources)])) for g in group.tolist()], code


def _pair_sums(group: list[tuple[str, int]], code: np.ndarray, size: np.ndarray, p: np.ndarray, zero: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``lang, source, item, value`` over the terms of both sources; a term's sources stand together, ``size`` of them for each term.

    For such a term the sums over counts have f(p_i, q0) and f(p0, q_j) in place of f(p_i, q_j), and once
    less f(p0, q0); ``value`` is the difference.
    """
    n, starts, squares = len(group), np.cumsum(size) - size, np.cumsum(size**2)
    f = lambda a, b: (a - b) ** 2 // b

    def batch(pairs: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        a, b = [group[i] for i in (pairs // n).tolist()], [group[i] for i in (pairs % n).tolist()]
        columns = [pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.int64()), pa.array([x[1] for x in b], pa.int64()), pa.array(sums)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])

    total = np.zeros(n * n, np.int64) if n <= _DENSE else None
    low = 0
    while low < len(size):
        high = max(int(np.searchsorted(squares, (squares[low - 1] if low else 0) + _PAIRS, "right")), low + 1)
        m, head = size[low:high], starts[low:high]
        own = np.repeat(np.arange(head[0], head[-1] + m[-1]), np.repeat(m, m))
        begin = np.repeat(np.cumsum(m * m) - m * m, m * m)
        other = np.repeat(head, m * m) + (np.arange(len(own)) - begin) % np.repeat(m, m * m)
        i, j = own[own != other], other[own != other]
        pairs, values = code[i] * n + code[j], f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
        if total is None:
            met, at = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(met), np.int64)
            np.add.at(sums, at, values)
            yield batch(met, sums)
        else:
            np.add.at(total, pairs, values)
        low = high
    if total is not None:
        met = np.flatnonzero(total)
        yield batch(met, total[met])


def _both_terms(counts: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """``lang, source, item, value`` of ``_pair_sums``; few groups go to the tasks, many are joined."""
    several = counts.where(F.size("sources") > 1)
    if few:
        known = {(r.lang, r.source): (r.n_all + r.v, r.p0) for r in groups.select("lang", "source", "n_all", "v", "p0").collect()}

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, n = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64), batch.column(2).flatten().to_numpy()
                group, code = _coded(batch.column(0), batch.column(1).flatten().to_numpy(), size)
                whole, zero = np.array([known[g] for g in group], np.int64).reshape(-1, 2)[code].T
                if n.size and n.max() >= _NARROW:
                    p = 1 + (SCALE * (n.astype(object) + 1) // whole).astype(np.int64)
                else:
                    p = 1 + SCALE * (n + 1) // whole
                yield from _pair_sums(group, code, size, p, zero)

        return several.select("lang", "sources", "counts").mapInArrow(looked_up, _SUMS)

    flat = several.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("_e"))
    flat = flat.select("lang", "term", F.col("_e.sources").alias("source"), F.col("_e.counts").alias("n"))
    placed = flat.join(groups.select("lang", "source", "n_all", "v", "p0"), ["lang", "source"])
    entry = F.struct("source", _p(F.col("n"), F.col("n_all") + F.col("v")).alias("p"), "p0")
    again = placed.groupBy("lang", "term").agg(F.collect_list(entry).alias("_e"))  # a row for each source of the term
    again = again.select("lang", F.col("_e.source").alias("sources"), F.col("_e.p").alias("p"), F.col("_e.p0").alias("p0"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            source, p, zero = (c.flatten().to_numpy() for c in batch.columns[1:])
            yield from _pair_sums(*_coded(batch.column(0), source, size), size, p, zero)

    return again.mapInArrow(joined, _SUMS)


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, small: int = 50_000
) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources of a language, and the ``top`` terms of each source against its language.

    Up to ``small`` groups are broadcast, counted beforehand; more are joined.
    """
    blocks = stored(term_blocks(docs, text_col=text_col, lang_col=lang_col, source_col=source_col))
    complete = blocks.where(F.col("level") == _COMPLETE).select("lang", F.col("key").alias("term"), "sources", "counts")
    held = complete.join(kept_terms(blocks, min_docs), ["lang", "term"], "left_semi")
    entry = held.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("_e"))
    summed = entry.groupBy("lang", "term", F.col("_e.sources").alias("source")).agg(F.sum("_e.counts").alias("n"))
    of_term = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("_e"))  # a row for each source
    counts = stored(of_term.select("lang", "term", F.col("_e.source").alias("sources"), F.col("_e.n").alias("counts")))

    # of each group N, the number of its terms, and V and N of the language
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    flat = counts.select("lang", "term", total.alias("total"), F.posexplode(F.arrays_zip("sources", "counts")).alias("_i", "_e"))
    flat = flat.select("lang", "term", "total", (F.col("_i") == 0).alias("first"), F.col("_e.sources").alias("source"), F.col("_e.counts").alias("n"))
    by_count = stored(flat.groupBy("lang", "source", "n").agg(F.count("*").alias("times"), F.count_if("first").alias("firsts")))
    sums = by_count.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("n_all"), F.sum("times").alias("n_terms"), F.sum("firsts").alias("firsts"))
    found = blocks.where(F.col("level") == _GROUP).select("lang", F.col("key").cast("string").alias("name"), F.col("sources")[0].alias("source")).distinct()
    groups = found.join(sums, ["lang", "source"], "left").na.fill(0)
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("n_all").alias("n_lang"))
    groups = stored(groups.join(langs, "lang").drop("firsts").withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("n_all") + F.col("v")))))
    few = groups.count() <= small
    known = groups.select("lang", "source", "n_all", "v", "n_lang", "name")
    known = F.broadcast(known) if few else known

    # pairs: by the different counts of either side, then terms of both
    placed = by_count.join(known, ["lang", "source"]).select("lang", "source", _p(F.col("n"), F.col("n_all") + F.col("v")).alias("p"), "times")
    one = groups.select("lang", "source", "v", "n_terms", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("n_terms").alias("n_item"), F.col("p0").alias("q0"))
    pairs = one.join(other, "lang").where("source <> item")
    neither = F.col("v") - F.col("n_terms") - F.col("n_item")
    base = pairs.select("lang", "source", "item", F.coalesce(neither * _f(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    asked = placed.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("times") * _f(F.col("p"), F.col("q0"))).alias("value"))
    items = placed.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "times")
    against = items.join(one, "lang").where("source <> item").select("lang", "source", "item", (F.col("times") * _f(F.col("p0"), F.col("q"))).alias("value"))
    parts = base.unionByName(asked).unionByName(against).unionByName(_both_terms(counts, groups, few))
    names = groups.select("lang", "source", "name")
    paired = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).join(names, ["lang", "source"])
    paired = paired.join(names.select("lang", F.col("source").alias("item"), F.col("name").alias("_item")), ["lang", "item"])
    paired = paired.select("lang", F.col("name").alias("source"), F.lit("pair").alias("part"), F.col("_item").alias("item"), "value")

    # terms: against the language
    measured = flat.join(known, ["lang", "source"]).withColumns({"p": _p(F.col("n"), F.col("n_all") + F.col("v")), "q": _p(F.col("total"), F.col("n_lang") + F.col("v"))})
    termed = measured.where("p > q").select("lang", F.col("name").alias("source"), F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    first_terms = termed.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns)
    return paired.withColumn("rank", rank).select(*columns).unionByName(first_terms)
