"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and a sentence longer than ``max_words`` at places that
the words around them choose, so that a passage gives the same units wherever it
stands: a cut depends on nothing but the seven gaps between words around it.
Every run of ``run`` consecutive units is hashed; runs are joined on the hash over all
documents, and units covered by any repeated span that is not the first one go.  The
first span is the one in the document with the smallest id, and within it the earliest.
Only ids and hashes are shuffled until the result: per hash the least and the greatest
document id say whether it repeats, which partial sums keep small for the most frequent
passage.

Defined cases: null and empty texts have no units and stay as they are; a text with
fewer units than a run is one run; a document without ``doc_id`` is known by a hash of
its text; ids may be numbers or text, which is ordered as text; rows that repeat a
``doc_id`` and text are one document and are treated alike, and texts that share a
``doc_id`` are documents of their own, in the order of their hashes; white space and
case do not tell runs apart; a very long text is cut as a whole, and its runs leave in
blocks; an empty table gives an empty result; other columns are carried, whatever their
names.  The hash has 64 bits: among n different runs about n^2 / 2^65 pairs are taken
for equal.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .keys import document_key

_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")


#: A long sentence is cut between two words whose hash is not above those of so many gaps on either side.
_NEAR = 3
#: Runs in a batch.
_ROWS = 100_000


def _ends(words: list[str]) -> Iterator[int]:
    """Where the units of a long sentence end, counted in words."""
    gaps = [zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(words, words[1:], strict=False)]
    for i in range(_NEAR, len(gaps) - _NEAR):
        if gaps[i] <= gaps[i - 1] and gaps[i] <= min(gaps[i - _NEAR : i + _NEAR + 1]):
            yield i + 1
    yield len(words)


def units(text: str, max_words: int = 16) -> Iterator[tuple[int, int, list[str]]]:
    """Begin, end and lower-case words of each unit; the units lie side by side."""
    start = 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[start:end].lower().split()
        if not words:
            continue  # white space goes to the next unit
        if len(words) <= max_words:
            yield start, end, words
        else:
            at = start
            pieces = [start + m.end() for m in _WORD.finditer(text[start:end])]
            first = 0
            for last in _ends(words):
                stop = end if last == len(words) else pieces[last - 1]
                yield at, stop, words[first:last]
                at, first = stop, last
        start = end


def run_hashes(text: str, run: int = 3, max_words: int = 16) -> list[int]:
    """Hash of the run that begins at each unit."""
    from xxhash import xxh3_64_intdigest

    joined = [" ".join(w) for _, _, w in units(text, max_words)]
    width = min(run, len(joined))
    return [xxh3_64_intdigest("\n".join(joined[i : i + width])) for i in range(len(joined) - width + 1)] if joined else []


def _runs(docs: DataFrame, id_col: str, text_col: str, run: int, max_words: int) -> DataFrame:
    """``d, t, pos, h``: every run; ``pos`` is ``-1 - place`` if its document has it at an earlier place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                of = pa.array(np.concatenate(rows))
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes))],
                    ["d", "t", "pos", "h"],
                )

            for i, cell in enumerate(batch.column(2)):
                h = np.array(run_hashes(cell.as_py() or "", run, max_words), np.uint64).view(np.int64)
                pos = -1 - np.arange(len(h), dtype=np.int32)
                first = np.unique(h, return_index=True)[1]
                pos[first] = first
                for low in range(0, len(h), _ROWS):  # a very long text leaves in blocks
                    part = slice(low, low + _ROWS)
                    rows.append(np.full(len(h[part]), i, np.int32))
                    places.append(pos[part])
                    hashes.append(h[part])
                    size += len(h[part])
                    if size >= _ROWS:
                        yield flush()
                        rows, places, hashes, size = [], [], [], 0
            if size:
                yield flush()

    key = document_key(docs, id_col, text_col)
    keyed = docs.select(key.alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [T.StructField("d", keyed.schema["d"].dataType), T.StructField("t", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("h", T.LongType())]
    )
    return keyed.mapInArrow(emit, schema)


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = 3, max_words: int = 16) -> DataFrame:
    """``d, t, pos``: the runs that are not the first of their kind; ``d, t`` are document key and text hash."""
    runs = cut(_runs(docs, id_col, text_col, run, max_words))
    own = runs.where("pos >= 0")
    # a table of its own, so that the join below is a plain one whose hot keys the adaptive skew join can split
    shared = cut(own.groupBy("h").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("h", "first"))
    gone = own.join(shared, "h").where("first < d").select("d", "t", "pos")
    gone = gone.unionByName(runs.where("pos < 0").select("d", "t", F.expr("-1 - pos").alias("pos")))
    key = document_key(docs, id_col, text_col).alias("d")
    several = docs.select(key, F.xxhash64(text_col).alias("t")).groupBy("d").agg(F.min("t").alias("least"), F.max("t").alias("_most"))
    several = cut(several.where("least < _most").select("d"))
    if several.limit(1).count():  # texts that share an id: the first one is that of the smallest hash
        inside = own.join(several, "d", "left_semi")
        heads = cut(inside.groupBy("h", "d").agg(F.min("t").alias("head")))
        gone = gone.unionByName(inside.join(heads, ["h", "d"]).where("head < t").select("d", "t", "pos"))
    return gone


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = 3, max_words: int = 16) -> DataFrame:
    """``docs`` without the sentences that a repeated span covers, plus ``_units_removed``."""
    repeated = repeated_runs(docs, id_col=id_col, text_col=text_col, run=run, max_words=max_words)
    gone = repeated.groupBy("d", "t").agg(F.collect_set("pos").alias("_gone"))
    columns = [c for c in docs.columns if c != "_units_removed"]
    numbered = [f"c{i}" for i in range(len(columns))]  # no column of the documents meets one of the keys
    keys = [document_key(docs, id_col, text_col).alias("_d"), F.xxhash64(text_col).alias("_t")]
    keyed = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, numbered, strict=True)], *keys)
    joined = keyed.join(gone.withColumnsRenamed({"d": "_d", "t": "_t"}), ["_d", "_t"], "left").select(*numbered, "_gone")
    place = columns.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_gone = [], []
            for cell, gone_at in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                text = cell.as_py()
                starts = gone_at.as_py()
                if not starts:
                    texts.append(text)
                    n_gone.append(0)
                    continue
                found = list(units(text, max_words))
                covered = {at for i in starts for at in range(i, min(i + run, len(found)))}
                texts.append("".join(text[a:b] for at, (a, b, _) in enumerate(found) if at not in covered).rstrip())
                n_gone.append(len(covered))
            carried = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(n_gone, pa.int64())], [*columns, "_units_removed"])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("_units_removed", T.LongType())])
    return joined.mapInArrow(rebuild, schema)
