"""SentencePiece encoding and decoding with offsets.

``Model`` reads a model file's pieces and its compiled character map.  A text is
normalised by the longest prefix in that map, character by character where the map
has none, and every normalised byte remembers the source byte it came from.  Merges
work inside a segment, a run of word-start marks with what follows up to the next
one, which is exact as long as no piece has a mark behind another character (the
model is checked for that when it is read), and inside it between characters that
stand side by side in some piece; so the pieces of a segment, and of its parts, are
found once and kept in a bounded table.

Defined cases: a null text is the empty text, which has no ids; characters that no
piece covers become the bytes of their UTF-8 form; of pieces with equal scores the
leftmost merge comes first; very long texts are encoded whole, segment by segment, and
a long segment by a heap; rows that repeat a ``doc_id``, or lack it, are encoded one by
one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Segments in a worker's table before it begins a new one; the one before is kept too.
KEPT = 180_000
#: Score of a pair that is no piece.
_NONE = float("-inf")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number and raw value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 prefixes and their replacements."""

    def __init__(self, blob: bytes = b"") -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[start:]`` in the map, and its replacement."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = self._offset(unit)
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[at]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = at + 1 - start, value
        if found is None:
            return None
        length, value = found
        return length, self.replacements[value : self.replacements.index(b"\0", value)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class Model:
    """Pieces, scores and normalisation of a BPE model with byte fallback."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.silent: set[int] = set()
        self.unknown = 0
        self.dummy_prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        kinds: list[int] = []
        model_type, byte_fallback = 1, 0
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                i = len(self.pieces)
                self.pieces.append(piece)
                kinds.append(kind)
                if kind in (_NORMAL, _USER, _UNUSED):
                    self.ids[piece], self.scores[piece] = i, score
                elif kind == _BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = i
                    self.byte_of[i] = int(piece[3:5], 16)
                elif kind == _CONTROL:
                    self.silent.add(i)
                elif kind == _UNKNOWN:
                    self.unknown = i
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        model_type = v
                    elif n == 35:
                        byte_fallback = v
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        self.sizes = [1 if i in self.byte_of else len(p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self._written = [(str(i), p, str(n)) for i, (p, n) in enumerate(zip(self.pieces, self.sizes, strict=True))]
        self.map = CharacterMap(charsmap)
        if model_type != 2 or not byte_fallback or len(self.byte_ids) != 256:
            raise ValueError("a BPE model with byte fallback is needed")
        if any(k in (_USER, _UNUSED) for k in kinds) or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces must be ordinary ones, without a word-start mark behind another character")
        self._joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.segments = _Segments(self)

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source byte where it begins.

        White space at the ends is dropped and runs are made one only if the model says so.
        """
        source = text.encode()
        chunks: list[tuple[bytes, int]] = []
        at = 0
        while at < len(source):
            if (hit := self.map.longest(source, at)) is not None:
                length, piece = hit
            else:
                lead = source[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                piece = source[at : at + length]
            chunks.append((piece, at))
            at += length
        if self.squeeze:
            kept, blank = [], True
            for piece, where in chunks:
                if piece == b" " and blank:
                    continue
                kept.append((piece, where))
                blank = piece.endswith(b" ")
            while kept and kept[-1][0] == b" ":
                kept.pop()
            chunks = kept
        if not chunks:
            return b"", [0]
        mark = MARK.encode() if self.escape else b" "
        out, source_at = bytearray(), []
        if self.dummy_prefix:
            out += mark
            source_at += [chunks[0][1]] * len(mark)
        for piece, where in chunks:
            if b" " not in piece and source.startswith(piece, where):
                source_at += range(where, where + len(piece))  # as it stands: byte by byte
            else:
                piece = piece.replace(b" ", mark)
                source_at += [where] * len(piece)
            out += piece
        return bytes(out), [*source_at, len(source)]

    def _segment_list(self, text: str) -> list[str]:
        if not self.map.units and not self.squeeze and self.escape:
            if not text:
                return []
            normal = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)  # no map: each character is itself
        else:
            normal = self.normalise(text)[0].decode()
        return _SEGMENT.findall(normal)

    def encode_text(self, text: str) -> tuple[str, str, str]:
        """The ids of a text, what they decode to, and how many source bytes each piece stands for.

        Ids and byte counts are decimal, joined by commas.  As the pieces' spans lie side by
        side, the counts say where each begins and ends.
        """
        table = self.segments
        found = [table[s] for s in self._segment_list(text)]
        ids, whole = ",".join([f[0] for f in found]), "".join([f[1] for f in found])
        if self.map.units or self.squeeze or not self.escape or MARK in text:
            sizes = ",".join(str(end - begin) for _, begin, end in self._projected(text, ids))
        elif found and self.dummy_prefix:  # the first mark has no source
            first, comma, rest = found[0][2].partition(",")
            sizes = ",".join([f"{int(first) - 1}{comma}{rest}", *[f[2] for f in found[1:]]])
        else:
            sizes = ",".join([f[2] for f in found])
        return ids, whole[1:] if self.dummy_prefix and whole.startswith(" ") else whole, sizes

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        joined = self.encode_text(text)[0]
        return [int(i) for i in joined.split(",")] if joined else []

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Each piece's id and the source bytes it stands for, begin and end."""
        return self._projected(text, self.encode_text(text)[0])

    def _projected(self, text: str, ids: str) -> list[tuple[int, int, int]]:
        normal, source_at = self.normalise(text)
        out, at = [], 0
        for i in map(int, ids.split(",") if ids else ()):
            size = 1 if i in self.byte_of else len(self.pieces[i].encode())
            out.append((i, source_at[at], source_at[at + size]))
            at += size
        if at != len(normal):
            raise AssertionError("pieces do not cover the normalised text")
        return out

    def text_of(self, ids: list[int]) -> str:
        """The pieces of the ids put together, byte pieces decoded, marks turned into spaces."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def written(self, ids: list[int]) -> tuple[str, str, str]:
        """The ids as text, what they decode to, and the bytes of each piece as text."""
        written = self._written
        if len(ids) == 1 and ids[0] not in self.byte_of and ids[0] not in self.silent:
            name, piece, size = written[ids[0]]
            return name, piece.replace(MARK, " "), size
        names, pieces, sizes = zip(*[written[i] for i in ids], strict=True) if ids else ((), (), ())
        plain = self.byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids)
        return ",".join(names), "".join(pieces).replace(MARK, " ") if plain else self.text_of(ids), ",".join(sizes)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        text = self.text_of(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def merge(self, segment: str) -> list[str]:
        """The segment's symbols after all merges: best score first, leftmost of equals."""
        symbols = list(segment)
        scores = self.scores
        if len(symbols) <= 48:
            pairs = [scores.get(a + b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
            while pairs and (best := max(pairs)) != _NONE:
                i = pairs.index(best)
                symbols[i] += symbols.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = scores.get(symbols[i - 1] + symbols[i], _NONE)
                if i < len(pairs):
                    pairs[i] = scores.get(symbols[i] + symbols[i + 1], _NONE)
            return symbols
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (score := scores.get(pair := symbols[i] + symbols[after[i]])) is not None:
                heapq.heappush(heap, (-score, i, pair))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def parts(self, segment: str) -> list[str]:
        """The segment cut between characters that stand side by side in no piece, so that no merge crosses a cut."""
        if segment.isalpha():
            return [segment]
        joined, out, low = self._joined, [], 0
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in joined:
                out.append(segment[low:i])
                low = i
        out.append(segment[low:])
        return out

    def segment_ids(self, segment: str) -> list[int]:
        """The ids of a segment."""
        out: list[int] = []
        for symbol in self.merge(segment):
            i = self.ids.get(symbol)
            out += [i] if i is not None else [self.byte_ids[b] for b in symbol.encode()]
        return out


_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class _Segments(dict):
    """Ids of a segment, as text, what they decode to, and the bytes of each piece, a mark counted as one.

    Filled on demand; a full table becomes the old one, from which what is still in use is taken over.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.kept = model, KEPT
        self.old: dict[str, tuple[str, str, str]] = {}

    def __missing__(self, segment: str) -> tuple[str, str, str]:
        if (value := self.old.get(segment)) is None:
            parts = self.model.parts(segment)
            if len(parts) > 1:
                found = [self[p] for p in parts]
                value = ",".join([f[0] for f in found]), "".join([f[1] for f in found]), ",".join([f[2] for f in found])
            else:
                value = self.model.written(self.model.segment_ids(segment))
        if len(segment) <= 64:
            if len(self) >= self.kept:
                self.old = self.copy()
                self.clear()
            self[segment] = value
        return value


def _worker_model(docs: DataFrame, model_path: str):
    """A function that gives the model on any worker; Spark carries the file."""
    with open(model_path, "rb") as file:
        data = file.read()
    Model(data)  # an unfit model fails here, before any task runs
    shared = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary file: its size does not follow the data
    return lambda: _from_broadcast(shared)


_MODELS: dict[str, Model] = {}


def _from_broadcast(shared) -> Model:
    data = shared.value
    digest = hashlib.sha256(data).hexdigest()
    if digest not in _MODELS:
        _MODELS.clear()
        _MODELS[digest] = Model(data)
    return _MODELS[digest]


def token_digests(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept: int = KEPT
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, sizes_sha256`` of every whole text, and ``ids`` if asked for.

    ``sizes_sha256`` is the digest of the number of source bytes that each piece stands for.  A worker keeps up to ``kept`` segments with their tokens.
    """
    get = _worker_model(docs, model_path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "sizes_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        model.segments.kept = kept
        for batch in batches:
            counts, ids_hash, text_hash, size_hash, ids = [], [], [], [], []
            for cell in batch.column(1):
                joined, decoded, sizes = model.encode_text(cell.as_py() or "")
                counts.append(joined.count(",") + 1 if joined else 0)
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                size_hash.append(hashlib.sha256(sizes.encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(h, pa.string()) for h in (ids_hash, text_hash, size_hash))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)
        model.segments.old = {}  # an idle worker holds no more than one table

    kinds = [docs.schema[id_col].dataType, T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def tokenised(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, begins, ends``: ids of every whole text and the source bytes of each piece."""
    get = _worker_model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for batch in batches:
            for i, cell in enumerate(batch.column(1)):  # a row a batch: a very long text's arrays stand alone
                spans = model.spans(cell.as_py() or "")
                columns = [pa.array([[s[k] for s in spans]], pa.list_(pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns], ["doc_id", "ids", "begins", "ends"])

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "begins", "ends")]
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
