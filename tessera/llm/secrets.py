"""Secret scans: fixed patterns, and windows of high Shannon entropy.

Three base kinds come from patterns.  The fourth, ``entropy``, slides a window over
candidate strings, holds the counts of the characters in it and updates the entropy
from the two counts that change at each step; windows above the threshold of the
string's character class are joined into spans.  Allow-listed strings add no spans;
base spans are never suppressed.

Defined cases: a null text is the empty text and has no spans; whole texts are
scanned, in time linear in their length; equal spans of different kinds are all kept,
in the order of the kinds; rows that repeat a ``doc_id``, or lack it, are scanned one by
one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Window length and least entropy in bits, by character class of the candidate.
CLASSES = {"hex": (32, 3.0), "alnum": (20, 3.7), "base64": (20, 3.8)}
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+\Z")
_ALNUM_ONLY = re.compile(r"[0-9A-Za-z]+\Z")
#: Strings that look random and are not secret: UUIDs, dates and times, words joined by dashes, known examples.
#: No form can match a string in two ways, so each is linear in its length.
ALLOWED = re.compile(
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z|[0-9T:+/_=-]+\Z|[A-Za-z]+[-_/=+]+[0-9]{1,4}\Z"
    r"|[a-z]+([-_/][a-z]+|[-_/][0-9]{1,4})*\Z"
)
#: A string that holds one of these is an example.
EXAMPLES = ("EXAMPLE", "example", "0123456789", "abcdefghij")


def candidate_class(text: str) -> str | None:
    """The class that a candidate's characters put it in; None for one without both letters and digits."""
    if not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return None
    return "hex" if _HEX_ONLY.match(text) else "alnum" if _ALNUM_ONLY.match(text) else "base64"


def entropy_spans(text: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Unions of the windows of ``text`` whose entropy is at least ``least`` bits."""
    window = min(window, len(text))
    plogp = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    whole = math.log2(window)
    counts: dict[str, int] = {}
    total = 0.0
    start = end = -1
    for i, new in enumerate(text):
        if i >= window:
            n = counts[old := text[i - window]]
            counts[old] = n - 1
            total += plogp[n - 1] - plogp[n]
        n = counts.get(new, 0)
        counts[new] = n + 1
        total += plogp[n + 1] - plogp[n]
        if i >= window - 1 and whole - total / window >= least:
            low = i - window + 1
            if low > end:
                if end >= 0:
                    yield start, end
                start = low
            end = i + 1
    if end >= 0:
        yield start, end


def scan(text: str, classes: dict[str, tuple[int, float]] = CLASSES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text as ``(start, kind, end)``, in order."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    added = []
    for m in _CANDIDATE.finditer(text):
        if (kind := candidate_class(m[0])) is None or ALLOWED.match(m[0]) or any(x in m[0] for x in EXAMPLES):
            continue
        added += [(m.start() + a, 3, m.start() + b) for a, b in entropy_spans(m[0], *classes[kind])]
    return sorted(base), added


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every text: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, named = [], []
            for cell in batch.column(1):
                base, added = scan(cell.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_named(base).encode()).hexdigest())
                named.append(_named(sorted(base + added)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(named, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
        + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
