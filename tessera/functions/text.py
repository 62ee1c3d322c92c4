"""Name similarity, context text and compaction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity of two strings: 1 for equal ones, 0 if they share no character near enough."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    met_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                met_a.append(c)
                break
    if not met_a:
        return 0.0
    met_b = [c for c, t in zip(b, taken, strict=True) if t]
    m, swapped = len(met_a), sum(x != y for x, y in zip(met_a, met_b, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def context_text(title: Column, body: Column, max_length: int = 8000) -> Column:
    """A heading and a body as one text, cut at ``max_length`` characters; a missing part is left out."""
    return F.left(F.concat_ws("\n", F.concat(F.lit("## "), title), body), F.lit(max_length))


def compact(values: Column, limit: int = 10) -> Column:
    """The first ``limit`` elements of an array and, if there are more, how many are left out."""
    more = F.concat(F.lit("... "), (F.size(values) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(values) > limit, F.array_append(F.slice(values, 1, limit), more)).otherwise(values)


def compact_first(first: Column, n: Column, limit: int = 10) -> Column:
    """As ``compact``, of ``n`` elements of which only the first ``limit`` are at hand."""
    more = F.concat(F.lit("... "), (n - limit).cast("string"), F.lit(" more"))
    return F.when(n > limit, F.array_append(F.slice(first, 1, limit), more)).otherwise(first)


def token_estimate(value: Column) -> Column:
    """About how many tokens a struct takes as JSON: a fourth of its bytes."""
    return F.floor(F.octet_length(F.to_json(value)) / 4)
