"""A key for documents that may lack an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The id; without one a hash of the text, so made that documents with an id come first.

    An id that is a whole number stays a long, with hashes above 2^62; any other id is
    taken as text behind a 0, with hashes behind a 1.
    """
    text = F.col(text_col)
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        without = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)
        return F.coalesce(F.col(id_col).cast("long"), without)
    named = F.concat(F.lit("0"), F.col(id_col).cast("string"))
    return F.coalesce(named, F.concat(F.lit("1"), F.hex(F.xxhash64(text))))
