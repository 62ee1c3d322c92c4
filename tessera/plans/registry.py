"""All registered queries of the library (without the training-data subpackage)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis_queries, graph_queries, more_queries, retrieval_queries, scope_queries, structure_queries, timeline_queries, vector_queries

MODULES = (vector_queries, graph_queries, retrieval_queries, analysis_queries, timeline_queries, more_queries, scope_queries, structure_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
