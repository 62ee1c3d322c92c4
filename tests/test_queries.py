"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


#: Queries that the smallest tables give no row; all have rows on the next larger ones.
EMPTY = {"jaro_names", "name_conflicts", "string_literals"}


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def value(x):
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        return repr(x.tolist()) if hasattr(x, "tolist") else repr(x)

    return sorted(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(name, spark, sf_dir, duck):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    answer = duck.execute(registry.ORACLE[name])
    want = pd.DataFrame(answer.fetchall(), columns=[c[0] for c in answer.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    assert len(got) > 0 or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_call_graph_has_parts_and_ends(spark, sf_dir):
    for name, column in (("components", "component"), ("label_propagation", "label"), ("communities", "community")):
        assert len({r[column] for r in registry.QUERIES[name](spark, sf_dir).collect()}) > 10, name
