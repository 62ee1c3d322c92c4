"""The graph store: upserts, appends, merges, cascading deletes, diffs and snapshots over tables of nodes, edges, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by ``order``; columns other than the keys come from one row."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """A bag of edges: the same edge with other metadata stays apart, equal rows are one; weight 1 by default."""
    both = edges.unionByName(more.withColumn("weight", F.coalesce("weight", F.lit(1.0))))
    maps = [f.name for f in both.schema if f.dataType.typeName() == "map"]
    keyed = both.withColumns({f"_{m}": F.to_json(F.array_sort(F.map_entries(m))) for m in maps}) if maps else both
    return keyed.dropDuplicates([f"_{c}" if c in maps else c for c in both.columns]).select(*both.columns)


def merge_metadata(nodes: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with metadata maps merged, the update's value winning."""
    new = updates.select(*keys, F.col("metadata").alias("_new"))
    both = nodes.join(new, keys, "left")
    merged = F.map_from_entries(
        F.concat(
            F.filter(F.map_entries("metadata"), lambda e: ~F.map_contains_key(F.col("_new"), e["key"])), F.map_entries("_new")
        )
    )
    return both.withColumn("metadata", F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(merged)).drop("_new")


def remove_nodes(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the nodes in ``gone`` (``node``): their edges in both directions and vectors go too."""
    kept_edges = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), kept_edges.select(*edges.columns), embeddings.join(gone, "node", "left_anti")


def listed(nodes: DataFrame, node_type: str | None = None, limit: int | None = None, key: str = "node") -> DataFrame:
    """Nodes of a type in order of their key; no limit unless one is given."""
    out = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    return out if limit is None else out.orderBy(key).limit(limit)


def matching(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that have all the wanted values."""
    condition: Column = F.lit(True)
    for column, value in wanted.items():
        condition = condition & (F.col(column) == F.lit(value))
    return rows.where(condition)


def enriched(results: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Results with node data and numbers of callers and callees; unknown nodes keep nulls and zeros."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("callees"))
    joined = results.join(nodes, "node", "left").join(into, "node", "left").join(out, "node", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("callers", "callees")})


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, change``: added, removed or unchanged."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return (
        b.join(a, keys, "left_anti").withColumn("change", F.lit("added"))
        .unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))
        .unionByName(a.join(b, keys, "left_semi").withColumn("change", F.lit("unchanged")))
    )


def stale(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``key, status`` of entities whose hash is not the stored one: new or changed."""
    known = stored.select(key, F.col("hash").alias("_stored"))
    both = current.join(known, key, "left").where(~F.col("hash").eqNullSafe(F.col("_stored")))
    return both.select(key, F.when(F.col("_stored").isNull(), "new").otherwise("changed").alias("status"))


def save_snapshot(tables: dict[str, DataFrame], path: str, model: str, dimensions: int) -> None:
    """Write the tables and a row of metadata under ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(1, model, dimensions)], "version int, model string, dimensions int").write.mode("overwrite").parquet(f"{path}/snapshot_meta")


def load_snapshot(spark: SparkSession, path: str, names: list[str], dimensions: int) -> dict[str, DataFrame] | None:
    """The tables of a snapshot, or None if its vectors have other dimensions."""
    meta = spark.read.parquet(f"{path}/snapshot_meta").first()
    if meta is None or meta.version != 1 or meta.dimensions != dimensions:
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def newest_per(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def find_functions(functions: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``module, name`` of ``wanted`` the function of that name with the smallest arity, if there is one."""
    rest = [c for c in functions.columns if c not in ("module", "name")]
    first = functions.join(wanted.select("module", "name").distinct(), ["module", "name"], "left_semi").groupBy("module", "name").agg(
        F.min_by(F.struct(*rest), F.struct("arity", "fn")).alias("_row")
    )
    return first.select("module", "name", *[F.col("_row")[c].alias(c) for c in rest])


def tracker_stats(status: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of counts over ``path, status`` of tracked files (``new`` ones are not tracked) and ``path`` of their entities.

    Entities of files that changed or were deleted are stale.
    """
    tracked = status.where("status <> 'new'")
    files = tracked.agg(
        F.count("*").alias("total_files"), *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("changed", "unchanged", "deleted")]
    )
    owned = entities.select("path").join(tracked, "path")
    held = owned.agg(F.count("*").alias("total_entities"), F.count_if(F.col("status").isin("changed", "deleted")).alias("stale_entities"))
    return files.join(held)
