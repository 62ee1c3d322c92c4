"""Streaming forms of the event operators: bursts, counters, trailing windows, sessions, incremental refresh.

Sources are files or any other streaming DataFrame.  Event times must be TIMESTAMP;
``event_stream`` casts the given tables' TIMESTAMP_NTZ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import cut, ensure_checkpoint_dir

# Extensions of the files that a watcher follows.
WATCHED = (".ex", ".exs", ".erl", ".hrl", ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs")


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream, ``ts`` as a TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def changed_files(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of changes (``ts, project, path, kind``) with less than ``gap`` between them, over all files of a project.

    Gives ``project, start, end, paths``.
    """
    suffix = F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)
    kept = changes.where(F.col("kind").isin("created", "modified") & suffix.isin(*WATCHED))
    return (
        kept.withWatermark("ts", late)
        .groupBy("project", F.session_window("ts", gap).alias("w"))
        .agg(F.array_sort(F.collect_set("path")).alias("paths"))
        .select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths")
    )


def counters(events: DataFrame, name: str = "event_type", amount: str = "value") -> DataFrame:
    """Running count, sum and last time by name."""
    return events.groupBy(name).agg(F.count("*").alias("n"), F.round(F.sum(amount), 4).alias("total"), F.max("ts").alias("last"))


def sliding_usage(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Requests and amounts of each name in sliding windows; rows later than ``late`` are out of every window."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width, step).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def user_sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user that end after ``gap`` without an event."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def refresh(stream: DataFrame, stored: Callable[[], DataFrame], key: str, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that gives ``apply`` only the rows of each batch whose ``hash`` is not the stored one."""

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "ts").alias("_row")).select(key, "_row.*")
        known = stored().select(key, F.col("hash").alias("_hash"))
        apply(last.join(known, key, "left").where(~F.col("hash").eqNullSafe(F.col("_hash"))).drop("_hash"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is and return its result, checkpointed; the stream's own folder is removed."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = cut(spark.read.schema(stream.schema).parquet(f"{folder}/rows"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return rows
