"""Other inputs as tables: symbol indexes, commit logs, blame, golden query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX_SCHEMA = (
    "documents array<struct<relativePath: string, language: string, symbols: array<struct<symbol: string, documentation: array<string>>>, "
    "occurrences: array<struct<symbol: string, symbolRoles: int, range: array<int>>>>>"
)
GOLDEN_SCHEMA = "query string, relevant array<struct<type: string, id: string, grade: int>>"


def symbol_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols ``path, language, symbol, name, doc`` and occurrences ``path, symbol, line, is_definition`` of a JSON index."""
    docs = spark.read.schema(INDEX_SCHEMA).option("multiLine", "true").json(path).select(F.inline("documents"))
    name = F.regexp_extract("s.symbol", r"([A-Za-z_]\w*)[().#:/]*$", 1)
    symbols = docs.select(F.col("relativePath").alias("path"), "language", F.explode("symbols").alias("s")).select(
        "path", "language", F.col("s.symbol").alias("symbol"), name.alias("name"), F.array_join("s.documentation", "\n").alias("doc")
    )
    seen = docs.select(F.col("relativePath").alias("path"), F.explode("occurrences").alias("o")).select(
        "path", F.col("o.symbol").alias("symbol"), (F.get("o.range", F.lit(0)) + 1).alias("line"),
        (F.coalesce("o.symbolRoles", F.lit(0)).bitwiseAND(F.lit(1)) == 1).alias("is_definition"),
    )
    return symbols, seen


def symbol_calls(symbols_seen: DataFrame) -> DataFrame:
    """``src, dst``: references, from the symbol last defined at or before their line in the same file."""
    w = Window.partitionBy("path").orderBy("line", F.desc("is_definition")).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("is_definition"), F.col("symbol")), ignorenulls=True).over(w)
    return symbols_seen.withColumn("src", owner).where(~F.col("is_definition") & F.col("src").isNotNull()).select("src", F.col("symbol").alias("dst")).distinct()


def commits(log: DataFrame) -> DataFrame:
    """``sha, author, email, date, subject, files`` of log text in column ``value``, a commit a row.

    A row holds sha, author, email, ISO date and subject, parted by the unit separator,
    and then a line ``STATUS<tab>path`` for each file.
    """
    head = F.split(F.split("value", "\n")[0], "\x1f")
    lines = F.filter(F.split("value", "\n"), lambda x: F.contains(x, F.lit("\t")))
    files = F.transform(lines, lambda x: F.struct(F.element_at(F.split(x, "\t"), -1).alias("path"), F.substring(x, 1, 1).alias("status")))
    return log.select(
        head[0].alias("sha"), head[1].alias("author"), head[2].alias("email"), F.try_to_timestamp(head[3]).alias("date"), head[4].alias("subject"), files.alias("files")
    )


def changed_files(history: DataFrame, statuses: str = "ACMR") -> DataFrame:
    """``commit, file, status, author, date``: a row for each file that a commit touches with one of the statuses."""
    rows = history.select("sha", "author", "date", F.explode("files").alias("f"))
    return rows.where(F.col("f.status").isin(*statuses)).select(F.col("sha").alias("commit"), F.col("f.path").alias("file"), F.col("f.status").alias("status"), "author", "date")


def file_owners(touched: DataFrame, now: Column) -> DataFrame:
    """``file, last_author, age_days, commits`` of each file."""
    by = touched.groupBy("file").agg(F.max_by("author", "date").alias("last_author"), F.max("date").alias("last"), F.count("*").alias("commits"))
    return by.select("file", "last_author", F.datediff(now, "last").alias("age_days"), "commits")


def blame_runs(blame: DataFrame) -> DataFrame:
    """``file, sha, author, first, last, n``: stretches of lines (``file, line, sha, author``) from one commit."""
    w = Window.partitionBy("file").orderBy("line")
    new = F.when(F.lag("sha").over(w) == F.col("sha"), 0).otherwise(1)
    runs = blame.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("file", "_run", "sha").agg(F.first("author").alias("author"), F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).drop("_run")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, id, grade`` of a JSON list of queries with their relevant items; grades are 1 by default."""
    rows = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", "true").json(path)
    return rows.select(F.col("query").alias("query_id"), F.explode("relevant").alias("r")).select("query_id", F.concat_ws(":", "r.type", "r.id").alias("id"), F.coalesce("r.grade", F.lit(1)).alias("grade"))


REQUEST_SCHEMA = "number int, title string, state string, mergeCommit struct<oid: string>, comments array<struct<path: string, line: int, body: string>>"


def pull_requests(rows: DataFrame, known: int = 0) -> tuple[DataFrame, DataFrame]:
    """Requests ``number, title, state, sha`` and comments ``number, path, line, body`` of JSON text in ``value``, a request a row.

    Only numbers above ``known`` count, as the rest were read before.
    """
    parsed = rows.select(F.from_json("value", REQUEST_SCHEMA).alias("r")).where(F.col("r.number") > known).select("r.*")
    requests = parsed.select("number", "title", "state", F.col("mergeCommit.oid").alias("sha"))
    return requests, parsed.select("number", F.inline("comments"))


def blame_requests(blame: DataFrame, requests: DataFrame) -> DataFrame:
    """Blamed lines (any columns, ``sha`` among them) with ``pr_number, pr_title`` of the request that their commit merged; null without one."""
    merged = requests.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.min_by(F.struct("number", "title"), "number").alias("_r"))
    return blame.join(merged, "sha", "left").select(*blame.columns, F.col("_r.number").alias("pr_number"), F.col("_r.title").alias("pr_title"))
