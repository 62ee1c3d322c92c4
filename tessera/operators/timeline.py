"""Ordered rows: runs, as-of and interval joins, trailing windows, sessions, budgets and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``key, run, value, first, last, n``: stretches of rows with the same value; first and last are of ``order[0]``."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before ``at``, by ``key``; null without one."""
    columns = left.columns
    rows = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    marks = right.select(F.col(key), F.col(at), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*columns, value)


def overlapping(spans: DataFrame, key: str, start: str, end: str, id_col: str, width: int, least: float = 0.6) -> DataFrame:
    """``key, id1, id2, share``: pairs of spans of a key whose overlap is ``least`` of the shorter one or more.

    Spans are dealt into bins of ``width``, so only spans that share a bin meet; a pair is taken in the bin where
    the later one starts.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    a = spans.select(key, F.col(id_col).alias("id1"), F.col(start).alias("s1"), F.col(end).alias("e1"), F.explode(bins).alias("bin"))
    b = spans.select(key, F.col(id_col).alias("id2"), F.col(start).alias("s2"), F.col(end).alias("e2"), F.explode(bins).alias("bin"))
    shared = F.least("e1", "e2") - F.greatest("s1", "s2")
    share = shared / F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"))
    met = a.join(b, [key, "bin"]).where((F.col("id1") < F.col("id2")) & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))
    once = met.where(F.col("bin") == F.floor(F.greatest("s1", "s2") / width))
    return once.select(key, "id1", "id2", F.round(share, 4).alias("share")).where(F.col("share") >= least)


def trailing(rows: DataFrame, key: str, at: str, amount: str, spans: dict[str, int]) -> DataFrame:
    """``rows`` with count and sum of the rows of the last so many seconds, both ends included, for each named span.

    Rows are dealt by key and stretch of time, a stretch as long as the longest span, and a
    stretch sees the one before it besides; so a key of any size is many windows.  A span is what has come up to
    a row less what had come before the span began, so the work grows with the rows and not with the rows
    of a span.  Amounts that are not finite are counted apart, as a difference would not get rid of them.
    """
    width = max(spans.values())
    stretch = F.floor(F.col(at) / width)
    value, no = F.col(amount).cast("double"), F.lit(0.0)
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    out = rows.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_stretch", stretch + F.when(F.col("_own"), 0).otherwise(1))
    sums = {
        "_rows": F.count("*"), "_given": F.count(amount), "_sum": F.sum(F.when(finite, value).otherwise(no)),
        "_nan": F.count_if(F.isnan(value)), "_up": F.count_if(value == float("inf")), "_down": F.count_if(value == -float("inf")),
    }
    by = Window.partitionBy(key, "_stretch").orderBy(at)
    ends = {"_": 0} | {f"_{name}_": -seconds - 1 for name, seconds in spans.items()}
    for end, last in ends.items():
        upto = by.rangeBetween(Window.unboundedPreceding, last)
        out = out.withColumns({f"{end}{c}": F.coalesce(s.over(upto), F.lit(0)) for c, s in sums.items()})
    for name in spans:
        n, given, total, nan, up, down = (F.col(f"_{c}") - F.col(f"_{name}_{c}") for c in sums)
        infinite = F.when((nan > 0) | ((up > 0) & (down > 0)), float("nan")).when(up > 0, float("inf")).when(down > 0, -float("inf"))
        out = out.withColumns({f"n_{name}": n, f"sum_{name}": F.when(given > 0, F.round(F.coalesce(infinite, total), 4))})
    return out.where("_own").drop("_own", "_stretch", *[f"{end}{c}" for end in ends for c in sums])


def debounced(events: DataFrame, at: str, gap: str, *keys: str, **aggregates: Column) -> DataFrame:
    """Bursts of events with less than ``gap`` between them: ``start, end`` and the aggregates, by keys."""
    return (
        events.groupBy(*keys, F.session_window(at, gap).alias("_s"))
        .agg(*[c.alias(n) for n, c in aggregates.items()])
        .select(*keys, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), *aggregates)
    )


def within_budget(messages: DataFrame, session: str, order: str, role: str, text: str, budget: int, pinned: tuple[str, ...] = ("system", "user")) -> DataFrame:
    """Messages kept in a context: pinned roles always, others newest first while their lengths fit what is left."""
    is_pinned = F.col(role).isin(*pinned)
    size = F.length(text)
    whole = Window.partitionBy(session)
    newest = Window.partitionBy(session, is_pinned).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        messages.withColumn("_left", budget - F.sum(F.when(is_pinned, size).otherwise(0)).over(whole))
        .withColumn("_used", F.sum(size).over(newest))
        .where(is_pinned | (F.col("_used") <= F.col("_left")))
    )
    return marked.drop("_left", "_used")


def last_messages(messages: DataFrame, session: str, order: str, role: str, keep: int, always: tuple[str, ...] = ("system",)) -> DataFrame:
    """The last ``keep`` messages of each session; roles in ``always`` stay besides."""
    pinned = F.col(role).isin(*always)
    w = Window.partitionBy(session, pinned).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).where(pinned | (F.col("_n") <= keep)).drop("_n")


def expired(rows: DataFrame, at: str, seconds: int, now: Column) -> DataFrame:
    """Rows older than ``seconds`` at ``now``."""
    return rows.where(F.col(at) < now - seconds)
