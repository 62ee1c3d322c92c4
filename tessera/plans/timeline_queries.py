"""Queries over events, conversations and orders as timelines, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as t
from ..sources.tables import table
from ..streaming import events as streams
from ..streaming import limits

#: Prices of a thousand prompt and completion tokens by event type.
PRICES = {"view": (0.01, 0.03), "click": (0.003, 0.015), "signup": (0.005, 0.015), "purchase": (0.0, 0.0)}


def _seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of the same event type of each user."""
    return t.islands(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of short lines (under six words) in each document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    short = (F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) < 6).alias("short")
    return t.islands(lines.select("doc_id", "pos", short), "doc_id", ["pos"], "short").where("short AND n >= 2")


def asof_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the last view of the same user at or before it."""
    ev = table(spark, sf_dir, "events")
    views = ev.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return t.as_of(ev.where("event_type = 'error'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view_id")


def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders whose thirty days overlap by 60 % or more."""
    start = F.timestamp_diff("DAY", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", start.alias("s"), (start + 30).alias("e"))
    return t.overlapping(spans, "o_custkey", "s", "e", "o_orderkey", 31)


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and amounts of each event type in the last minute, hour and day before each event."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", _seconds(F.col("ts")).alias("at"), "value")
    out = t.trailing(ev, "event_type", "at", "value", _TRAILING)
    return out.drop("event_type", "at", "value")


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events with less than six hours between them."""
    ev = table(spark, sf_dir, "events")
    return t.debounced(ev, "ts", "6 hours", "user_id", n=F.count("*"), kinds=F.count_distinct("event_type"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation that fit 600 characters, system and user messages always."""
    kept = t.within_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 600)
    return kept.select("conv_id", "turn", "role")


def message_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two messages of each conversation, and system messages."""
    return t.last_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", 2).select("conv_id", "turn", "role")


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of conversations and messages, and the conversation with the fewest."""
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"))
    fewest = F.min(F.struct("messages", "conv_id"))["conv_id"]
    return by.agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"), fewest.alias("shortest"))


def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred users seen last."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("n"))
    return by.orderBy(F.desc("updated_at"), "user_id").limit(100)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one event type follows another for a user."""
    w = t.Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return steps.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n"))


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost by event type; types without a price cost nothing."""
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    rows = table(spark, sf_dir, "events").select("event_type", tokens.alias("prompt"), F.floor("value").alias("completion"))
    sums = rows.groupBy("event_type").agg(F.count("*").alias("requests"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    cost = F.lit(0.0)
    for name, (prompt, completion) in PRICES.items():
        cost = F.when(F.col("event_type") == name, F.col("prompt") / 1000 * prompt + F.col("completion") / 1000 * completion).otherwise(cost)
    return sums.withColumn("cost", F.round(cost, 6))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, microseconds, whole mean, errors and last call of each user as a tool."""
    micros = F.floor(F.col("value") * 1000)
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("calls"), F.sum(micros).alias("total_us"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last")
    )
    return by.withColumn("avg_us", F.floor(F.col("total_us") / F.col("calls")))


def expired_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type older than a day at the last event."""
    ev = table(spark, sf_dir, "events").select("event_type", _seconds(F.col("ts")).alias("at"))
    last = ev.agg(F.max("at").alias("now"))
    return t.expired(ev.join(F.broadcast(last)), "at", 86400, F.col("now")).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sum by event type, from a stream of the events."""
    return streams.finished(streams.counters(streams.event_stream(spark, sf_dir))).select("event_type", "n", "total")


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in hours sliding by half an hour, from a stream of the events."""
    out = streams.finished(streams.sliding_usage(streams.event_stream(spark, sf_dir), "1 hour", "30 minutes"))
    return out.select(_seconds(F.col("start").cast("timestamp_ntz")).alias("start"), "event_type", "n")


def stream_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event type used in the minute, hour and day before each event, as state of a stream; the last hour still waits."""
    own = spark.newSession()  # with a state store of its own choice
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(*limits.STATE_STORE)
    used = streams.finished(limits.trailing_usage(streams.event_stream(own, sf_dir)), "append")
    return used.withColumnsRenamed({"key": "event_type", "id": "event_id"})


QUERIES = {
    f.__name__: f
    for f in (
        event_runs, line_blocks, asof_enclosing, range_overlap, rate_limit_windows, debounce_sessions, context_budget, message_tail,
        session_stats, recent_sessions, transitions, usage_cost, telemetry, expired_usage, stream_counters, stream_usage, stream_limits,
    )
}

_RUNS = """SELECT {key}, CAST(run AS BIGINT) AS run, {value}, min({order}) AS first, max({order}) AS last, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY {by} ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN row_number() OVER w > 1 AND lag({value}) OVER w IS NOT DISTINCT FROM {value} THEN 0 ELSE 1 END AS new FROM {rows}
      WINDOW w AS (PARTITION BY {key} ORDER BY {by}))) GROUP BY {key}, run, {value}"""
_TRAILING = {"minute": 60, "hour": 3600, "day": 86400}
_KEPT = "role IN ('system', 'user')"
_COST = " ".join(f"WHEN '{k}' THEN prompt / 1000::DOUBLE * {p}::DOUBLE + completion / 1000::DOUBLE * {c}::DOUBLE" for k, (p, c) in PRICES.items())

ORACLE = {
    "event_runs": _RUNS.format(key="user_id", value="event_type", order="ts", by="ts, event_id", rows="events"),
    "line_blocks": r"""WITH l AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) < 6 AS short FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))
        SELECT * FROM (""" + _RUNS.format(key="doc_id", value="short", order="pos", by="pos", rows="l") + ") WHERE short AND n >= 2",
    "asof_enclosing": """WITH v AS (SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view')
        SELECT e.event_id, e.user_id, e.ts, v.view_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "range_overlap": """WITH s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders)
        SELECT a.o_custkey, a.o_orderkey AS id1, b.o_orderkey AS id2, round((least(a.s, b.s) + 30 - greatest(a.s, b.s)) / 30::DOUBLE, 4) AS share
        FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
        WHERE round((least(a.s, b.s) + 30 - greatest(a.s, b.s)) / 30::DOUBLE, 4) >= 0.6""",
    "rate_limit_windows": "WITH e AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS secs, value FROM events) SELECT event_id, "
    + ", ".join(f"count(*) OVER last_{w} AS n_{w}, round(sum(value) OVER last_{w}, 4) AS sum_{w}" for w in _TRAILING)
    + " FROM e WINDOW "
    + ", ".join(f"last_{w} AS (PARTITION BY event_type ORDER BY secs RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)" for w, s in _TRAILING.items()),
    "debounce_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS end, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, run""",
    "context_budget": f"""WITH m AS (SELECT *, {_KEPT} AS pinned, 600 - sum(CASE WHEN {_KEPT} THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS room,
          sum(length(text)) OVER (PARTITION BY conv_id, {_KEPT} ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
        SELECT conv_id, turn, role FROM m WHERE pinned OR used <= room""",
    "message_tail": """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS n FROM conversations) WHERE role = 'system' OR n <= 2""",
    "session_stats": """WITH b AS (SELECT conv_id, count(*) AS m FROM conversations GROUP BY conv_id)
        SELECT count(*) AS sessions, CAST(sum(m) AS BIGINT) AS messages, min((m, conv_id))[2] AS shortest FROM b""",
    "recent_sessions": "SELECT user_id, max(ts) AS updated_at, count(*) AS n FROM events GROUP BY user_id ORDER BY updated_at DESC, user_id LIMIT 100",
    "transitions": """SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
        WHERE dst IS NOT NULL GROUP BY 1, 2""",
    "usage_cost": f"""WITH s AS (SELECT event_type, count(*) AS requests, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS prompt,
          CAST(sum(floor(value)) AS BIGINT) AS completion FROM events GROUP BY event_type)
        SELECT *, round(CASE event_type {_COST} ELSE 0 END, 6) AS cost FROM s""",
    "telemetry": """WITH b AS (SELECT user_id, count(*) AS calls, CAST(sum(floor(value * 1000)) AS BIGINT) AS total_us, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS last FROM events GROUP BY user_id)
        SELECT *, total_us // calls AS avg_us FROM b""",
    "expired_usage": "WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events) SELECT event_type, count(*) AS n FROM e WHERE secs < (SELECT max(secs) FROM e) - 86400 GROUP BY event_type",
    "stream_counters": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "stream_usage": """WITH w AS (SELECT event_type, CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS s FROM events)
        SELECT start, event_type, count(*) AS n FROM (SELECT s AS start, event_type FROM w UNION ALL SELECT s - 1800, event_type FROM w) GROUP BY ALL""",
    "stream_limits": "WITH e AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS secs, value, max(ts) OVER () - INTERVAL 1 HOUR AS done FROM events), w AS (SELECT event_id, event_type, secs, done, "
    + ", ".join(f"count(*) OVER last_{w} AS n_{w}, round(sum(value) OVER last_{w}, 4) AS sum_{w}" for w in _TRAILING)
    + " FROM e WINDOW "
    + ", ".join(f"last_{w} AS (PARTITION BY event_type ORDER BY secs RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)" for w, s in _TRAILING.items())
    + ") SELECT * EXCLUDE (secs, done) FROM w WHERE secs < floor(epoch(done))",
}
