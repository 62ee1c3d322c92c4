"""The graph and code model read out of the given tables, as DataFrames and as SQL.

Nations stand for modules and parts for their functions; a module imports the
three modules it trades with most; a function calls the function that follows it inside an
order if that is shipped within ``CALL_DAYS`` after it, with the number of times as weight: a
graph of a large component, small ones and functions that nothing calls.  ``_PARTS`` has the same
tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

FUNCTION_NAMES = ("init", "run", "handle_call", "render_page", "compute", "test_case", "start_worker", "load")
#: A call is a follower shipped within so many days.
CALL_DAYS = 90


def top_per(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nk, module, area``: a row a nation."""
    name = (
        F.when(F.col("n_regionkey") == 0, F.concat(F.lit("Mix.Tasks."), "n_name"))
        .when(F.col("n_regionkey") == 1, F.concat("n_name", F.lit("Test")))
        .otherwise(F.col("n_name"))
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("nk"), name.alias("module"), F.col("r_name").alias("area")
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fn, module, area, name, arity, visibility``: a row a part."""
    names = F.array(*[F.lit(n) for n in FUNCTION_NAMES])
    mods = modules(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return part.join(mods, (part["p_partkey"] % 25) == mods["nk"]).select(
        F.col("p_partkey").alias("fn"),
        "module",
        "area",
        F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("name"),
        (F.col("p_partkey") % 4).cast("int").alias("arity"),
        F.when(F.col("p_size") <= 10, "private").otherwise("public").alias("visibility"),
    )


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, weight``: each module's three strongest partners, itself included."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    counts = (
        li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
        .join(customer, F.col("o_custkey") == customer["c_custkey"])
        .join(supplier, F.col("l_suppkey") == supplier["s_suppkey"])
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    mods = modules(spark, sf_dir)
    named = counts.join(mods.select(F.col("nk").alias("c_nationkey"), F.col("module").alias("src")), "c_nationkey").join(
        mods.select(F.col("nk").alias("s_nationkey"), F.col("module").alias("dst")), "s_nationkey"
    )
    return top_per(named.select("src", "dst", "weight"), "src", 3, F.desc("weight"), F.asc("dst"))


def calls(spark: SparkSession, sf_dir: str, days: int = CALL_DAYS) -> DataFrame:
    """``src, dst, weight``: each function's followers within an order and so many days, and how often."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_shipdate").alias("_at"),
        F.lead("l_partkey").over(line).alias("dst"), F.lead("l_shipdate").over(line).alias("_then"),
    )
    soon = steps.where(F.col("dst").isNotNull() & F.col("_then").between(F.col("_at"), F.col("_at") + F.make_dt_interval(F.lit(days))))
    return soon.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls lifted to modules, ``src, dst``, without calls inside a module."""
    fns = functions(spark, sf_dir).select("fn", "module")
    edges = calls(spark, sf_dir)
    return (
        edges.join(fns.select(F.col("fn").alias("src"), F.col("module").alias("a")), "src")
        .join(fns.select(F.col("fn").alias("dst"), F.col("module").alias("b")), "dst")
        .where(F.col("a") != F.col("b"))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .distinct()
    )


def module_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and lifted calls, ``src, dst``, each once; a module may import itself."""
    return imports(spark, sf_dir).select("src", "dst").unionByName(module_calls(spark, sf_dir)).distinct()


_PARTS = {
    "modules": (
        (),
        """SELECT n_nationkey AS nk, CASE n_regionkey WHEN 0 THEN 'Mix.Tasks.' || n_name WHEN 1 THEN n_name || 'Test'
           ELSE n_name END AS module, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "functions": (
        ("modules",),
        """SELECT p_partkey AS fn, module, area, ['init', 'run', 'handle_call', 'render_page', 'compute', 'test_case',
           'start_worker', 'load'][1 + p_partkey % 8] AS name, CAST(p_partkey % 4 AS INTEGER) AS arity,
           CASE WHEN p_size <= 10 THEN 'private' ELSE 'public' END AS visibility
           FROM part JOIN modules ON p_partkey % 25 = nk""",
    ),
    "imports": (
        ("modules",),
        """SELECT src, dst, weight FROM (
             SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM (
               SELECT a.module AS src, b.module AS dst, CAST(count(*) AS DOUBLE) AS weight
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
               JOIN supplier ON l_suppkey = s_suppkey JOIN modules a ON c_nationkey = a.nk JOIN modules b ON s_nationkey = b.nk
               GROUP BY 1, 2)) WHERE place <= 3""",
    ),
    "calls": (
        (),
        f"""SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
             SELECT l_partkey AS src, l_shipdate AS a, lead(l_partkey) OVER w AS dst, lead(l_shipdate) OVER w AS b
             FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
           WHERE dst IS NOT NULL AND b BETWEEN a AND a + INTERVAL {CALL_DAYS} DAY GROUP BY 1, 2""",
    ),
    "module_calls": (
        ("functions", "calls"),
        """SELECT DISTINCT a.module AS src, b.module AS dst FROM calls JOIN functions a ON src = a.fn
           JOIN functions b ON dst = b.fn WHERE a.module <> b.module""",
    ),
    "module_dependencies": (
        ("imports", "module_calls"),
        "SELECT src, dst FROM imports UNION SELECT src, dst FROM module_calls",
    ),
}


def sql_with(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the named tables with all that they need, for an oracle to go on from."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _PARTS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in order)
