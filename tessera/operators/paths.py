"""Paths from one node to another, found from both ends.

Half-paths grow from the start along the edges and from the target against them, and meet in
the middle, so the exponent is half the length.  A half-path grows on only while its
end is near enough to the other side: distances from both ends come first, and a path that
cannot be completed within ``max_depth`` is never held.  Paths come out by length, so with
``max_paths`` lengths beyond the last one needed are not joined.

Defined cases: a start that is its target has the path of that node alone; repeated edges are
one; unknown nodes give no path; no path holds a node twice; at equal length paths are ordered
by the names of their nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import distinct_edges

#: Out-degrees from which a start counts as dense, and as moderately connected.
DENSE, MODERATE = 20, 10


def _distances(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """``pair, node, dist`` of what lies within ``depth`` edges of each pair's ``node``."""
    level = cut(pairs.select("pair", "node", F.lit(0).alias("dist")))
    levels, seen = [level], level.select("pair", "node")
    for d in range(1, depth + 1):
        after = level.join(edges, level["node"] == edges["src"]).select("pair", F.col("dst").alias("node")).distinct()
        level = cut(after.join(seen, ["pair", "node"], "left_anti").withColumn("dist", F.lit(d)))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("pair", "node"))
    return cut(reduce(DataFrame.unionByName, levels))


def _half_paths(edges: DataFrame, starts: DataFrame, rest: DataFrame, length: int, max_depth: int) -> list[DataFrame]:
    """``pair, node, path`` of the simple paths of 0 to ``length`` edges whose end is near enough to the other side."""
    step = cut(starts.select("pair", "node", F.array("node").alias("path")))
    found = [step]
    for n in range(1, length + 1):
        on = step.join(edges, step["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        on = on.select("pair", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = cut(on.join(rest.where(F.col("dist") <= max_depth - n).select("pair", "node"), ["pair", "node"], "left_semi"))
        found.append(step)
    return found


def find_paths(edges: DataFrame, pairs: DataFrame, *, max_depth: int = 10, max_paths: int | None = 100) -> DataFrame:
    """``src, dst, path, length, number`` for each row ``src, dst`` of ``pairs``: the first ``max_paths`` simple paths of up to ``max_depth`` edges.

    Numbers count a pair's paths from 1, by length, then by the nodes' names; None returns all of them.
    """
    e = cut(distinct_edges(edges))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    asked = cut(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("pair", F.struct("src", "dst")))
    from_start = _distances(e, asked.select("pair", F.col("src").alias("node")), max_depth)
    to_end = _distances(back, asked.select("pair", F.col("dst").alias("node")), max_depth)
    forward = _half_paths(e, asked.select("pair", F.col("src").alias("node")), to_end, (max_depth + 1) // 2, max_depth)
    backward = _half_paths(back, asked.select("pair", F.col("dst").alias("node")), from_start, max_depth // 2, max_depth)
    same = asked.where("src = dst").select("pair", F.array("src").alias("path"), F.lit(0).alias("length"))
    found, open_pairs = [cut(same)], asked.where("src <> dst").select("pair")
    for length in range(1, max_depth + 1):
        a, b = forward[(length + 1) // 2], backward[length // 2]
        a, b = a.join(open_pairs, "pair", "left_semi"), b.select("pair", "node", F.reverse("path").alias("_rest"))
        met = a.join(b, ["pair", "node"]).where(F.size(F.array_intersect("path", "_rest")) == 1)  # the node in the middle alone
        whole = F.concat("path", F.slice("_rest", 2, length))
        found.append(cut(met.select("pair", whole.alias("path"), F.lit(length).alias("length"))))
        if max_paths is not None:
            done = reduce(DataFrame.unionByName, found).groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= max_paths)
            open_pairs = cut(open_pairs.join(done, "pair", "left_anti"))
            if not open_pairs.limit(1).count():
                break
    paths = reduce(DataFrame.unionByName, found)
    number = F.row_number().over(Window.partitionBy("pair").orderBy("length", "path"))
    numbered = paths.withColumn("number", number)
    if max_paths is not None:
        numbered = numbered.where(F.col("number") <= max_paths)
    return numbered.select("pair.src", "pair.dst", "path", "length", "number")


def density_warnings(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, out_degree, level`` of starts from which paths may be many: ``dense`` or ``moderate``."""
    out = distinct_edges(edges).join(pairs.select("src").distinct(), "src", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    level = F.when(F.col("out_degree") >= DENSE, "dense").otherwise("moderate")
    return out.where(F.col("out_degree") >= MODERATE).withColumn("level", level)
