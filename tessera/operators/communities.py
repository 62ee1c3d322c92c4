"""Communities in levels: local moving by modularity, then contraction to weighted super-nodes.

The graph of a level is kept as rows ``node, near, weight`` in both directions; a super-node's
inner weight is a row to itself.  All nodes of a round move at once, and only to communities
of smaller names in one round, of larger ones in the next, so that no two nodes change places.
A round counts if modularity rises; two rounds in a row that do not count end the level.  So
modularity never falls, from round to round and from level to level.  All tables grow with the graph,
so their joins are told to shuffle: nothing of them goes through the driver.

Defined cases: edges with a null end are left out; repeated edges and both directions of an edge
add up; a missing weight is 1; self-loops are inner weight; without edges the result is empty;
equal gains go to the smaller name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def symmetric(edges: DataFrame) -> DataFrame:
    """``node, near, weight`` in both directions, each pair once; a self-loop counts twice, once for each end."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst", weight.alias("weight"))
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("near"), "weight").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("near"), "weight"))
    return both.groupBy("node", "near").agg(F.sum("weight").alias("weight"))


def _named(near: DataFrame, where: DataFrame) -> DataFrame:
    """The rows of a level with the communities of both ends, ``community`` and ``to``."""
    a = where.select("node", "community")
    b = where.select(F.col("node").alias("near"), F.col("community").alias("to"))
    return near.join(b.hint("merge"), "near").join(a.hint("merge"), "node")


def _quality(named: DataFrame, resolution: float, whole: float) -> float:
    """Modularity times ``whole`` squared, which is in whole numbers if the weights are."""
    inner = F.sum(F.when(F.col("community") == F.col("to"), F.col("weight")).otherwise(0.0))
    by = named.groupBy("community").agg(inner.alias("inner"), F.sum("weight").alias("degree"))
    row = by.agg(F.sum("inner").alias("inner"), F.sum(F.col("degree") * F.col("degree")).alias("squares")).first()
    return whole * row.inner - resolution * row.squares


def _moves(named: DataFrame, resolution: float, whole: float, down: bool) -> DataFrame:
    """``node, community`` after each node went to the community of largest gain on one side of its own name."""
    pull = named.groupBy("node", "community", "to").agg(F.sum(F.when(F.col("node") != F.col("near"), F.col("weight")).otherwise(0.0)).alias("w"), F.sum("weight").alias("_w"))
    degree = pull.groupBy("node", "community").agg(F.sum("_w").alias("degree"), F.sum(F.when(F.col("to") == F.col("community"), F.col("w")).otherwise(0.0)).alias("own"))
    total = degree.groupBy("community").agg(F.sum("degree").alias("total"))
    here = degree.join(total.hint("merge"), "community")
    side: Column = F.col("to") < F.col("community") if down else F.col("to") > F.col("community")
    asked = pull.where(side & (F.col("w") > 0)).select("node", "to", "w")
    there = total.select(F.col("community").alias("to"), F.col("total").alias("of_to"))
    # twice the total weight times the gain in inner weight, less what the degrees let expect
    gain = F.lit(whole) * (F.col("w") - F.col("own")) - F.lit(resolution) * F.col("degree") * (F.col("of_to") - F.col("total") + F.col("degree"))
    best = (
        asked.join(here.hint("merge"), "node").join(there.hint("merge"), "to").withColumn("gain", gain).where("gain > 0")
        .groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("gain"), F.col("to")))["to"].alias("to"))
    )
    return degree.select("node", "community").join(best.hint("merge"), "node", "left").select("node", F.coalesce("to", "community").alias("community"))


def settled(near: DataFrame, resolution: float = 1.0, rounds: int = 20) -> tuple[DataFrame, float]:
    """``node, community`` where local moving ends or ``rounds`` are over, and modularity there."""
    whole = near.agg(F.sum("weight")).first()[0]
    where = stored(near.select("node").distinct().withColumn("community", F.col("node")))
    named = stored(_named(near, where))
    best, idle = _quality(named, resolution, whole), 0
    for i in range(rounds):
        after = stored(_moves(named, resolution, whole, down=i % 2 == 0))
        tried = stored(_named(near, after))
        quality = _quality(tried, resolution, whole)
        if quality > best:
            where, named, best, idle = after, tried, quality, 0
        elif (idle := idle + 1) == 2:
            break
    return where, best / whole**2


def contracted(near: DataFrame, where: DataFrame) -> DataFrame:
    """The graph of the communities: weights between them summed, inner weight as rows to themselves."""
    return _named(near, where).groupBy(F.col("community").alias("node"), F.col("to").alias("near")).agg(F.sum("weight").alias("weight"))


def louvain(
    edges: DataFrame, *, resolution: float = 1.0, min_improvement: float = 1e-4, max_levels: int = 10, rounds: int = 20
) -> DataFrame:
    """``level, node, community, modularity``: the communities of the graph's nodes at every level, from 1 on.

    A level is added while it raises modularity by more than ``min_improvement``; the first is always
    there.  More ``resolution`` gives smaller communities.
    """
    near = stored(symmetric(edges))
    if not near.limit(1).count():
        return near.select(F.lit(1).alias("level"), "node", F.col("node").alias("community"), F.lit(0.0).alias("modularity"))
    members, levels, last = None, [], None
    for level in range(1, max_levels + 1):
        where, quality = settled(near, resolution, rounds)
        if last is not None and quality - last <= min_improvement:
            break
        if members is None:
            members = where
        else:
            up = where.select(F.col("node").alias("community"), F.col("community").alias("to"))
            members = stored(members.join(up.hint("merge"), "community").select("node", F.col("to").alias("community")))
        levels.append(members.select(F.lit(level).alias("level"), "node", "community", F.lit(quality).alias("modularity")))
        last = quality
        near = stored(contracted(near, where))
    return reduce(DataFrame.unionByName, levels)
