"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Edges that one task works on.
EDGES = 500_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node for every endpoint: ``(node, component)``.

    Each round takes the least label among the neighbours and then follows the
    label of that label, so a path of length n needs about log n rounds.  Labels
    are aggregated before they are joined, so a hub costs one row per map task.
    Every round is written as a table: a checkpoint keeps an estimated size whose digits
    multiply from round to round, in the driver.  Joins are told to shuffle, as all of
    these tables grow with the graph, to a number of tasks that grows with the edges; so
    neither the driver nor a task holds more of a larger graph.  Nulls and self-loops
    link nothing: a self-loop still names its node.  An empty edge list gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = stored(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tasks = max(1, -(-e.count() // EDGES))
    once = stored(e.repartition(tasks, "a", "b").distinct())
    both = stored(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")))
    dealt = lambda df, c: df.repartition(2 * tasks, c).hint("merge")
    labels = stored(dealt(both, "a").groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    for _ in range(max_rounds):
        near = (
            dealt(both, "b").join(dealt(labels, "node"), F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("near"))
            .agg(F.min("label").alias("near_label"))
        )
        pulled = labels.join(near.hint("merge"), labels["node"] == near["near"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near_label", "label")).alias("label")
        )
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("via_label")).hint("merge")
        after = stored(
            pulled.join(hop, pulled["label"] == hop["via"], "left").select(
                "node", "old", F.least("label", F.coalesce("via_label", "label")).alias("label")
            )
        )
        labels = after.select("node", "label")
        if after.where(F.col("old") != F.col("label")).limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
