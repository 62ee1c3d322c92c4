"""Graph operators over an edge list ``src, dst`` (and ``weight`` where it counts).

All of them are loops of lazy joins whose frontier is checkpointed, so lineage stays
short and a lost executor costs one step.  Edges are taken distinct; self-loops count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored
from .components import connected_components


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The edges without repeats and nulls."""
    return edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """Every node of an edge list, once."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, in_degree, out_degree, total_degree``; listed nodes without edges have zeros."""
    e = distinct_edges(edges)
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    if nodes is not None:
        both = both.union(nodes.select("node", F.lit(0), F.lit(0)))
    return both.groupBy("node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("total_degree")
    )


def pagerank(
    edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float | None = 1e-4, cut_every: int = 4
) -> DataFrame:
    """``node, score``; nodes without outgoing edges keep no mass (nothing is redistributed).

    Stops after ``max_iterations``, or when no score changes by ``tolerance`` or more;
    ``tolerance=None`` runs all iterations without the test.
    """
    e = cut(distinct_edges(edges))
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    links = cut(e.join(out, "src").select("src", "dst", (1.0 / F.col("out")).alias("share")))
    nodes = cut(endpoints(e))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    scores = nodes.select("node", F.lit(1.0 / n).alias("score"))
    for i in range(max_iterations):
        flow = (
            links.join(scores, links["src"] == scores["node"])
            .groupBy("dst")
            .agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        )
        after = nodes.join(flow, nodes["node"] == flow["dst"], "left").select(
            "node", (F.lit((1 - damping) / n) + damping * F.coalesce("flow", F.lit(0.0))).alias("score")
        )
        if tolerance is None:
            scores = cut(after) if i % cut_every == cut_every - 1 else after
            continue
        after = cut(after)
        moved = after.join(scores.withColumnRenamed("score", "old"), "node").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        scores = after
        if moved < tolerance:
            break
    return scores


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``source, node, dist, sigma``: distance and number of shortest paths from each source (all nodes by default)."""
    e = cut(distinct_edges(edges))
    starts = endpoints(e) if sources is None else sources.select("node").distinct()
    level = cut(starts.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"), F.lit(1).cast("long").alias("sigma")))
    levels = [level]
    seen = level.select("source", "node")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = (
            level.join(e, level["node"] == e["src"])
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.sum("sigma").alias("sigma"))
        )
        level = cut(
            reached.join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("dist"), "sigma")
        )
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))
    return reduce(DataFrame.unionByName, levels)


def closeness_centrality(edges: DataFrame, normalize: bool = True) -> DataFrame:
    """``node, closeness``: one over the mean distance to what a node reaches, times the share that it reaches."""
    nodes = endpoints(distinct_edges(edges))
    n = nodes.count()
    paths = shortest_paths(edges)
    by = paths.groupBy(F.col("source").alias("node")).agg(
        F.sum("dist").alias("total"), F.count_if(F.col("dist") > 0).alias("reached")
    )
    score = F.col("reached") / F.col("total")
    if normalize and n > 1:
        score = score * F.col("reached") / (n - 1)
    return by.select("node", F.when(F.col("total") > 0, score).otherwise(F.lit(0.0)).alias("closeness"))


def betweenness_centrality(edges: DataFrame, max_nodes: int | None = None, normalize: bool = True) -> DataFrame:
    """``node, betweenness``: how much of the shortest paths passes through a node (directed).

    ``max_nodes`` takes only the sources of largest degree, as an approximation.
    Dependencies flow back over the levels, farthest first.
    """
    e = cut(distinct_edges(edges))
    nodes = cut(endpoints(e))
    n = nodes.count()
    sources = None
    if max_nodes is not None:
        sources = degree_centrality(e).orderBy(F.desc("total_degree"), "node").limit(max_nodes).select("node")
    paths = cut(shortest_paths(e, sources))
    depth = paths.agg(F.max("dist")).first()[0] or 0
    up = paths.select("source", F.col("node").alias("src"), F.col("dist").alias("d0"), F.col("sigma").alias("s0"))
    down = paths.select("source", F.col("node").alias("dst"), F.col("dist").alias("d1"), F.col("sigma").alias("s1"))
    steps = cut(up.join(e, "src").join(down, ["source", "dst"]).where(F.col("d1") == F.col("d0") + 1))
    level = paths.where(F.lit(False)).select("source", F.col("node").alias("dst"), F.lit(0.0).alias("delta"))
    found = []
    for d in range(depth, 0, -1):
        below = steps.where(F.col("d1") == d).join(level, ["source", "dst"], "left")
        level = cut(
            below.groupBy("source", F.col("src").alias("dst")).agg(
                F.sum(F.col("s0") / F.col("s1") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("delta")
            )
        )
        found.append(level)
    scale = (n - 1) * (n - 2) if normalize and n > 2 else 1
    if not found:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    total = (
        reduce(DataFrame.unionByName, found)
        .where(F.col("source") != F.col("dst"))
        .groupBy(F.col("dst").alias("node"))
        .agg(F.sum("delta").alias("sum"))
    )
    return nodes.join(total, "node", "left").select("node", (F.coalesce("sum", F.lit(0.0)) / scale).alias("betweenness"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: undirected components, each named by its smallest node."""
    return connected_components(edges)


def _rounds(rounds: int | None, limit: int, what: str) -> Iterator[None]:
    """So many rounds; without a number, up to ``limit``, which is an error to reach, as nothing has settled then."""
    yield from (None for _ in range(limit if rounds is None else rounds))
    if rounds is None:
        raise RuntimeError(f"{what} did not settle in {limit} rounds")


def _same(a: DataFrame, b: DataFrame, value: str) -> bool:
    """Whether two tables of ``node`` and a value agree."""
    other = b.select("node", F.col(value).alias("_other"))
    return not a.join(other, "node").where(F.col(value) != F.col("_other")).limit(1).count()


def label_propagation(edges: DataFrame, iterations: int | None = 5, limit: int = 100) -> DataFrame:
    """``node, label`` after synchronous rounds; most frequent label among in- and out-neighbours, ties to the least.

    A fixed number of rounds need not settle; None runs until no label changes, with an error
    after ``limit`` rounds, as labels of a bipartite part may change places for ever.
    """
    e = distinct_edges(edges)
    near = cut(e.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(e.select("dst", "src")))
    labels = endpoints(e).select("node", F.col("node").alias("label"))
    for _ in _rounds(iterations, limit, "labels"):
        votes = (
            near.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node", "label").agg(F.count("*").alias("n"))
        )
        before, labels = labels, cut(votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label")))
        if iterations is None and _same(labels, before, "label"):
            break
    return labels


def local_moves(edges: DataFrame, rounds: int | None = 4, limit: int = 200) -> DataFrame:
    """``node, community``: local moving by weight gain, all nodes of a round at once.

    A node's best community is the neighbouring one with the most weight to it, ties to
    the smaller name, if that is more than it has to its own.  It moves there if that has
    the smaller name; else it waits for the others to come, so that rounds settle: names only
    become smaller.  A fixed number of rounds may end before that; None runs until no node
    moves, with an error after ``limit`` rounds.
    """
    e = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    near = stored(
        e.select(F.col("src").alias("node"), F.col("dst").alias("near"), "weight").union(e.where("src <> dst").select("dst", "src", "weight"))
    )
    where = endpoints(e).select("node", F.col("node").alias("community"))
    for _ in _rounds(rounds, limit, "communities"):
        pull = (
            near.join(where.select(F.col("node").alias("near"), F.col("community").alias("to")), "near")
            .groupBy("node", "to")
            .agg(F.sum("weight").alias("w"))
        )
        own = where.join(pull, (where["node"] == pull["node"]) & (where["community"] == pull["to"]), "left").select(
            where["node"], "community", F.coalesce("w", F.lit(0.0)).alias("own")
        )
        best = (
            own.join(pull, "node")
            .where(F.col("w") > F.col("own"))
            .groupBy("node")
            .agg(F.min(F.struct((-F.col("w")).alias("w"), "to"))["to"].alias("to"))
        )
        moved = F.when(F.col("to") < F.col("community"), F.col("to")).otherwise(F.col("community"))
        before, where = where, stored(own.join(best, "node", "left").select("node", moved.alias("community")))
        if rounds is None and _same(where, before, "community"):
            break
    return where


def move_gain(edges: DataFrame, assignment: DataFrame, moves: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``node, to, gain`` of moves ``node, to``: weight to the new community less that to its own, over the total weight."""
    e = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    near = e.select(F.col("src").alias("node"), F.col("dst").alias("near"), "weight").union(e.where("src <> dst").select("dst", "src", "weight"))
    pull = near.where("node <> near").join(assignment.select(F.col("node").alias("near"), F.col("community").alias("of")), "near")
    pull = pull.groupBy("node", "of").agg(F.sum("weight").alias("w"))
    own = assignment.select("node", F.col("community").alias("of")).join(pull, ["node", "of"], "left").select("node", F.coalesce("w", F.lit(0.0)).alias("_own"))
    to = moves.select("node", F.col("to").alias("of")).join(pull, ["node", "of"], "left").select("node", F.col("of").alias("to"), F.coalesce("w", F.lit(0.0)).alias("_to"))
    total = e.agg(F.sum("weight").alias("_m"))
    return to.join(own, "node").join(total).select("node", "to", (resolution * (F.col("_to") - F.col("_own")) / F.col("_m")).alias("gain"))


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``modularity`` of ``node, community``: inner weight less expected weight, both over the total.

    A community's degree counts each edge that touches it once.
    """
    e = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    named = e.join(assignment.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(
        assignment.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst"
    )
    total = named.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"))
    degrees = (
        named.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("community"), "weight")
        .groupBy("community")
        .agg(F.sum("weight").alias("degree"))
        .agg(F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    )
    return total.join(degrees).select(
        F.when(F.col("m") > 0, resolution * (F.col("inner") / F.col("m") - F.col("squares") / (2 * F.col("m") * F.col("m"))))
        .otherwise(F.lit(0.0))
        .alias("modularity")
    )


def simple_paths(edges: DataFrame, max_depth: int = 10, start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """``src, dst, path`` (an array) of all paths without repeated nodes, one edge to ``max_depth`` long."""
    e = cut(distinct_edges(edges))
    first = e if start is None else e.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    step = cut(first.where("src <> dst").select("src", "dst", F.array("src", "dst").alias("path")))
    found = [step]
    on = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for _ in range(max_depth - 1):
        step = cut(
            step.join(on, "dst")
            .where(~F.array_contains("path", F.col("next")))
            .select("src", F.col("next").alias("dst"), F.array_append("path", F.col("next")).alias("path"))
        )
        if not step.limit(1).count():
            break
        found.append(step)
    paths = reduce(DataFrame.unionByName, found)
    return paths if end is None else paths.join(end.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")


def simple_cycles(edges: DataFrame, max_length: int | None = 5, min_length: int = 2) -> DataFrame:
    """``cycle`` (an array from its least node on) of every simple cycle, each once; self-loops are none.

    Cycles of more than ``max_length`` nodes are left out; None goes on until no path does.
    """
    e = cut(distinct_edges(edges).where("src <> dst"))
    step = cut(e.where("dst > src").select("src", "dst", F.array("src", "dst").alias("path")))
    on = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    found = []
    for length in count(2):
        if length >= min_length:
            found.append(step.join(on, "dst").where(F.col("next") == F.col("src")).select(F.col("path").alias("cycle")))
        if length == max_length:
            break
        step = cut(
            step.join(on, "dst")
            .where((F.col("next") > F.col("src")) & ~F.array_contains("path", F.col("next")))
            .select("src", F.col("next").alias("dst"), F.array_append("path", F.col("next")).alias("path"))
        )
        if not step.limit(1).count():
            break
    return reduce(DataFrame.unionByName, found) if found else e.select(F.array("src").alias("cycle")).where("false")


def reachable(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node, reached``: every pair joined by a path of one edge or more; a node on a cycle reaches itself."""
    e = cut(distinct_edges(edges))
    frontier = cut(e.select(F.col("src").alias("node"), F.col("dst").alias("reached")))
    levels = [frontier]
    seen = frontier
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        after = frontier.join(e, frontier["reached"] == e["src"]).select("node", F.col("dst").alias("reached")).distinct()
        frontier = cut(after.join(seen, ["node", "reached"], "left_anti"))
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, levels)


def affected(edges: DataFrame, targets: DataFrame, depth: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """``target, node, level``: who reaches a target backwards, itself included, at levels below ``depth``.

    Excluded nodes are neither reported nor passed through.
    """
    back = distinct_edges(edges).select(F.col("dst").alias("node"), F.col("src").alias("caller"))
    if exclude is not None:
        back = back.join(exclude.select(F.col("node").alias("caller")), "caller", "left_anti")
    back = cut(back)
    level = cut(targets.select(F.col("node").alias("target"), "node", F.lit(0).alias("level")))
    levels, seen = [level], level.select("target", "node")
    for d in range(1, depth):
        after = level.join(back, "node").select("target", F.col("caller").alias("node")).distinct()
        level = cut(after.join(seen, ["target", "node"], "left_anti").withColumn("level", F.lit(d)))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("target", "node"))
    return reduce(DataFrame.unionByName, levels)


def neighbourhood(edges: DataFrame, targets: DataFrame, depth: int = 2) -> DataFrame:
    """``target, node, level`` within ``depth`` steps along or against the edges."""
    e = distinct_edges(edges)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return affected(both, targets, depth + 1)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_count, edge_count, average_degree, density`` of ``node, node_type`` and an edge list."""
    n = nodes.agg(F.count("*").alias("node_count"))
    m = distinct_edges(edges).agg(F.count("*").alias("edge_count"))
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    return n.join(m).select(
        "node_count",
        "edge_count",
        F.round(F.when(F.col("node_count") > 0, 2.0 * F.col("edge_count") / F.col("node_count")).otherwise(0.0), 2).alias("average_degree"),
        F.round(F.when(pairs > 0, F.col("edge_count") / pairs).otherwise(0.0), 4).alias("density"),
    )


def export_d3(edges: DataFrame) -> DataFrame:
    """``kind, json``: a line for each node, with rank, degree and community, and for each link."""
    rank, degree, group = pagerank(edges, max_iterations=10, tolerance=None), degree_centrality(edges), components(edges)
    nodes = rank.join(degree, "node").join(group, "node").select(
        F.lit("node").alias("kind"),
        F.to_json(F.struct(F.col("node").alias("id"), F.round("score", 6).alias("pagerank"), F.col("total_degree").alias("degree"), F.col("component").alias("community"))).alias("json"),
    )
    links = edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("json"))
    return nodes.unionByName(links)


def export_dot(edges: DataFrame, max_nodes: int = 500) -> DataFrame:
    """``line``: statements of a DOT graph over the nodes of largest rank; an edge's width is 1 + 2 (w - 1)."""
    rank = pagerank(edges, max_iterations=10, tolerance=None)
    top = cut(rank.orderBy(F.desc("score"), "node").limit(max_nodes))
    most = Window.partitionBy()  # max_nodes rows at most
    shade = F.when(F.max("score").over(most) > 0, F.col("score") / F.max("score").over(most)).otherwise(0.0)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    nodes = top.select(F.concat(quoted("node"), F.lit(" [intensity="), F.format_string("%.3f", shade), F.lit("];")).alias("line"))
    inside = edges.join(top.select(F.col("node").alias("src")), "src", "left_semi").join(top.select(F.col("node").alias("dst")), "dst", "left_semi")
    width = F.format_string("%.2f", 1.0 + 2.0 * (F.col("weight") - 1.0))
    links = inside.select(F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" [penwidth="), width, F.lit("];")).alias("line"))
    return nodes.unionByName(links)
