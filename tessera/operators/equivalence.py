"""Equivalent constructs across languages, by canonical syntax trees held as JSON text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import strings
from ..session import cut


def tag(tree: Column) -> Column:
    """The node kind at the root of a tree ``[tag, meta, children...]``; null for a leaf or no JSON array."""
    return F.when(F.startswith(tree, F.lit("[")), F.get_json_object(tree, "$[0]"))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal trees, 0.7 to 1 for the same root kind (more with more children), 0.3 for others, 0 for leaves."""
    size = F.least(F.coalesce(F.json_array_length(a), F.lit(0)), F.coalesce(F.json_array_length(b), F.lit(0)))
    same = F.least(F.lit(1.0), F.lit(0.7) + 0.1 * F.least(size, F.lit(3)))
    return F.when(a == b, 1.0).when(tag(a).isNull() | tag(b).isNull(), 0.0).when(tag(a) == tag(b), same).otherwise(0.3)


def equivalents(rows: DataFrame) -> DataFrame:
    """``id, other, language, other_language``: rows (``id, language, tree``) with equal trees in different languages."""
    other = rows.select(F.col("id").alias("other"), F.col("language").alias("other_language"), "tree")
    return rows.join(other, "tree").where(F.col("language") != F.col("other_language")).select("id", "other", "language", "other_language")


def groups(rows: DataFrame) -> DataFrame:
    """``first, n, languages`` of each class of equal trees."""
    return rows.groupBy("tree").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_set("language")).alias("languages")).drop("tree")


def search(rows: DataFrame, tree: str, languages: list[str] | None = None, limit: int = 5, least: float = 0.5) -> DataFrame:
    """The ``limit`` rows of each language most similar to a tree, ties to the smaller id."""
    wanted = rows if languages is None else rows.where(F.col("language").isin(*languages))
    scored = wanted.withColumn("score", similarity(F.col("tree"), F.lit(tree))).where(F.col("score") >= least)
    w = Window.partitionBy("language").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def matches(tree: Column, pattern: list[str | None]) -> Column:
    """Whether the tree's elements are those of the pattern; None stands for anything."""
    tests = [F.get_json_object(tree, f"$[{i}]") == F.lit(p) for i, p in enumerate(pattern) if p is not None]
    same_size = F.json_array_length(tree) == len(pattern)
    return F.coalesce(reduce(Column.__and__, tests, same_size), F.lit(False))


#: Stands for anything in a pattern.
ANY = "_"


def pattern_test(node: Column, pattern: object) -> Column:
    """Whether a tree ``[kind, attributes, children...]``, a VARIANT, is what a pattern describes.

    ``"_"`` is anything.  ``[kind, "_", "_"]`` and ``[kind, "_", "_", "_"]`` ask for the kind, ``[kind, {name: value}, "_"]``
    for attributes besides, at any depth of objects, ``[kind, operator, "_", "_"]`` for a second element that is text.
    Any other pattern is the whole tree itself.
    """
    at = lambda path, kind: F.try_variant_get(node, path, kind)
    if pattern == ANY:
        return F.lit(True)
    tests = None
    if isinstance(pattern, list) and len(pattern) in (3, 4) and isinstance(pattern[0], str) and all(p == ANY for p in pattern[2:]):
        if pattern[1] == ANY:
            tests = []
        elif len(pattern) == 3 and isinstance(pattern[1], dict):
            tests = list(_attribute_tests(at, "$[1]", pattern[1]))
        elif len(pattern) == 4 and isinstance(pattern[1], str):
            tests = [at("$[1]", "string") == pattern[1]]
    if tests is None:
        whole = F.to_json(node) == json.dumps(pattern, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
        if isinstance(pattern, list) and pattern and isinstance(pattern[0], str):  # nodes of other kinds need no text
            whole = F.when(at("$[0]", "string") == pattern[0], whole)
        return F.coalesce(whole, F.lit(False))
    return F.coalesce(reduce(Column.__and__, tests, at("$[0]", "string") == pattern[0]), F.lit(False))


def _attribute_tests(at, path: str, wanted: dict):
    for name, value in wanted.items():
        if isinstance(value, dict):
            yield from _attribute_tests(at, f"{path}.{name}", value)
        else:
            kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")
            yield at(f"{path}.{name}", kind) == F.lit(value)


def tree_nodes(rows: DataFrame, most_levels: int = 64) -> DataFrame:
    """``id, depth, node`` of every subtree of the trees of ``id, tree`` (JSON text), as VARIANTs; text that is no JSON has none.

    Level by level: children are the arrays from the third element on.  A tree of more than ``most_levels`` is an error.
    """
    spark = rows.sparkSession
    level = cut(rows.select("id", F.lit(0).alias("depth"), F.try_parse_json("tree").alias("node")).where("node IS NOT NULL"))
    levels = [level]
    for depth in range(1, most_levels + 1):
        children = level.select("id", "node").lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        below = children.where((F.col("pos") >= 2) & F.startswith(F.schema_of_variant("value"), F.lit("ARRAY")))
        level = cut(below.select("id", F.lit(depth).alias("depth"), F.col("value").alias("node")))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
    raise ValueError(f"a tree has more than {most_levels} levels")


def find_patterns(nodes: DataFrame, patterns: dict[str, object]) -> DataFrame:
    """``pattern, id, depth, node`` of the subtrees that each named pattern describes, at any depth; depth 0 is the tree itself."""
    found = [F.when(pattern_test(F.col("node"), p), F.lit(name)) for name, p in patterns.items()]
    named = nodes.select(F.explode(F.array_compact(F.array(*found))).alias("pattern"), "id", "depth", "node")
    return named


# Features of a tree's root by its kind, and by an attribute of it.
FEATURES = {
    "collection_op": ("collection", "iteration", "transform"),
    "loop": ("loop", "iteration", "repeat"),
    "lambda": ("lambda", "function", "closure", "anonymous"),
    "pattern_match": ("pattern", "match", "destructure", "case"),
    "binary_op": (),
    "function_call": ("call", "invoke", "function"),
    "conditional": ("conditional", "branch", "if", "choice"),
    "function_def": ("function", "definition", "def"),
    "container": ("container",),
    "child_spec": ("child_spec", "supervision", "otp"),
}
# The attribute that a kind is told apart by, and what its values add.
ATTRIBUTES = {
    "collection_op": ("op_type", {
        "map": ("map", "transform", "apply"), "filter": ("filter", "select", "predicate"),
        "reduce": ("reduce", "fold", "accumulate", "aggregate"), "find": ("find", "search", "locate"),
    }),
    "loop": ("loop_type", {"while": ("while", "conditional"), "for": ("for", "iterate"), "for_each": ("foreach", "each", "iterate")}),
    "binary_op": ("category", {"arithmetic": ("arithmetic", "calculation", "math"), "comparison": ("comparison", "predicate", "test"), "boolean": ("boolean", "logic")}),
    "container": ("container_type", {
        "module": ("module",), "class": ("class", "oop"), "namespace": ("namespace",), "actor": ("actor", "genserver", "process"),
        "supervisor": ("supervisor", "otp", "fault_tolerance"), "app": ("application", "otp", "lifecycle"), "fsm": ("state_machine", "fsm", "transitions"),
        "struct": ("struct", "data"), "enum": ("enum", "enumeration"), "proof": ("proof", "formal_verification"),
    }),
}
#: Attributes whose value is a feature itself, with what stands for a missing one.
NAMED = {"binary_op": (("operator", None),), "function_call": (("name", "unknown"),), "function_def": (("name", "unknown"),), "container": (("name", "unknown"),), "child_spec": (("kind", "worker"), ("module", "unknown"))}


def features(tree: Column) -> Column:
    """Tags of a tree ``[kind, attributes, children...]``: those of its kind, of its attributes, and its names; two for any other."""
    out = strings(("code", "construct"))
    for kind, base in FEATURES.items():
        attribute, values = ATTRIBUTES.get(kind, ("", {}))
        found = F.get_json_object(tree, f"$[1].{attribute}") if attribute else F.lit(None).cast("string")
        more = strings(("operation",) if kind == "binary_op" else ())
        for value, tags in values.items():
            more = F.when(found == value, strings(tags)).otherwise(more)
        names = [F.coalesce(F.get_json_object(tree, f"$[1].{n}"), F.lit(missing)) for n, missing in NAMED.get(kind, ())]
        named = F.array_compact(F.array(*names).cast("array<string>")) if names else strings(())
        parts = (strings(base), named, more) if kind == "container" else (strings(base), more, named)
        out = F.when(tag(tree) == kind, F.concat(*parts)).otherwise(out)
    return out
