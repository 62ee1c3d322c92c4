"""Word lists and the text functions that use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boosts of keyword sources, stop words, intent words and terms, synonyms,
# cross-language terms and boost settings by intent.
BOOSTS = {"doc": 1.5, "name": 1.0, "spec": 0.9, "string": 0.8, "comment": 0.6}
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might can could and or "
    "but not no nor for to from by with at in on of it its this that these those def defp defmodule end do fn true false "
    "nil when if else case cond import require use alias function return var let const class new self cls def async await "
    "module exports require"
).split()
EXPANSION_INTENTS = {
    "explain": ("explain", "how", "what", "understand", "learn"),
    "refactor": ("refactor", "improve", "optimize", "clean", "better"),
    "example": ("example", "show", "demonstrate", "sample", "usage"),
    "debug": ("debug", "fix", "bug", "error", "issue", "problem"),
}
RANKING_INTENTS = {
    "explain": ("explain", "how does", "what is", "understand"),
    "refactor": ("refactor", "improve", "optimize", "clean"),
    "example": ("example", "show me", "demonstrate", "sample"),
    "debug": ("debug", "fix", "bug", "error", "issue"),
}
INTENT_TERMS = {
    "explain": ("simple", "clear", "understand", "basic", "example"),
    "refactor": ("improve", "optimize", "clean", "better", "pattern"),
    "example": ("sample", "usage", "demo", "code", "implementation"),
    "debug": ("error", "exception", "failure", "issue", "problem", "trace"),
    "general": ("function", "code", "implementation"),
}
SYNONYMS = {
    "map": ("transform", "apply", "convert", "iterate"),
    "filter": ("select", "where", "predicate", "choose"),
    "reduce": ("fold", "accumulate", "aggregate", "combine"),
    "foreach": ("each", "iterate", "loop", "apply"),
    "find": ("search", "locate", "detect", "discover"),
    "loop": ("iterate", "repeat", "cycle", "while"),
    "if": ("conditional", "branch", "choice", "switch"),
    "match": ("pattern", "case", "switch", "destructure"),
    "function": ("method", "procedure", "routine", "callable"),
    "lambda": ("anonymous", "closure", "arrow", "inline"),
    "pure": ("immutable", "referential", "deterministic", "safe"),
    "list": ("array", "collection", "sequence", "vector"),
    "dict": ("map", "hash", "object", "table"),
    "tuple": ("pair", "record", "struct"),
    "sort": ("order", "arrange", "rank", "organize"),
    "reverse": ("flip", "invert", "backward"),
    "concat": ("join", "merge", "combine", "append"),
    "error": ("exception", "failure", "problem", "issue"),
    "debug": ("trace", "inspect", "diagnose", "troubleshoot"),
    "fix": ("repair", "correct", "resolve", "patch"),
}
CROSS_LANGUAGE = {
    "comprehension": ("map", "filter", "select", "transform"),
    "dict": ("map", "hash", "object", "table"),
    "arrow": ("lambda", "anonymous", "closure"),
    "promise": ("future", "async", "deferred", "task"),
    "pipe": ("chain", "compose", "flow", "thread"),
    "enum": ("collection", "iterable", "sequence"),
    "process": ("actor", "thread", "task", "worker"),
    "gen_server": ("server", "service", "handler"),
}
#: core, pure, complexity penalty, native
INTENT_BOOSTS = {
    "explain": (1.5, 1.4, 0.03, 0.8),
    "refactor": (1.0, 0.8, -0.01, 1.2),
    "example": (1.3, 1.1, 0.01, 1.1),
    "debug": (0.9, 0.7, -0.02, 1.3),
    "general": (1.2, 1.3, 0.02, 0.9),
}
EXTENDED_BOOST = 1.1


def strings(values) -> Column:
    """An array of string literals."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def intent(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """The first intent one of whose words stands anywhere in the text; ``general`` if none, or for null."""
    low = F.lower(text)
    out = F.lit("general")
    for name, words in reversed(lexicon.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def _looked_up(terms: Column, words: dict[str, tuple[str, ...]]) -> Column:
    pairs = F.create_map(*[c for k, v in words.items() for c in (F.lit(k), strings(v))])
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(pairs, t), strings(())))))


def expand_query(text: Column, max_terms: int = 5) -> Column:
    """The query followed by intent terms, synonyms and cross-language terms: first ``max_terms``, then without repeats."""
    terms = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    by_intent = F.create_map(*[c for k, v in INTENT_TERMS.items() for c in (F.lit(k), strings(v))])
    found = F.concat(
        F.element_at(by_intent, intent(text, EXPANSION_INTENTS)), _looked_up(terms, SYNONYMS), _looked_up(terms, CROSS_LANGUAGE)
    )
    return F.trim(F.concat_ws(" ", text, F.array_distinct(F.slice(found, 1, max_terms))))


def text_tokens(text: Column) -> Column:
    """Lower-case keywords of free text: ASCII words, camel case split, without stop words and single letters."""
    plain = F.regexp_replace(text, r"[^a-zA-Z0-9_\s-]", " ")
    apart = F.regexp_replace(F.replace(plain, F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2")
    return _kept(F.split(apart, r"\s+"))


def name_tokens(name: Column) -> Column:
    """Lower-case keywords of a name: dots, underscores and camel case split."""
    apart = F.regexp_replace(F.translate(name, "._", "  "), "([a-z])([A-Z])", "$1 $2")
    return _kept(F.split(apart, r"\s+"))


def _kept(tokens: Column) -> Column:
    low = F.transform(tokens, F.lower)
    return F.filter(low, lambda t: (F.length(t) >= 2) & ~t.isin(sorted(set(STOP_WORDS))))


def relevance_boost(weights: Column, terms: Column) -> Column:
    """1 plus the mean weight of the terms in a keyword map, at most 2; 1 without keywords or terms."""
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(weights, F.lower(t)), F.lit(0.0)))
    empty = (F.size(weights) == 0) | (F.size(terms) == 0)
    return F.when(empty, F.lit(1.0)).otherwise(1.0 + F.least(total / F.size(terms), F.lit(1.0)))


def meta_boost(level: Column, pure: Column, complexity: Column, settings: tuple[float, float, float, float]) -> Column:
    """Boost of a hit from its metadata; 1 if all of it is missing."""
    core, pure_boost, penalty, native = settings
    by_level = F.when(level == "native", native).when(level == "extended", EXTENDED_BOOST).otherwise(core)
    by_purity = F.when(F.coalesce(pure, F.lit(False)), pure_boost).otherwise(1.0)
    by_size = 1.0 - F.least(F.coalesce(complexity, F.lit(0)) * penalty, F.lit(0.5))
    missing = level.isNull() & pure.isNull() & complexity.isNull()
    return F.when(missing, F.lit(1.0)).otherwise(by_level * by_purity * by_size)


def enrich_query(query: Column, features: Column, most: int = 5) -> Column:
    """The query with the first ``most`` of the features that do not stand in it yet, in any case."""
    new = F.filter(F.coalesce(features, F.array().cast("array<string>")), lambda f: ~F.contains(F.lower(query), F.lower(f)))
    return F.trim(F.concat_ws(" ", query, F.slice(new, 1, most)))
