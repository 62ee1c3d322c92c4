"""Source trees as tables: scanning, language detection, text repair and extraction of modules, functions, calls, imports."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extensions by language.
LANGUAGES = {
    "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "py": "python", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "rb": "ruby", "hs": "haskell",
}
# Patterns of paths that are left out.
EXCLUDED = (
    "node_modules", ".git", ".hg", ".svn", "_build", "deps", "target", "dist", "build", "coverage", ".elixir_ls", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".bundle", "vendor/bundle",
)

ENTITIES = "path string, kind string, module string, name string, arity int, line int, visibility string, target string, error string"


def language(path: Column) -> Column:
    """The language that a path's extension names; null for others."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def scan(spark: SparkSession, folder: str, exclude: tuple[str, ...] = EXCLUDED, max_depth: int = 10) -> DataFrame:
    """``path, language, size, modified, hash, content`` of the source files under a folder.

    Hidden files, paths that hold an excluded pattern, other extensions and files deeper
    than ``max_depth`` are left out.  ``content`` has U+FFFD for bytes that are no UTF-8.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.substring_index("path", folder.rstrip("/").split(":", 1)[-1] + "/", -1)
    parts = F.split(below, "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    left_out = F.exists(F.array(*[F.lit(x) for x in exclude]).cast("array<string>"), lambda x: F.contains(below, x))
    kept = files.where(language(F.col("path")).isNotNull() & ~hidden & ~left_out & (F.size(parts) <= max_depth))
    return kept.select(
        below.alias("path"), language(F.col("path")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def changed(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """``path, status`` against the tracked ``path, hash``: new, changed, unchanged or deleted."""
    old = tracked.select(F.col("path").alias("_path"), F.col("hash").alias("_hash"))
    both = current.select("path", "hash").join(old, F.col("path") == F.col("_path"), "full")
    status = (
        F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "deleted").when(F.col("hash") == F.col("_hash"), "unchanged").otherwise("changed")
    )
    return both.select(F.coalesce("path", "_path").alias("path"), status.alias("status"))


def _module_name(path: str) -> str:
    return re.sub(r"\.[a-z]+$", "", path).replace("/", ".")


def python_entities(path: str, text: str) -> Iterator[dict]:
    """Modules, functions, calls and imports of a Python file."""
    tree = ast.parse(text)
    module = _module_name(path)
    yield {"kind": "module", "module": module, "line": 1}

    def walk(node: ast.AST, owner: str | None) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            inside = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inside = child.name
                visibility = "private" if child.name.startswith("_") else "public"
                yield {"kind": "function", "module": module, "name": child.name, "arity": len(child.args.args), "line": child.lineno, "visibility": visibility}
            elif isinstance(child, ast.Import):
                for alias in child.names:
                    yield {"kind": "import", "module": module, "target": alias.name, "line": child.lineno}
            elif isinstance(child, ast.ImportFrom):
                yield {"kind": "import", "module": module, "target": "." * child.level + (child.module or ""), "line": child.lineno}
            elif isinstance(child, ast.Call):
                target = ast.unparse(child.func)
                if re.fullmatch(r"[\w.]+", target):
                    yield {"kind": "call", "module": module, "name": owner, "target": target, "arity": len(child.args), "line": child.lineno}
            yield from walk(child, inside)

    yield from walk(tree, None)


_JS = {
    "import": re.compile(r"""^\s*import\b[^'"\n]*['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)""", re.M),
    "class": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", re.M),
    "function": re.compile(
        r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(([^)]*)\)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>", re.M
    ),
}


def script_entities(path: str, text: str) -> Iterator[dict]:
    """Modules, classes, functions and imports of a JavaScript or TypeScript file."""
    module = _module_name(path)
    line = lambda m: text.count("\n", 0, m.start()) + 1
    yield {"kind": "module", "module": module, "line": 1}
    for m in _JS["class"].finditer(text):
        yield {"kind": "module", "module": f"{module}.{m[1]}", "line": line(m)}
    for m in _JS["function"].finditer(text):
        arguments = (m[2] if m[1] else m[4]).strip()
        yield {"kind": "function", "module": module, "name": m[1] or m[3], "arity": len(arguments.split(",")) if arguments else 0, "line": line(m), "visibility": "public" if "export" in m[0] else "private"}
    for m in _JS["import"].finditer(text):
        yield {"kind": "import", "module": module, "target": m[1] or m[2], "line": line(m)}


EXTRACTORS = {"python": python_entities, "javascript": script_entities, "typescript": script_entities}


def entities(files: DataFrame, extractors=None) -> DataFrame:
    """All entities of ``path, language, content``; a file that cannot be read gives one row of kind ``error``."""
    known = extractors or EXTRACTORS
    names = ["path", "kind", "module", "name", "arity", "line", "visibility", "target", "error"]
    kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if lang not in known:
                    continue
                try:
                    rows += [{"path": path} | e for e in known[lang](path, text or "")]
                except (SyntaxError, ValueError, RecursionError) as problem:
                    rows.append({"path": path, "kind": "error", "error": str(problem)})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.select("path", "language", "content").mapInArrow(run, ENTITIES)


def graph_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, node_type, module, line`` and edges ``src, dst, edge_type, weight`` of extracted entities."""
    fn = F.format_string("%s.%s/%d", "module", "name", "arity")
    modules = found.where("kind = 'module'").select(F.col("module").alias("node"), F.lit("module").alias("node_type"), "module", "line")
    functions = found.where("kind = 'function'").select(fn.alias("node"), F.lit("function").alias("node_type"), "module", "line")
    defines = found.where("kind = 'function'").select(F.col("module").alias("src"), fn.alias("dst"), F.lit("defines").alias("edge_type"))
    imports = found.where("kind = 'import'").select(F.col("module").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("edge_type"))
    own = found.where("kind = 'function'").select("module", F.col("name").alias("_name"), fn.alias("_fn"))
    calls = (
        found.where("kind = 'call' AND name IS NOT NULL").select("module", "name", "target")
        .join(own, ["module"]).where(F.col("name") == F.col("_name")).select("module", "target", F.col("_fn").alias("src"))
        .join(own.select("module", F.col("_name").alias("target"), F.col("_fn").alias("dst")), ["module", "target"])
        .select("src", "dst", F.lit("calls").alias("edge_type"))
    )
    edges = defines.unionByName(imports).unionByName(calls).distinct().withColumn("weight", F.lit(1.0))
    return modules.unionByName(functions).distinct(), edges


_QUOTED = r"\"(?:[^\"\\]|\\.)*\""
_EITHER = _QUOTED + r"|'(?:[^'\\]|\\.)*'"
# How the languages write strings and comments.
STRINGS = {"elixir": _QUOTED, "erlang": _QUOTED, "python": _EITHER, "javascript": _EITHER + r"|`(?:[^`\\]|\\.)*`"}
COMMENTS = {"elixir": r"^\s*#\s*(.*)$", "erlang": r"^\s*%+\s*(.*)$", "python": r"^\s*#\s*(.*)$", "javascript": r"^\s*//\s*(.*)$"}


def _by_language(patterns: dict[str, str], expression) -> Column:
    out = None
    for name, pattern in patterns.items():
        out = (F if out is None else out).when(F.col("language") == name, expression(F.lit(pattern)))
    return out


def _numbered(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    lines = files.where(F.col("language").isin(*patterns)).select("path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return lines.withColumn("line", F.col("line") + 1)


def string_literals(files: DataFrame, least: int = 3) -> DataFrame:
    """``path, line, content`` of quoted strings of ``least`` characters or more in files ``path, language, content``."""
    found = _numbered(files, STRINGS).select("path", "line", F.explode(_by_language(STRINGS, lambda p: F.regexp_extract_all("text", p, F.lit(0)))).alias("content"))
    return found.withColumn("content", F.regexp_replace("content", r"^[\"'`]+|[\"'`]+$", "")).where(F.length("content") >= least)


def comment_blocks(files: DataFrame) -> DataFrame:
    """``path, line, content``: comment lines, those right below each other as one; ``line`` is the last of them."""
    said = F.trim(_by_language(COMMENTS, lambda p: F.get(F.regexp_extract_all("text", p, F.lit(1)), F.lit(0))))
    lines = _numbered(files, COMMENTS).select("path", "line", said.alias("content")).where(F.length("content") > 0)
    w = Window.partitionBy("path").orderBy("line")
    blocks = lines.withColumn("_block", F.col("line") - F.row_number().over(w)).groupBy("path", "_block")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), " ")
    return blocks.agg(F.max("line").alias("line"), joined.alias("content")).drop("_block")
