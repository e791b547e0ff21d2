"""File-level import graph and symbol-level call graph as edge tables.

Everything is keyed by the repository (``repo`` columns), so no edge crosses it and partitions stay small. Joins
are equi-joins: the suffix test of Python imports is turned into an equality on exploded name suffixes, and
candidates of a name are capped before the join, not after, so a popular name never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import paths as P

REPO = ["namespace", "project_id"]
SCRIPT_SUFFIXES = ("", ".js", ".ts", "/index.js", "/index.ts")
MAX_CANDIDATES = 5


def import_rows(analyses: DataFrame) -> DataFrame:
    """``(repo, file_path, language, ord, import)`` of ``analyses(repo, file_path, language, imports)``.

    Null import lists have no rows; repeated file rows count once.
    """
    one = analyses.select(*REPO, "file_path", "language", "imports").distinct()
    return one.select(*REPO, "file_path", "language", F.posexplode("imports").alias("ord", "import")).where(
        "`import` IS NOT NULL"
    )


def resolve_imports(imports: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """``imports`` with ``target``: the file an import names, or null.

    Scripts: relative imports only, first of five endings. Python: a file whose path ends with the module's
    path (``strict``: at a folder's boundary). Go: a Go file in a folder named like the last part. Among
    several the smallest path wins. Other languages resolve nothing.
    """
    files = files.select(*REPO, F.col("file_path").alias("file")).distinct()
    key = [*REPO, "file_path", "ord", "import"]
    order = F.col("import")

    script = imports.where("language = 'javascript' AND (`import` LIKE './%' OR `import` LIKE '../%')")
    base = P.normalize(F.concat(P.dir_name(F.col("file_path")), F.lit("/"), order))
    endings = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("ending")) for i, s in enumerate(SCRIPT_SUFFIXES)))
    tried = script.select(*key, F.explode(endings).alias("e"), base.alias("base"))
    tried = tried.select(*key, F.col("e.rank").alias("rank"), F.concat("base", "e.ending").alias("file"))
    from_script = tried.join(files, [*REPO, "file"]).groupBy(*key).agg(F.min_by("file", "rank").alias("target"))

    # A file answers to the suffixes of its own name and, for packages, of its folder's name.
    name = P.base_name(F.col("file"))
    package = name == "__init__.py"
    own = F.when(package, P.base_name(P.dir_name(F.col("file")))).otherwise(F.regexp_replace(name, r"\.py$", ""))
    cut = F.lit(1) if strict else F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("own")))
    suffixes = F.array(F.col("own")) if strict else F.transform(cut, lambda i: F.substring("own", i, F.length("own")))
    python_files = files.where(F.col("file").endswith(".py")).withColumn("own", own)
    answers = python_files.select(*REPO, "file", F.explode(suffixes).alias("last")).where("last <> ''")
    module = F.replace(order, F.lit("."), F.lit("/"))
    wanted = imports.where("language = 'python'").select(
        *key, P.dotted_last(order).alias("last"), F.concat(module, F.lit(".py")).alias("a"), F.concat(module, F.lit("/__init__.py")).alias("b")
    )
    edge = F.lit("/") if strict else F.lit("")
    fits = F.concat(F.lit("/"), F.col("file")).endswith(F.concat(edge, F.col("a"))) | F.concat(F.lit("/"), F.col("file")).endswith(F.concat(edge, F.col("b")))
    from_python = wanted.join(answers, [*REPO, "last"]).where(fits).groupBy(*key).agg(F.min("file").alias("target"))

    go_files = files.where(F.col("file").endswith(".go")).select(*REPO, "file", P.base_name(P.dir_name(F.col("file"))).alias("last"))
    go_dirs = go_files.groupBy(*REPO, "last").agg(F.min("file").alias("target"))
    go = imports.where("language = 'go'").select(*key, F.substring_index(order, "/", -1).alias("last"))
    from_go = go.join(go_dirs, [*REPO, "last"]).select(*key, "target")

    found = from_script.unionByName(from_python).unionByName(from_go)
    return imports.join(found, key, "left")


def import_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``(repo, src, dst)``; a file importing itself has no edge."""
    return (
        resolved.where("target IS NOT NULL AND target <> file_path")
        .select(*REPO, F.col("file_path").alias("src"), F.col("target").alias("dst"))
        .distinct()
    )


def unresolved_imports(resolved: DataFrame) -> DataFrame:
    """``(repo, src, ord, import)`` of imports without a target or of the file itself; repeats stay."""
    return resolved.where("target IS NULL OR target = file_path").select(*REPO, F.col("file_path").alias("src"), "ord", "import")


def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(repo, node, out, in)``: sorted neighbours both ways; nodes without one side have an empty list there."""
    out = edges.select(*REPO, F.col(src).alias("node"), F.col(dst).alias("out"), F.lit(None).cast("string").alias("in"))
    back = edges.select(*REPO, F.col(dst).alias("node"), F.lit(None).cast("string").alias("out"), F.col(src).alias("in"))
    both = out.unionByName(back).groupBy(*REPO, "node")
    return both.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("out", "in")))


def symbol_names(functions: DataFrame) -> DataFrame:
    """``(repo, symbol, file_path, ord, name)``: each function under its full name and its last part."""
    both = F.array_distinct(F.array(F.col("name"), P.dotted_last(F.col("name"))))
    return functions.select(*REPO, "file_path", "ord", "name", F.explode(both).alias("symbol"))


def resolve_calls(calls: DataFrame, functions: DataFrame, cap: int = MAX_CANDIDATES) -> DataFrame:
    """``(repo, file_path, name, call, callee_file, callee)``; ``callee`` null: an external call.

    ``calls(repo, file_path, name, call)`` are distinct raw calls of functions. Calls of a function to its own
    name are dropped. Functions of the same file come first; otherwise the first ``cap`` of the repository
    in discovery order (path, ordinal). Several functions of one name in a file are one node.
    """
    own = (F.col("call") == F.col("name")) | (F.col("call") == P.dotted_last(F.col("name")))
    raw = calls.select(*REPO, "file_path", "name", "call").distinct().where(~own)
    names = symbol_names(functions)
    near = names.select(*REPO, "file_path", F.col("symbol").alias("call"), F.col("name").alias("callee")).distinct()
    first = Window.partitionBy(*REPO, "symbol").orderBy("file_path", "ord")
    far = (
        names.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= cap)
        .select(*REPO, F.col("symbol").alias("call"), F.col("file_path").alias("callee_file"), F.col("name").alias("callee")).distinct()
    )
    here = raw.join(near, [*REPO, "file_path", "call"], "left")
    same = here.where("callee IS NOT NULL").select(*REPO, "file_path", "name", "call", F.col("file_path").alias("callee_file"), "callee")
    rest = here.where("callee IS NULL").drop("callee").join(far, [*REPO, "call"], "left")
    return same.unionByName(rest.select(same.columns))


def call_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``(repo, src, dst)`` between ``file::function`` keys."""
    key = lambda f, n: F.concat(F.col(f), F.lit("::"), F.col(n))
    return (
        resolved.where("callee IS NOT NULL")
        .select(*REPO, key("file_path", "name").alias("src"), key("callee_file", "callee").alias("dst"))
        .distinct()
    )


def external_calls(resolved: DataFrame) -> DataFrame:
    """Distinct ``(repo, file_path, name, call)`` that no known function answers to."""
    return resolved.where("callee IS NULL").select(*REPO, "file_path", "name", "call").distinct()


def readable(keys: Column) -> Column:
    """Names of ``file::function`` keys, cut at the first ``::``."""
    return F.transform(keys, lambda k: F.substring(k, F.position(F.lit("::"), k) + 2, F.length(k)))
