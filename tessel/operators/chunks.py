"""Five kinds of chunks of a file: imports, functions, types, a summary, and the whole file as a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions.keys import chunk_id
from tessel.functions.paths import base_name
from tessel.operators.lines import body_end_by_braces, body_end_by_indent

SUMMARY_FUNCTIONS, SUMMARY_TYPES, SUMMARY_IMPORTS = 20, 20, 15


def import_lines(all_lines: Column, language: Column) -> Column:
    """Stripped lines that import something, by the rules of the language; none for other languages."""
    bare = F.transform(all_lines, T.strip)
    python = F.filter(bare, lambda x: x.startswith("import ") | x.startswith("from "))
    go = F.filter(bare, lambda x: x.startswith("import ") | (x.startswith("(") & x.contains("import")))
    script = F.filter(
        bare,
        lambda x: x.startswith("import ") | x.startswith("require(") | (x.contains("from ") & (x.contains("import") | x.contains("require"))),
    )
    none = F.array().cast("array<string>")
    return F.when(language == "python", python).when(language == "go", go).when(language.isin("javascript", "typescript"), script).otherwise(none)


def body(all_lines: Column, line: Column, language: Column, is_type: bool = False, before: int = 10) -> Column:
    """Text of a symbol: from ten lines above its start to the end its language's rule finds."""
    start = F.greatest(F.lit(0), line - 1)
    default = 40 if is_type else 30
    end = (
        F.when(language == "python", body_end_by_indent(all_lines, start, 300 if is_type else 200))
        .when(language.isin("go", "javascript", "typescript"), body_end_by_braces(all_lines, start, 400 if is_type else 300, default))
        .otherwise(F.least(F.size(all_lines), start + default))
    )
    low = F.greatest(F.lit(0), start - before)
    part = F.when(end > low, F.slice(all_lines, low + 1, end - low)).otherwise(F.array().cast("array<string>"))
    return F.concat(T.rstrip(F.array_join(part, "\n")), F.lit("\n"))


def summary_text(path: Column, package: Column, functions: Column, types: Column, imports: Column) -> Column:
    """The summary of a file; lines without content are left out."""
    def listed(title: str, names: Column, most: int) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(names, 1, most), ", ")))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path),
        F.when(F.coalesce(package, F.lit("")) != "", F.concat(F.lit("Package: "), package)),
        listed("Functions", functions, SUMMARY_FUNCTIONS),
        listed("Types", types, SUMMARY_TYPES),
        listed("Imports", imports, SUMMARY_IMPORTS),
    )


def summaries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(file_path, package, functions, types, imports)`` with names in order of discovery."""
    pick = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "name")))), lambda x: x["name"]
    )
    grouped = symbols.groupBy("file_path").agg(pick("function").alias("functions"), pick("type").alias("types"), pick("import").alias("imports"))
    none = F.array().cast("array<string>")
    return files.join(grouped, "file_path", "left").select(
        *files.columns, *(F.coalesce(c, none).alias(c) for c in ("functions", "types", "imports"))
    )


def chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All chunks of ``files(file_path, language, package, text)`` with their ids.

    Keys a kind doesn't have are null. Files with no symbol and no import get a chunk of the whole text.
    """
    base = files.select("file_path", "language", "package", "text").withColumn("lines", T.lines(F.col("text")))
    held = summaries(base, symbols)
    if "body" not in symbols.columns:
        symbols = symbols.withColumn("body", F.lit(None).cast("string"))
    named = symbols.where("kind IN ('function', 'type')")
    # bodies cut while parsing need the file's text no more; only symbols of the line readers still do
    cut = files.select("file_path", "language", "package").join(named.where("body IS NOT NULL"), "file_path")
    text = named.where("body IS NULL").drop("body").join(base, "file_path")
    text = text.withColumn("body", F.when(F.col("kind") == "type", body(F.col("lines"), F.col("line"), F.col("language"), True)).otherwise(body(F.col("lines"), F.col("line"), F.col("language"))))
    per_symbol = cut.unionByName(text.select(cut.columns))
    shared = ["file_path", "language", "package"]

    written = import_lines(F.col("lines"), F.col("language"))
    listed = F.when(F.size(written) > 0, written).otherwise(F.col("imports"))
    imports = held.where(F.size("imports") > 0).select(
        *shared, F.lit("imports").alias("chunk_type"), F.array_join(listed, "\n").alias("content"),
        F.size(listed).alias("import_count"), listed.alias("imports"),
    )
    functions = per_symbol.where("kind = 'function'").select(
        *shared, F.lit("function").alias("chunk_type"), F.col("body").alias("content"),
        F.lit("function").alias("symbol_type"), F.col("name").alias("symbol_name"), F.col("name").alias("function_name"),
        F.col("line").alias("line_number"), "signature", "docstring", "params", "return_type",
    )
    types = per_symbol.where("kind = 'type'").select(
        *shared, F.lit("class").alias("chunk_type"), F.col("body").alias("content"),
        F.coalesce(F.nullif("type_kind", F.lit("")), F.lit("class")).alias("symbol_type"), F.col("name").alias("symbol_name"),
        F.col("name").alias("class_name"), F.col("line").alias("line_number"), "docstring",
    )
    name = base_name(F.col("file_path"))
    summary = held.select(
        *shared, F.lit("file_summary").alias("chunk_type"),
        summary_text(F.col("file_path"), F.col("package"), F.col("functions"), F.col("types"), F.col("imports")).alias("content"),
        F.lit("file").alias("symbol_type"), name.alias("symbol_name"),
        F.size("functions").alias("function_count"), F.size("types").alias("class_count"),
    )
    empty = F.concat(F.lit("# File: "), "file_path", F.lit("\n# Language: "), F.coalesce("language", F.lit("")), F.lit("\n# [Empty file]"))
    alone = held.where((F.size("functions") == 0) & (F.size("types") == 0) & (F.size("imports") == 0))
    whole = alone.select(
        *shared, F.lit("file").alias("chunk_type"), F.when(T.strip(F.col("text")) == "", empty).otherwise(F.col("text")).alias("content"),
        F.lit("file").alias("symbol_type"), name.alias("symbol_name"),
    )
    out = imports
    for part in (functions, types, summary, whole):
        out = out.unionByName(part, allowMissingColumns=True)
    key = chunk_id(F.col("file_path"), F.col("chunk_type"), F.col("function_name"), F.col("class_name"), F.col("symbol_name"), line=F.col("line_number"))
    return out.withColumn("chunk_id", key)


def with_import_graph(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks with ``depends_on`` and ``imported_by`` of their file; files outside the graph have empty lists."""
    none = F.array().cast("array<string>")
    neighbours = nodes.select(F.col("node").alias("file_path"), F.col("out").alias("depends_on"), F.col("in").alias("imported_by"))
    joined = parts.join(neighbours, "file_path", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("depends_on", "imported_by")})


def with_call_graph(parts: DataFrame, nodes: DataFrame, external: DataFrame) -> DataFrame:
    """Function chunks with ``calls``, ``called_by`` and ``external_calls``; null on other kinds."""
    from tessel.operators.graphs import readable

    key = F.when(F.col("chunk_type") == "function", F.concat("file_path", F.lit("::"), "function_name"))
    graph = nodes.select(F.col("node").alias("__key"), readable(F.col("out")).alias("calls"), readable(F.col("in")).alias("called_by"))
    outside = external.groupBy(F.concat("file_path", F.lit("::"), "name").alias("__key")).agg(F.array_sort(F.collect_set("call")).alias("external_calls"))
    none = F.array().cast("array<string>")
    joined = parts.withColumn("__key", key).join(graph, "__key", "left").join(outside, "__key", "left").drop("__key")
    is_function = F.col("chunk_type") == "function"
    return joined.withColumns({c: F.when(is_function, F.coalesce(c, none)) for c in ("calls", "called_by", "external_calls")})
