"""Queries of the core operators over the driver's tables, each with its SQL equivalent.

Every query runs over its whole tables. SQL is built from the same fixed tables (extensions, ignored
directories) as the operators, but states the logic on its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import paths as P
from tessel.functions import text as T
from tessel.functions import vectors as V
from tessel.functions.keys import chunk_id, iso_utc
from tessel.operators import chunks as C
from tessel.operators import graphs as G
from tessel.operators import lines as L
from tessel.operators import metadata, registry, routing, scanning, symbols
from tessel.operators import vector_index as I
from tessel.operators.embedding import LOCAL_LIMIT, HashingEmbedder, PooledEmbedder, ServiceEmbedder, embed, embedder_choice as choice
from tessel.plans.engine import packages
from tessel.session import stored, table

CUT = "2025-07-01"  # earlier rows of the vector table are taken as stored, later ones as coming in
SEARCH_TEXT = "the worker skips the stale snapshot while the queue reloads the cursor"


# ---- vectors ------------------------------------------------------------------------------------------


def _query_vector(rows: DataFrame) -> list[float]:
    return rows.where("vec_id = 0").first()["embedding"]


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 vectors most similar to vector 0."""
    rows = table(spark, sf, "embeddings")
    return I.search(rows, _query_vector(rows), 5, "vec_id", digits=6).select("vec_id", "similarity_score", "rank")


def knn_tenant(spark: SparkSession, sf: str) -> DataFrame:
    """The same among the vectors of one label, the tenant's predicate."""
    rows = table(spark, sf, "embeddings")
    query = rows.where("vec_id = 0").first()
    own = rows.where(F.col("label") == query["label"])
    return I.search(own, query["embedding"], 5, "vec_id", digits=6).select("vec_id", "similarity_score", "rank")


def knn_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all vectors, negative ones as 0."""
    rows = table(spark, sf, "embeddings")
    return I.search(rows, _query_vector(rows), 1_000_000, "vec_id", digits=6, clamp=True).select("vec_id", "similarity_score")


def knn_default(spark: SparkSession, sf: str) -> DataFrame:
    """The same as ``knn_topk``, without a number of hits: five."""
    rows = table(spark, sf, "embeddings")
    return I.search(rows, _query_vector(rows), None, "vec_id", digits=6).select("vec_id", "similarity_score", "rank")


def knn_code(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 rows of one namespace most similar to its row with the smallest id, by exact scan."""
    rows = table(spark, sf, "vector_store").where("namespace = 'kestrel-works' AND size(embedding) = 64")
    rows = rows.withColumn("norm", V.norm(F.col("embedding"))).where("norm > 0")
    query = rows.orderBy("id").first()
    return I.search(rows, query["embedding"], 10, "id", digits=6).select("id", "similarity_score", "rank")


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each vector and the first component of its unit vector."""
    unit = V.unit(F.col("embedding"))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(unit[0], 6).alias("first")
    )


def vector_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """How many vectors have which length."""
    return I.dimensions(table(spark, sf, "vector_store").where("embedding IS NOT NULL"))


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 documents most similar to a text, by hashed tokens."""
    hashing = HashingEmbedder()
    rows = embed(table(spark, sf, "documents").select("doc_id", "text"), hashing, "text")
    query = [float(x) for x in hashing.encode([SEARCH_TEXT])[0]]
    return I.search(rows, query, 5, "doc_id", digits=4).select("doc_id", "similarity_score", "rank")


def _answer(texts: list[str], kind: str) -> list[dict]:
    """A service whose vector of a text is its length and kind, answering in another order than asked."""
    return [{"index": i, "embedding": [len(t), float(kind == "document")]} for i, t in reversed(list(enumerate(texts)))]


def service_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents embedded by a batched service, its answers put in order."""
    rows = embed(table(spark, sf, "documents").select("doc_id", "text"), ServiceEmbedder(_answer, 2, batch=7), "text")
    return rows.select("doc_id", F.col("embedding")[0].cast("bigint").alias("size"), F.col("embedding")[1].cast("bigint").alias("stored"))


def _states(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four token states of 16 components out of the text of 64 numbers, the last of them masked."""
    x = np.array([json.loads(t) for t in texts]).reshape(len(texts), 4, 16)
    return x, np.tile([1, 1, 1, 0], (len(texts), 1))


def pooled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors read as four token states, the unmasked ones averaged and scaled to unit length."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("text"))
    return embed(rows, PooledEmbedder(_states, 16), "text").select("vec_id", (F.round(F.col("embedding")[0].cast("double"), 2) + F.lit(0.0)).alias("first"))


# ---- the vector table ---------------------------------------------------------------------------------


def tenant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors per tenant."""
    return I.tenant_counts(table(spark, sf, "vector_store"))


def tenant_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors per tenant after one namespace is deleted."""
    return I.tenant_counts(I.delete_tenant(table(spark, sf, "vector_store"), "kestrel-works"))


def _stored_and_incoming(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "vector_store").select(*I.KEY, "id", "created_at")
    cut = F.lit(f"{CUT} 00:00:00+00:00").cast("timestamp")
    stored = I.latest(rows.where(F.col("created_at") < cut), I.KEY, F.col("created_at").desc(), F.col("id").desc())
    return stored, rows.where(F.col("created_at") >= cut).withColumn("seq", F.struct("created_at", "id"))


def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The table after an upsert: payload of the last delivery, creation time of the first."""
    stored, incoming = _stored_and_incoming(spark, sf)
    merged = I.upsert(stored.withColumn("seq", F.struct("created_at", "id")), incoming, sequence="seq")
    return merged.select(*I.KEY, "id", iso_utc(F.col("created_at")).alias("created"))


def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored chunks that a full replacement would drop."""
    stored, incoming = _stored_and_incoming(spark, sf)
    return I.stale(stored, incoming).select(*I.KEY, "id")


def live_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The live row of each chunk."""
    rows = table(spark, sf, "vector_store").select(*I.KEY, "id", "created_at")
    return I.latest(rows, I.KEY, F.col("created_at").desc(), F.col("id").desc()).select(*I.KEY, "id")


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The content address of every row, computed anew."""
    rows = table(spark, sf, "vector_store")
    made = chunk_id(F.col("file_path"), F.col("chunk_type"), F.col("symbol_name"), line=F.col("line_number"))
    return rows.select("id", made.alias("made"), (made == F.col("chunk_id")).alias("same"))


def metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the JSON metadata; null where it is missing or cut off."""
    rows = table(spark, sf, "vector_store")
    return rows.select("id", *(metadata.field(F.col("metadata"), c).alias(c) for c in ("language", "package", "symbol_type")))


def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Line of each row's content on which its symbol's name first occurs."""
    rows = table(spark, sf, "vector_store").where("symbol_name IS NOT NULL AND symbol_name <> ''")
    return rows.select("id", T.first_line_of(F.col("content"), F.col("symbol_name")).alias("line"))


# ---- files --------------------------------------------------------------------------------------------


def scan_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Every file with the reason the scanner skips it for."""
    files = table(spark, sf, "source_files").select("path", "rel_path", "length").distinct()
    return files.select("path", "length", scanning.skip_reason(F.col("rel_path"), F.col("length")).alias("reason"))


def language_route(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every file, and the reader of configuration files."""
    paths = table(spark, sf, "source_files").select("path").distinct()
    lang = routing.language(F.col("path"))
    return paths.select("path", lang.alias("language"), F.when(lang == "config", routing.config_dialect(F.col("path"))).alias("dialect"))


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Folder, name, stem and extension of every path."""
    path = F.col("path")
    return table(spark, sf, "source_files").select(
        "path", P.dir_name(path).alias("folder"), P.base_name(path).alias("name"), P.stem(path).alias("stem"), P.extension(path).alias("ext")
    ).distinct()


def line_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, and the frame around line 12, of every document."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    lines = T.lines(F.col("text"))
    return docs.select("doc_id", F.size(lines).alias("n_lines"), F.md5(L.frame(lines, F.lit(12))).alias("frame"))


_CONFIG = "(chunk_type = 'file' OR chunk_type = 'function') AND file_path RLIKE '[.](env|conf|properties)$'"


def key_value_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of key-value texts with their section and comment."""
    rows = table(spark, sf, "vector_store").where(_CONFIG)
    return L.key_values(rows, "content", "id")


def shell_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions and aliases in rows of shell files."""
    rows = table(spark, sf, "vector_store").where("chunk_type IN ('file', 'function') AND file_path RLIKE '[.](sh|bash)$'")
    return L.shell_symbols(rows, "content", "id")


def shell_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What rows of shell files source."""
    rows = table(spark, sf, "vector_store").where("file_path RLIKE '[.](sh|bash)$'")
    return L.shell_imports(rows, "content", "id")


def config_includes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all rows that the reader of configuration texts would take for an include."""
    return L.config_imports(table(spark, sf, "vector_store"), "content", "id")


def import_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every row that import something, by the language of its file."""
    rows = table(spark, sf, "vector_store").where("content IS NOT NULL")
    lines = C.import_lines(T.lines(F.col("content")), routing.language(F.col("file_path")))
    return rows.select("id", F.size(lines).alias("n"), F.md5(F.array_join(lines, "\n")).alias("lines"))


def default_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The body window of rows in languages without a rule for a body's end."""
    rows = table(spark, sf, "vector_store").where("content IS NOT NULL AND file_path RLIKE '[.](rs|rb|lua|java|c|h)$'")
    text = C.body(T.lines(F.col("content")), F.lit(1), routing.language(F.col("file_path")))
    return rows.select("id", F.md5(text).alias("body"))


def shebang_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of rows by their first line, as if their files' names had no extension."""
    rows = table(spark, sf, "vector_store").where("file_path IS NOT NULL AND content LIKE '#!%'")
    bare = F.concat(P.dir_name(F.col("file_path")), F.lit("/run"))
    return rows.select("id", routing.language(bare, F.regexp_extract("content", r"^([^\r\n]*)", 1)).alias("language"))


def routed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Files per language and reader; files of no known language vanish."""
    known = _routed(spark, sf)
    dialect = F.when(F.col("language") == "config", F.col("dialect"))
    return known.groupBy("language", dialect.alias("dialect")).agg(F.count(F.lit(1)).alias("n"))


def package_names(spark: SparkSession, sf: str) -> DataFrame:
    """Package of every file, if every second folder of a repository were a Python package."""
    paths = table(spark, sf, "file_analysis").select(F.col("file_path").alias("path")).distinct()
    marked = paths.select(F.concat(P.dir_name(F.col("path")), F.lit("/__init__.py")).alias("path")).where("length(path) % 2 = 0")
    return packages(paths.union(marked).distinct())


def collapsed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with runs of white space as one space."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("text"))


def flat_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of functions for a store of scalars: lists as JSON."""
    return metadata.flat(table(spark, sf, "function_info").select("file_path", "ord", "return_type", "params").distinct())


def restored_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of ``flat_metadata``, read back."""
    rows = metadata.restored(flat_metadata(spark, sf))
    return rows.select("file_path", "ord", F.array_join("params", "|").alias("params"), F.size("params").alias("n"))


def function_table(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that parsing finds in all languages, in the files of the given table of functions."""
    known = table(spark, sf, "function_info").select("file_path").distinct()
    rows = source_symbols(spark, sf).where("kind = 'function'").join(known, "file_path", "left_semi")
    return rows.select("file_path", "ord", "name", "line", "signature", F.array_join(F.coalesce("params", F.array().cast("array<string>")), "|").alias("params"))


def summary_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the summary chunks of all source files."""
    return source_chunks(spark, sf).where("chunk_type = 'file_summary'").select("file_path", "chunk_id")


def function_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the function chunks, in the files of the given table of functions."""
    known = table(spark, sf, "function_info").select("file_path").distinct()
    return source_chunks(spark, sf).where("chunk_type = 'function'").join(known, "file_path", "left_semi").select("file_path", "chunk_id")


def json_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and types that the JSON reader finds in rows that hold whole files."""
    rows = table(spark, sf, "vector_store").where("chunk_type = 'file' AND lower(file_path) LIKE '%.json' AND content IS NOT NULL")
    files = rows.select(F.col("id").cast("string").alias("path"), F.lit("config").alias("language"), F.lit("json").alias("dialect"), F.encode("content", "UTF-8").alias("content"))
    return symbols.extract_symbols(files).where("kind <> 'unread'").select(F.col("file_path").cast("bigint").alias("id"), "kind", "name", "type_kind")


# What a line of a plainly written configuration text looks like, by dialect; Java and RE2 agree on these.
_PLAIN_LINE = {
    "toml": r'^(\s*|#.*|\[[A-Za-z0-9_]+\]|[A-Za-z0-9_]+ = ("[^"\\]*"|[0-9]+|true|false))$',
    "ini": r"^(\s*|[#;].*|\[[A-Za-z0-9_]+\]|[A-Za-z0-9_]+ = \S.*)$",
    "yaml": r'^(\s*|#.*|[A-Za-z0-9_]+:|  [A-Za-z0-9_]+: ("[^"\\]*"|[A-Za-z0-9_./-]+))$',
}


def config_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and types that the TOML, INI and YAML readers find in plainly written whole files."""
    rows = table(spark, sf, "vector_store").where("chunk_type = 'file' AND file_path IS NOT NULL AND content IS NOT NULL")
    dialect = routing.config_dialect(F.col("file_path"))
    rows = rows.withColumn("dialect", dialect).withColumn("lines", T.lines(F.col("content")))
    fits = lambda pattern: F.forall("lines", lambda x: x.rlike(pattern))
    plain = F.lit(False)
    for name, pattern in _PLAIN_LINE.items():
        plain = plain | ((F.col("dialect") == name) & fits(pattern))
    files = rows.where(plain).select(
        F.concat_ws("|", F.col("id").cast("string"), "dialect").alias("path"), F.lit("config").alias("language"), "dialect", F.encode("content", "UTF-8").alias("content")
    )
    found = symbols.extract_symbols(files).where("kind <> 'unread'")
    part = F.split("file_path", "[|]")
    return found.select(part[0].cast("bigint").alias("id"), part[1].alias("dialect"), "kind", "name").distinct()


def file_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The summary text of every file."""
    files = table(spark, sf, "file_analysis").select("file_path", "package", "imports").distinct()
    names = table(spark, sf, "function_info").select("file_path", "ord", "name").distinct().withColumn("kind", F.lit("function"))
    held = C.summaries(files.select("file_path").distinct(), names).drop("imports")
    none = F.array().cast("array<string>")
    text = C.summary_text(F.col("file_path"), F.col("package"), F.col("functions"), none, F.coalesce("imports", none))
    return files.join(held, "file_path").select("file_path", text.alias("content"))


def python_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that parsing finds in the Python files; the given table of functions is the reference."""
    return _symbols(spark, sf).where("kind = 'function' AND lower(file_path) LIKE '%.py'").select("file_path", "ord", "name", "line", "signature")


def _routed(spark: SparkSession, sf: str, *languages: str) -> DataFrame:
    """Every source file of a known language, or of ``languages``, one content per path, on all cores."""
    files = routing.routed(table(spark, sf, "source_files").select("path", "content"))
    if languages:
        files = files.where(F.col("language").isin(*languages))
    one = files.groupBy("path").agg(F.max(F.struct("content", "language")).alias("f")).select("path", "f.*")
    return one.withColumn("dialect", routing.config_dialect(F.col("path")))


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.extract_symbols(_routed(spark, sf))


def _source_texts(spark: SparkSession, sf: str, *languages: str) -> DataFrame:
    """``(path, language, text)`` of the files of ``_routed``."""
    return symbols.decoded(_routed(spark, sf, *languages), "path", "language")


def source_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols of all source files, those of the line readers included."""
    small = stored(_source_texts(spark, sf, "shell", "config"))
    return symbols.with_line_readers(stored(_symbols(spark, sf).drop("body")), small)


def source_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all source files, with their ids and the md5 of their text."""
    # five kinds of chunks and the line readers read texts and symbols, so both are made once
    names = packages(table(spark, sf, "source_files").select("path").distinct())
    texts = _source_texts(spark, sf).withColumnRenamed("path", "file_path")
    base = stored(texts.join(names, "file_path", "left"))
    files = base.select(F.col("file_path").alias("path"), "language", "text")
    read = files.withColumns({"dialect": routing.config_dialect(F.col("path")), "content": F.encode("text", "UTF-8")})
    held = files.where("language IN ('shell', 'config')")
    parts = C.chunks(base, stored(symbols.with_line_readers(stored(symbols.extract_symbols(read)), held)))
    return parts.select("file_path", "chunk_type", "symbol_name", "line_number", "chunk_id", F.md5("content").alias("content"))


def indent_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Where the block that the first line of each Python row opens ends."""
    rows = table(spark, sf, "vector_store").where("chunk_type IN ('function', 'class') AND lower(file_path) LIKE '%.py'")
    lines = T.lines(F.col("content"))
    return rows.select("id", L.body_end_by_indent(lines, F.lit(0)).alias("end"))


def brace_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Where the first braces opened in each Go or script row are closed."""
    rows = table(spark, sf, "vector_store").where("chunk_type = 'function' AND file_path RLIKE '[.](go|js|ts|mjs|cjs)$'")
    return rows.select("id", L.body_end_by_braces(T.lines(F.col("content")), F.lit(0)).alias("end"))


# ---- graphs -------------------------------------------------------------------------------------------


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """The analyses; besides its own imports each file imports the next of its language in the repository.

    The imports of the table name nothing in it, so without such links no import would resolve.
    """
    analyses = table(spark, sf, "file_analysis").withColumn("language", routing.language(F.col("file_path")))
    files = analyses.select(*G.REPO, "file_path", "language").distinct()
    after = F.lead("file_path").over(Window.partitionBy(*G.REPO, "language").orderBy("file_path"))
    own, other = (F.regexp_replace(c, "^/repos/[^/]+/[^/]+/", "") for c in (F.col("file_path"), F.col("after")))
    module = F.replace(F.regexp_replace(other, r"[.][^./]*$", ""), F.lit("/"), F.lit("."))
    relative = F.concat(F.lit("./"), F.repeat(F.lit("../"), T.count_of(own, "/")), other)
    link = F.when(F.col("language") == "python", module).when(F.col("language") == "javascript", relative).when(
        F.col("language") == "go", F.concat(F.lit("mod.example/"), P.base_name(P.dir_name(other)))
    )
    links = files.withColumn("after", after).select(*G.REPO, "file_path", "language", F.array(link).alias("imports")).where("imports[0] IS NOT NULL")
    return analyses.select(*G.REPO, "file_path", "language", "imports").unionByName(links)


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    analyses = _linked(spark, sf)
    return G.resolve_imports(G.import_rows(analyses).distinct(), analyses)


def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Files that import files of their repository."""
    return G.import_edges(_imports(spark, sf))


def unresolved_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Imports that name no file of the repository."""
    return G.unresolved_imports(_imports(spark, sf))


def import_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every file in the import graph."""
    nodes = G.adjacency(G.import_edges(_imports(spark, sf)))
    return nodes.select("node", F.array_join("out", ",").alias("depends_on"), F.array_join("in", ",").alias("imported_by"))


def enriched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the vector table with the size of their file's neighbourhood."""
    nodes = G.adjacency(G.import_edges(_imports(spark, sf))).drop(*G.REPO)
    rows = C.with_import_graph(table(spark, sf, "vector_store").select("id", "file_path"), nodes)
    return rows.select("id", F.size("depends_on").alias("n_out"), F.size("imported_by").alias("n_in"))


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    part = F.split("file_path", "/")
    return table(spark, sf, "function_info").select(
        part[2].alias("namespace"), part[3].alias("project_id"), "file_path", "ord", "name"
    ).distinct()


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "vector_store").where("chunk_type = 'function' AND file_path IS NOT NULL AND symbol_name IS NOT NULL")
    found = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1)))
    raw = rows.select(*G.REPO, "file_path", F.col("symbol_name").alias("name"), found.alias("call"))
    return G.resolve_calls(raw, _functions(spark, sf))


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Calls between functions of a repository."""
    return G.call_edges(_calls(spark, sf))


def external_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that no function of the repository answers."""
    return G.external_calls(_calls(spark, sf))


def called_by(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions call each function."""
    nodes = G.adjacency(G.call_edges(_calls(spark, sf)))
    return nodes.where("size(`in`) > 0").select(F.col("node").alias("callee"), F.size("in").cast("bigint").alias("callers"))


def call_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names on both sides of every call, without their files."""
    name = lambda c: G.readable(F.array(c))[0].alias(c)
    return G.call_edges(_calls(spark, sf)).select(name("src"), name("dst")).distinct()


def enriched_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of functions with how many functions they call, are called by, and call outside the repository."""
    resolved = _calls(spark, sf)
    rows = table(spark, sf, "vector_store").where("chunk_type = 'function' AND file_path IS NOT NULL AND symbol_name IS NOT NULL")
    parts = rows.select("id", "file_path", "chunk_type", F.col("symbol_name").alias("function_name"))
    rich = C.with_call_graph(parts, G.adjacency(G.call_edges(resolved)), G.external_calls(resolved))
    return rich.select("id", *(F.size(c).alias(c) for c in ("calls", "called_by", "external_calls")))


def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions of a repository answer to each name."""
    names = G.symbol_names(_functions(spark, sf))
    return names.groupBy(*G.REPO, "symbol").agg(F.count(F.lit(1)).alias("n"))


# ---- small tables -------------------------------------------------------------------------------------


def job_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last job of every tenant."""
    order = (F.col("updated_at").desc_nulls_last(), F.col("job_id").desc())
    return registry.job_states(table(spark, sf, "jobs"), I.TENANT, *order).select(*I.TENANT, "job_id", "status")


def _first_job(spark: SparkSession, sf: str) -> str:
    return table(spark, sf, "jobs").agg(F.min("job_id")).first()[0]


def job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The state of one job."""
    return registry.job(table(spark, sf, "jobs"), _first_job(spark, sf)).select("job_id", "namespace", "project_id", "status", "total_vectors")


def job_updates(spark: SparkSession, sf: str) -> DataFrame:
    """All jobs after one of them failed."""
    jobs = table(spark, sf, "jobs")
    event = registry.job_update(registry.job(jobs, _first_job(spark, sf)), {"status": "failed", "total_vectors": "7"}, F.lit("2031-01-01 00:00:00+00:00").cast("timestamp"))
    return registry.job_states(jobs.unionByName(event)).select("job_id", "status", "total_vectors")


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    """Projects, as the index metadata knows them."""
    meta = table(spark, sf, "index_meta").groupBy(*I.TENANT).agg(F.min("created_at").alias("at"))
    none, at = F.lit(None).cast("string"), iso_utc(F.col("at"))
    return meta.select(
        F.concat_ws("/", *I.TENANT).alias("id"), F.col("project_id").alias("name"), "namespace", *(none.alias(c) for c in ("description", "github_owner", "github_repo", "github_ref")),
        at.alias("created_at"), at.alias("updated_at"),
    )


def project_list(spark: SparkSession, sf: str) -> DataFrame:
    """The projects of one namespace, newest first."""
    rows = registry.list_projects(_projects(spark, sf), "kestrel-works")
    return rows.select("id", "name", "created_at")


def project_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Projects after one is renamed and moved, and another is deleted."""
    rows = _projects(spark, sf)
    first, last = rows.agg(F.min("id"), F.max("id")).first()
    moved = registry.update_project(rows, first, {"name": "renamed", "namespace": "elsewhere", "id": "never"}, F.lit("2031"))
    return registry.delete_project(moved, last).select("id", "name", "namespace", "updated_at")


def tenant_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors per tenant after a replacement that brings one namespace nothing and the others their later rows."""
    rows = table(spark, sf, "vector_store").select(*I.KEY, "id", "created_at")
    cut = F.lit(f"{CUT} 00:00:00+00:00").cast("timestamp")
    later = rows.where((F.col("created_at") >= cut) & (F.col("namespace") != "kestrel-works"))
    named = rows.where("namespace = 'kestrel-works'").select(*I.TENANT)
    return I.tenant_counts(I.replace_all(rows, later, named))


def file_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors per tenant after the rows of one file are deleted."""
    rows = table(spark, sf, "vector_store")
    one = rows.where("file_path IS NOT NULL").orderBy("file_path", "id").select(*I.TENANT, "file_path").first()
    return I.tenant_counts(I.delete_file(rows, *one))


def collection_size(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, files and chunk types of the whole vector table."""
    rows = table(spark, sf, "vector_store")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"), F.count_distinct("chunk_type").alias("types"))


def file_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions and imports each file has."""
    files = table(spark, sf, "file_analysis").select("file_path").distinct()
    names = table(spark, sf, "function_info").select("file_path", "ord", "name").distinct().withColumn("kind", F.lit("function"))
    return C.summaries(files, names).select("file_path", F.size("functions").alias("functions"), F.size("types").alias("types"))


def job_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs per state."""
    return table(spark, sf, "jobs").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def job_times(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with their times as text."""
    return registry.with_iso_times(table(spark, sf, "jobs"), "created_at", "updated_at").select("job_id", "created_at", "updated_at")


def tenant_info(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of vectors with the tenant's latest metadata."""
    meta = table(spark, sf, "index_meta")
    order = (F.col("updated_at").desc_nulls_last(), F.col("embedder").desc_nulls_last(), F.col("model").desc_nulls_last())
    last = I.latest(meta, I.TENANT, *order).select(*I.TENANT, "embedder", "embedding_dim")
    return registry.tenant_info(I.tenant_counts(table(spark, sf, "vector_store")), last)


def meta_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Index metadata: latest update, first creation."""
    rows = table(spark, sf, "index_meta")
    merged = registry.upsert_meta(rows.limit(0), rows)
    return merged.select(*I.TENANT, *(iso_utc(F.col(c)).alias(c) for c in ("created_at", "updated_at")))


def recent_tenants(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 newest tenants; a top-k report."""
    rows = table(spark, sf, "index_meta").groupBy(*I.TENANT).agg(F.max("created_at").alias("created_at"))
    top = rows.orderBy(F.col("created_at").desc_nulls_last(), *I.TENANT).limit(20)
    order = Window.orderBy(F.col("created_at").desc_nulls_last(), *I.TENANT)
    return top.withColumn("nth", F.row_number().over(order)).select("nth", *I.TENANT)


def embedder_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Which embedder each namespace's number of chunks asks for."""
    counts = table(spark, sf, "vector_store").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("namespace", choice(F.col("n")).alias("embedder"))


_ALL = (
    knn_topk, knn_tenant, knn_clamped, knn_code, vector_norms, vector_dimensions, text_search, tenant_counts, tenant_delete, upsert_rows,
    stale_rows, live_rows, chunk_ids, metadata_fields, first_occurrence, scan_filters, language_route, path_parts, line_frames,
    key_value_entries, shell_functions, file_summaries, python_functions, source_symbols, source_chunks, indent_bodies, brace_bodies, import_edges, unresolved_imports, import_nodes, enriched_rows, call_edges,
    external_calls, called_by, call_names, enriched_functions, knn_default, shell_sources, config_includes, import_lines, default_bodies, shebang_languages, routed_counts,
    package_names, collapsed_texts, flat_metadata, restored_metadata, function_table, summary_chunk_ids, function_chunk_ids, json_entries, config_entries, service_vectors, pooled_vectors, job_lookup, job_updates,
    project_list, project_changes, tenant_replace, file_delete, collection_size, file_counts, symbol_lookup, job_latest, job_counts, job_times, tenant_info, meta_upsert, recent_tenants, embedder_choice,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


# ---- SQL ----------------------------------------------------------------------------------------------


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql_language(path: str) -> str:
    ext, name = f"lower(regexp_extract({path}, '(\\.[^./]*)$', 1))", f"regexp_extract({path}, '([^/]*)$', 1)"
    names = " ".join(f"WHEN {name} IN ({_sql_list(v)}) THEN '{k}'" for k, v in routing.BY_NAME.items())
    exts = " ".join(f"WHEN {ext} IN ({_sql_list(v)}) THEN '{k}'" for k, v in routing.BY_EXTENSION.items())
    return f"CASE {names} {exts} END"


_EXT = r"regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_ISO = "strftime({} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ')"
_LINES = (
    "CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) WHEN regexp_matches({0}, '(\\r\\n?|\\n)\\z') "
    "THEN string_split_regex({0}, '\\r\\n?|\\n')[:-2] ELSE string_split_regex({0}, '\\r\\n?|\\n') END"
)
_STRIP = "regexp_replace({}, '^\\s+|\\s+\\z', '', 'g')"

_KNN = """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity_score
      FROM embeddings e, q WHERE {where})
"""
_TOP = "SELECT *, CAST(row_number() OVER (ORDER BY similarity_score DESC, {0}) AS INTEGER) AS rank FROM s QUALIFY rank <= {1}"

_STORED = f"""
WITH rows AS (SELECT namespace, project_id, chunk_id, id, created_at FROM vector_store),
cur AS (SELECT * FROM rows WHERE created_at < TIMESTAMPTZ '{CUT} 00:00:00+00'
        QUALIFY row_number() OVER (PARTITION BY namespace, project_id, chunk_id ORDER BY created_at DESC, id DESC) = 1),
inc AS (SELECT * FROM rows WHERE created_at >= TIMESTAMPTZ '{CUT} 00:00:00+00'
        QUALIFY row_number() OVER (PARTITION BY namespace, project_id, chunk_id ORDER BY created_at DESC, id DESC) = 1)
"""



def _folded(path: str, depth: int = 6) -> str:
    """SQL that folds up to ``depth`` steps upwards in a path."""
    for _ in range(depth):
        path = f"regexp_replace({path}, '/[^/]+/\\.\\./', '/')"
    return path


_RESOLVED = f"""
WITH f0 AS (SELECT DISTINCT namespace, project_id, file_path, {_sql_language('file_path')} AS lang, imports FROM file_analysis),
nx AS (SELECT *, regexp_replace(file_path, '^/repos/[^/]+/[^/]+/', '') AS own, regexp_replace(lead(file_path) OVER (PARTITION BY namespace, project_id, lang ORDER BY file_path),
       '^/repos/[^/]+/[^/]+/', '') AS other FROM (SELECT DISTINCT namespace, project_id, file_path, lang FROM f0)),
links AS (SELECT namespace, project_id, file_path, lang, [CASE lang WHEN 'python' THEN replace(regexp_replace(other, '[.][^./]*$', ''), '/', '.')
          WHEN 'javascript' THEN './' || repeat('../', len(string_split(own, '/')) - 1) || other
          WHEN 'go' THEN 'mod.example/' || CASE WHEN other LIKE '%/%' THEN regexp_extract(other, '([^/]*)/[^/]*$', 1) ELSE '' END END] AS imports FROM nx),
f AS (SELECT * FROM f0 UNION ALL SELECT * FROM links WHERE imports[1] IS NOT NULL),
i0 AS (SELECT namespace, project_id, file_path, lang, unnest(imports) AS imp, unnest(generate_series(0, len(imports) - 1)) AS ord FROM f),
i AS (SELECT DISTINCT * FROM i0 WHERE imp IS NOT NULL),
files AS (SELECT DISTINCT namespace, project_id, file_path AS file FROM file_analysis),
js0 AS (SELECT *, regexp_replace(file_path, '/[^/]*$', '') || '/' || imp AS raw FROM i
        WHERE lang = 'javascript' AND (imp LIKE './%' OR imp LIKE '../%')),
js1 AS (SELECT *, {_folded("regexp_replace(raw, '/(\\./)+', '/', 'g')")} AS base FROM js0),
js AS (SELECT j.*, t.file, e.rank FROM js1 j, (VALUES (0, ''), (1, '.js'), (2, '.ts'), (3, '/index.js'), (4, '/index.ts')) e(rank, ending), files t
       WHERE t.namespace = j.namespace AND t.project_id = j.project_id AND t.file = j.base || e.ending),
py AS (SELECT i.*, t.file FROM i JOIN files t ON t.namespace = i.namespace AND t.project_id = i.project_id
       AND (ends_with(t.file, replace(imp, '.', '/') || '.py') OR ends_with(t.file, replace(imp, '.', '/') || '/__init__.py'))
       WHERE lang = 'python'),
go AS (SELECT i.*, t.file FROM i JOIN files t ON t.namespace = i.namespace AND t.project_id = i.project_id AND t.file LIKE '%.go'
       AND regexp_extract(t.file, '([^/]*)/[^/]*$', 1) = regexp_extract(imp, '([^/]*)$', 1) WHERE lang = 'go'),
hit AS (SELECT namespace, project_id, file_path, ord, imp, arg_min(file, rank) AS target FROM js GROUP BY ALL
        UNION ALL SELECT namespace, project_id, file_path, ord, imp, min(file) FROM py GROUP BY ALL
        UNION ALL SELECT namespace, project_id, file_path, ord, imp, min(file) FROM go GROUP BY ALL),
r AS (SELECT i.*, hit.target FROM i LEFT JOIN hit USING (namespace, project_id, file_path, ord, imp)),
edges AS (SELECT DISTINCT namespace, project_id, file_path AS src, target AS dst FROM r WHERE target IS NOT NULL AND target <> file_path),
sides AS (SELECT namespace, project_id, src AS node, dst AS o, NULL AS i FROM edges
          UNION ALL SELECT namespace, project_id, dst, NULL, src FROM edges)
"""

_CALLS = r"""
WITH fn AS (SELECT DISTINCT split_part(file_path, '/', 3) AS namespace, split_part(file_path, '/', 4) AS project_id, file_path, ord, name FROM function_info),
sym AS (SELECT namespace, project_id, file_path, ord, name, unnest(list_distinct([name, regexp_extract(name, '([^.]*)$', 1)])) AS symbol FROM fn),
c0 AS (SELECT namespace, project_id, file_path, symbol_name AS name, unnest(list_distinct(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS call
       FROM vector_store WHERE chunk_type = 'function' AND file_path IS NOT NULL AND symbol_name IS NOT NULL),
c AS (SELECT DISTINCT * FROM c0 WHERE call <> name AND call <> regexp_extract(name, '([^.]*)$', 1)),
near AS (SELECT DISTINCT namespace, project_id, file_path, symbol, name AS callee FROM sym),
far AS (SELECT DISTINCT namespace, project_id, symbol, file_path AS callee_file, name AS callee FROM (
        SELECT *, row_number() OVER (PARTITION BY namespace, project_id, symbol ORDER BY file_path, ord) AS nth FROM sym) WHERE nth <= 5),
same AS (SELECT c.*, c.file_path AS callee_file, near.callee FROM c JOIN near ON c.namespace = near.namespace AND c.project_id = near.project_id
         AND c.file_path = near.file_path AND c.call = near.symbol),
rest AS (SELECT c.* FROM c ANTI JOIN near ON c.namespace = near.namespace AND c.project_id = near.project_id AND c.file_path = near.file_path AND c.call = near.symbol),
r AS (SELECT * FROM same UNION ALL SELECT rest.*, far.callee_file, far.callee FROM rest LEFT JOIN far
      ON rest.namespace = far.namespace AND rest.project_id = far.project_id AND rest.call = far.symbol),
edges AS (SELECT DISTINCT namespace, project_id, file_path || '::' || name AS src, callee_file || '::' || callee AS dst FROM r WHERE callee IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    skip = f"""
        CASE WHEN rel_path IS NULL OR length IS NULL THEN 'size'
        WHEN list_has_any(string_split(rel_path, '/')[:-2], [{_sql_list(scanning.IGNORED_DIRS)}]) THEN 'directory'
        WHEN regexp_matches(rel_path, '(^|/)\\.') THEN 'hidden'
        WHEN lower({_EXT.replace('path', 'rel_path')}) IN ({_sql_list(scanning.BINARY_EXTENSIONS)}) THEN 'binary'
        WHEN {' OR '.join(f"ends_with(rel_path, '{e}')" for e in scanning.GENERATED_ENDINGS)} THEN 'generated'
        WHEN length > {scanning.MAX_BYTES} THEN 'size' END"""
    lines, strip = _LINES.format, _STRIP.format
    hashed = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64"
    tokens = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    return {
        "knn_topk": _KNN.format(where="true") + _TOP.format("vec_id", 5),
        "knn_tenant": _KNN.format(where="e.label = q.label") + _TOP.format("vec_id", 5),
        "knn_clamped": _KNN.format(where="true") + "SELECT vec_id, greatest(0.0, similarity_score) AS similarity_score FROM s",
        "knn_code": """
            WITH u AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM vector_store WHERE namespace = 'kestrel-works' AND len(embedding) = 64
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            q AS (SELECT e AS v FROM u ORDER BY id LIMIT 1),
            s AS (SELECT id, round(list_cosine_similarity(e, v), 6) AS similarity_score FROM u, q)
            """ + _TOP.format("id", 10),
        "knn_default": _KNN.format(where="true") + _TOP.format("vec_id", 5),
        "vector_norms": """
            SELECT vec_id, round(n, 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first
            FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)""",
        "vector_dimensions": "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM vector_store WHERE embedding IS NOT NULL GROUP BY 1",
        "text_search": f"""
            WITH d AS (SELECT doc_id, unnest({tokens.format('text')}) AS t FROM documents),
            c AS (SELECT doc_id, {hashed} AS b, count(*) AS n FROM d GROUP BY ALL),
            q0 AS (SELECT unnest({tokens.format(f"'{SEARCH_TEXT}'")}) AS t),
            q AS (SELECT {hashed} AS b, count(*) AS m FROM q0 GROUP BY 1),
            norms AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM c GROUP BY 1),
            dots AS (SELECT doc_id, sum(n * m) AS dot FROM c JOIN q USING (b) GROUP BY 1),
            s AS (SELECT doc_id, round(coalesce(dot, 0) / size / (SELECT sqrt(sum(m * m)) FROM q), 4) AS similarity_score FROM norms LEFT JOIN dots USING (doc_id))
            """ + _TOP.format("doc_id", 5),
        "service_vectors": "SELECT doc_id, coalesce(length(text), 0) AS size, CAST(1 AS BIGINT) AS stored FROM documents",
        "pooled_vectors": """
            WITH p AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (CAST(embedding[i] AS DOUBLE) + embedding[16 + i] + embedding[32 + i]) / 3) AS m FROM embeddings)
            SELECT vec_id, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 2) + CAST(0 AS DOUBLE) AS first FROM p""",
        "tenant_counts": "SELECT namespace, project_id, count(*) AS total_vectors FROM vector_store GROUP BY 1, 2",
        "tenant_delete": """
            SELECT namespace, project_id, count(*) AS total_vectors FROM vector_store
            WHERE namespace IS DISTINCT FROM 'kestrel-works' GROUP BY 1, 2""",
        "upsert_rows": _STORED + f"""
            SELECT coalesce(cur.namespace, inc.namespace) AS namespace, coalesce(cur.project_id, inc.project_id) AS project_id,
                   coalesce(cur.chunk_id, inc.chunk_id) AS chunk_id, coalesce(inc.id, cur.id) AS id,
                   {_ISO.format('coalesce(cur.created_at, inc.created_at)')} AS created
            FROM cur FULL JOIN inc ON cur.namespace IS NOT DISTINCT FROM inc.namespace AND cur.project_id IS NOT DISTINCT FROM inc.project_id
                 AND cur.chunk_id IS NOT DISTINCT FROM inc.chunk_id""",
        "stale_rows": _STORED + "SELECT namespace, project_id, chunk_id, id FROM cur ANTI JOIN inc USING (namespace, project_id, chunk_id)",
        "live_rows": """
            SELECT namespace, project_id, chunk_id, id FROM vector_store
            QUALIFY row_number() OVER (PARTITION BY namespace, project_id, chunk_id ORDER BY created_at DESC, id DESC) = 1""",
        "chunk_ids": """
            SELECT id, made, made = chunk_id AS same FROM (SELECT id, chunk_id, md5(coalesce(file_path, '') || '::' || coalesce(chunk_type, '')
                   || '::' || coalesce(symbol_name, '') || '::' || coalesce(CAST(line_number AS VARCHAR), '')) AS made FROM vector_store)""",
        "metadata_fields": "SELECT id, " + ", ".join(
            f"CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{c}') END AS {c}" for c in ("language", "package", "symbol_type")
        ) + " FROM vector_store",
        "first_occurrence": """
            SELECT id, CAST(CASE WHEN strpos(content, symbol_name) > 0
                   THEN len(string_split(substr(content, 1, strpos(content, symbol_name) - 1), chr(10))) - 1 ELSE 0 END AS INTEGER) AS line
            FROM vector_store WHERE symbol_name <> ''""",
        "scan_filters": f"SELECT DISTINCT path, length, {skip} AS reason FROM source_files",
        "language_route": f"""
            SELECT path, language, CASE WHEN language = 'config' THEN CASE WHEN ext IN ('.yaml', '.yml') THEN 'yaml' WHEN ext = '.toml' THEN 'toml'
                   WHEN ext = '.json' THEN 'json' WHEN ext IN ('.ini', '.cfg') OR {_NAME} IN ({_sql_list(routing.INI_NAMES)}) THEN 'ini'
                   WHEN length(ext) > 1 THEN substr(ext, 2) ELSE 'config' END END AS dialect
            FROM (SELECT DISTINCT path, {_sql_language('path')} AS language, lower({_EXT}) AS ext FROM source_files)""",
        "path_parts": f"""
            SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS folder, {_NAME} AS name,
                   substr({_NAME}, 1, length({_NAME}) - length({_EXT})) AS stem, {_EXT} AS ext FROM source_files""",
        "line_frames": f"""
            SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines,
                   md5(regexp_replace(array_to_string(l[3:42], chr(10)), '\\s+\\z', '') || chr(10)) AS frame
            FROM (SELECT doc_id, {lines('text')} AS l FROM documents WHERE text IS NOT NULL)""",
        "key_value_entries": f"""
            WITH t AS (SELECT id, {lines('content')} AS l FROM vector_store WHERE chunk_type IN ('file', 'function')
                       AND regexp_matches(file_path, '[.](env|conf|properties)$')),
            r AS (SELECT id, unnest(generate_series(0, len(l) - 1)) AS ln, {strip('unnest(l)')} AS x FROM t),
            m AS (SELECT *, regexp_matches(x, '^[#;]') AS comment, regexp_extract(x, '^\\[([^\\]]+)\\]', 1) AS sec,
                  regexp_extract(x, '^([A-Za-z0-9_][A-Za-z0-9_.@/-]*)\\s*[=:]\\s*(.*)', 1) AS k0,
                  regexp_replace({strip("regexp_extract(x, '^([A-Za-z0-9_][A-Za-z0-9_.@/-]*)\\s*[=:]\\s*(.*)', 2)")}, '^[''"]+|[''"]+$', '', 'g') AS v FROM r),
            n AS (SELECT *, CASE WHEN comment THEN {strip("regexp_replace(x, '^[#;]+', '')")} END AS note,
                  CASE WHEN NOT comment AND sec <> '' THEN sec END AS head, CASE WHEN NOT comment AND sec = '' THEN nullif(k0, '') END AS key FROM m),
            w AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS section,
                  lag(note) OVER (PARTITION BY id ORDER BY ln) AS above FROM n)
            SELECT id, CASE WHEN head IS NOT NULL THEN 'section' ELSE 'entry' END AS kind,
                   coalesce(head, section || '.' || key, key, substr(x, 1, 60)) AS name, CAST(ln AS INTEGER) AS line,
                   CASE WHEN head IS NOT NULL THEN '' WHEN key IS NULL THEN substr(x, 1, 120)
                        ELSE key || ' = ' || CASE WHEN length(v) > 100 THEN substr(v, 1, 100) || '…' ELSE v END END AS signature,
                   CASE WHEN key IS NOT NULL THEN coalesce(above, '') ELSE '' END AS docstring
            FROM w WHERE NOT comment AND x <> ''""",
        "shell_functions": f"""
            WITH t AS (SELECT id, {lines('content')} AS l FROM vector_store WHERE chunk_type IN ('file', 'function')
                       AND regexp_matches(file_path, '[.](sh|bash)$')),
            r AS (SELECT id, unnest(generate_series(0, len(l) - 1)) AS ln, unnest(l) AS x FROM t),
            m AS (SELECT *, regexp_extract(x, '^function\\s+([A-Za-z0-9_][A-Za-z0-9_.-]*)\\s*(?:\\(\\s*\\))?\\s*\\{{', 1) AS a,
                  regexp_extract(x, '^([A-Za-z0-9_][A-Za-z0-9_.-]*)\\s*\\(\\s*\\)\\s*\\{{', 1) AS b,
                  regexp_extract(x, '^alias\\s+([A-Za-z0-9_][A-Za-z0-9_.-]*)\\s*=\\s*(?:''([^'']*)''|"([^"]*)"|(\\S+))', ['n', 'p', 'q', 'r']) AS al FROM r),
            notes AS (SELECT id, ln, x, {strip('x')} AS bare FROM r),
            runs AS (SELECT *, coalesce(max(CASE WHEN bare <> '' AND bare NOT LIKE '#%' THEN ln END) OVER (PARTITION BY id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS since FROM notes),
            doc AS (SELECT id, ln, coalesce(string_agg(CASE WHEN bare LIKE '#%' THEN {strip("substr(bare, 2)")} END, ' ') OVER (PARTITION BY id, since ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS docstring FROM runs),
            k AS (SELECT id, ln, CASE WHEN a <> '' THEN 1 WHEN b <> '' AND b NOT IN ({_sql_list(L.SHELL_KEYWORDS)}) THEN 2 WHEN al.n <> '' THEN 3 END AS rank, x, a, b, al FROM m),
            s AS (SELECT id, ln, rank, CASE rank WHEN 1 THEN a WHEN 2 THEN b ELSE 'alias:' || al.n END AS name,
                  CASE rank WHEN 3 THEN 'alias ' || al.n || '=''' || coalesce(nullif(al.p, ''), nullif(al.q, ''), nullif(al.r, ''), '') || ''''
                  ELSE {strip("regexp_replace(CASE rank WHEN 1 THEN regexp_extract(x, '^function\\s+[^{]*\\{') ELSE regexp_extract(x, '^[^{]*\\{') END, '\\{+$', '')")} END AS signature FROM k WHERE rank IS NOT NULL)
            SELECT id, name, CAST(ln AS INTEGER) AS line, signature, docstring FROM s JOIN doc USING (id, ln)
            QUALIFY rank = 3 OR row_number() OVER (PARTITION BY id, name, rank = 3 ORDER BY rank, ln) = 1""",
        "shell_sources": f"""
            WITH r AS (SELECT id, unnest(generate_series(0, len(l) - 1)) AS ln, unnest(l) AS x FROM (SELECT id, {lines('content')} AS l FROM vector_store WHERE regexp_matches(file_path, '[.](sh|bash)$'))),
            m AS (SELECT id, ln, regexp_extract(x, '^(?:source|\\.)\\s+(.*?)\\s*$', 1) AS y FROM r)
            SELECT id, CAST(ln AS INTEGER) AS line, {strip("CASE WHEN length(y) > 1 AND y[1] IN (chr(39), '\"') AND y[-1] = y[1] THEN substr(y, 2, length(y) - 2) ELSE y END")} AS "import" FROM m WHERE {strip('y')} NOT IN ('', chr(39) || chr(39), '\"\"')""",
        "config_includes": f"""
            WITH r AS (SELECT id, unnest(generate_series(0, len(l) - 1)) AS ln, unnest(l) AS x FROM (SELECT id, {lines('content')} AS l FROM vector_store WHERE content IS NOT NULL)),
            m AS (SELECT id, ln, regexp_replace(regexp_extract(x, '^(?:include(?:path|optional)?\\s+|source\\s+|\\.\\s+)(\\S+)', 1, 'i'), '^[\\x27\"]+|[\\x27\"]+$', '', 'g') AS y FROM r)
            SELECT id, CAST(ln AS INTEGER) AS line, y AS "import" FROM m WHERE y <> ''""",
        "import_lines": f"""
            WITH t AS (SELECT id, {_sql_language('file_path')} AS lang, list_transform({lines('content')}, lambda x: {strip('x')}) AS l FROM vector_store WHERE content IS NOT NULL),
            f AS (SELECT id, CASE lang WHEN 'python' THEN list_filter(l, lambda x: x LIKE 'import %' OR x LIKE 'from %')
                  WHEN 'go' THEN list_filter(l, lambda x: x LIKE 'import %' OR (x LIKE '(%' AND x LIKE '%import%'))
                  WHEN 'javascript' THEN list_filter(l, lambda x: x LIKE 'import %' OR x LIKE 'require(%' OR (x LIKE '%from %' AND (x LIKE '%import%' OR x LIKE '%require%')))
                  ELSE [] END AS i FROM t)
            SELECT id, CAST(len(i) AS INTEGER) AS n, md5(array_to_string(i, chr(10))) AS lines FROM f""",
        "default_bodies": f"""
            SELECT id, md5(regexp_replace(array_to_string(l[1:30], chr(10)), '\\s+\\z', '') || chr(10)) AS body
            FROM (SELECT id, {lines('content')} AS l FROM vector_store WHERE regexp_matches(file_path, '[.](rs|rb|lua|java|c|h)$') AND content IS NOT NULL)""",
        "shebang_languages": f"""
            WITH t AS (SELECT id, lower(regexp_extract(regexp_extract({strip("substr(regexp_extract(content, '^([^\\r\\n]*)', 1), 3)")}, '(\\S*)$', 1), '([^/]*)$', 1)) AS tool
                       FROM vector_store WHERE file_path IS NOT NULL AND content LIKE '#!%')
            SELECT id, CASE {" ".join(f"WHEN tool IN ({_sql_list(v)}) THEN '{k}'" for k, v in routing.BY_INTERPRETER.items())} WHEN tool LIKE 'lua5%' THEN 'lua' END AS language FROM t""",
        "routed_counts": f"""
            WITH r AS (SELECT path, {_sql_language('path')} AS language, lower({_EXT}) AS ext FROM (SELECT DISTINCT path FROM source_files))
            SELECT language, CASE WHEN language = 'config' THEN CASE WHEN ext IN ('.yaml', '.yml') THEN 'yaml' WHEN ext = '.toml' THEN 'toml'
                   WHEN ext = '.json' THEN 'json' WHEN ext IN ('.ini', '.cfg') OR {_NAME} IN ({_sql_list(routing.INI_NAMES)}) THEN 'ini'
                   WHEN length(ext) > 1 THEN substr(ext, 2) ELSE 'config' END END AS dialect, count(*) AS n FROM r WHERE language IS NOT NULL GROUP BY 1, 2""",
        "package_names": f"""
            WITH d AS (SELECT DISTINCT file_path AS path FROM file_analysis),
            marked AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM d WHERE length(regexp_replace(path, '/[^/]*$', '') || '/__init__.py') % 2 = 0),
            paths AS (SELECT path FROM d UNION SELECT dir || '/__init__.py' FROM marked),
            inits AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM paths WHERE path LIKE '%/__init__.py'),
            p AS (SELECT path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts, substr({_NAME}, 1, length({_NAME}) - length({_EXT})) AS stem FROM paths),
            u AS (SELECT path, parts, stem, unnest(range(0, len(parts))) AS up FROM p),
            g AS (SELECT u.path, parts, stem, coalesce(min(CASE WHEN dir IS NULL THEN up END), len(parts)) AS depth FROM u
                  LEFT JOIN inits ON dir = array_to_string(parts[1:len(parts) - up], '/') GROUP BY 1, 2, 3)
            SELECT path AS file_path, CASE WHEN lower(path) LIKE '%.py' AND depth > 0 THEN array_to_string(list_append(parts[len(parts) - depth + 1:], stem), '.') ELSE stem END AS package FROM g""",
        "collapsed_texts": f"SELECT doc_id, md5({strip("regexp_replace(text, '\\s+', ' ', 'g')")}) AS text FROM documents WHERE text IS NOT NULL",
        "flat_metadata": """
            SELECT DISTINCT file_path, CAST(ord AS VARCHAR) AS ord, coalesce(return_type, '') AS return_type, coalesce(CAST(to_json(params) AS VARCHAR), '[]') AS params FROM function_info""",
        "restored_metadata": """
            SELECT file_path, CAST(ord AS VARCHAR) AS ord, coalesce(array_to_string(params, '|'), '') AS params, CAST(coalesce(len(params), 0) AS INTEGER) AS n
            FROM (SELECT DISTINCT file_path, ord, coalesce(return_type, '') AS r, params FROM function_info)""",
        "function_table": """
            SELECT DISTINCT file_path, ord, CASE WHEN file_path LIKE '%.rs' THEN replace(name, '::', '.') ELSE name END AS name, line, signature,
                   coalesce(array_to_string(params, '|'), '') AS params FROM function_info""",
        "summary_chunk_ids": f"""
            SELECT file_path, md5(file_path || '::file_summary::' || {_NAME.replace('path', 'file_path')} || '::') AS chunk_id
            FROM (SELECT DISTINCT path AS file_path, {_sql_language('path')} AS language FROM source_files) WHERE language IS NOT NULL""",
        "function_chunk_ids": """
            SELECT DISTINCT file_path, md5(file_path || '::function::' || CASE WHEN file_path LIKE '%.rs' THEN replace(name, '::', '.') ELSE name END || '::' || line) AS chunk_id FROM function_info""",
        "json_entries": """
            WITH t AS (SELECT id, CAST(content AS JSON) AS j FROM vector_store WHERE chunk_type = 'file' AND lower(file_path) LIKE '%.json' AND json_valid(content) AND NOT regexp_matches(content, ',\\s*[]}]')),
            k AS (SELECT id, j, unnest(json_keys(j)) AS key FROM t WHERE json_type(j) = 'OBJECT'),
            v AS (SELECT id, key, json_extract(j, '$."' || key || '"') AS v FROM k)
            SELECT id, CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN 'type' ELSE 'function' END AS kind, key AS name,
                   CASE json_type(v) WHEN 'OBJECT' THEN 'json_object' WHEN 'ARRAY' THEN 'json_array' END AS type_kind FROM v
            UNION ALL SELECT id, 'function', key || '.' || sub, NULL FROM (SELECT id, key, unnest(json_keys(v)) AS sub FROM v WHERE json_type(v) = 'OBJECT')""",
        "config_entries": f"""
            WITH t AS (SELECT id, CASE WHEN lower({_EXT.replace('path', 'file_path')}) IN ('.yaml', '.yml') THEN 'yaml' WHEN lower({_EXT.replace('path', 'file_path')}) = '.toml' THEN 'toml'
                       WHEN lower({_EXT.replace('path', 'file_path')}) IN ('.ini', '.cfg') OR {_NAME.replace('path', 'file_path')} IN ({_sql_list(routing.INI_NAMES)}) THEN 'ini' END AS dialect, {lines('content')} AS l
                       FROM vector_store WHERE chunk_type = 'file' AND file_path IS NOT NULL AND content IS NOT NULL),
            f AS (SELECT * FROM t WHERE {" OR ".join(f"dialect = '{d}' AND len(list_filter(l, lambda x: NOT regexp_matches(x, '{pattern}'))) = 0" for d, pattern in _PLAIN_LINE.items())}),
            r AS (SELECT id, dialect, unnest(generate_series(0, len(l) - 1)) AS ln, unnest(l) AS x FROM f),
            m AS (SELECT *, CASE WHEN dialect = 'yaml' THEN regexp_extract(x, '^([A-Za-z0-9_]+):$', 1) ELSE regexp_extract(x, '^\\[([A-Za-z0-9_]+)\\]$', 1) END AS head,
                  CASE WHEN dialect = 'yaml' THEN regexp_extract(x, '^  ([A-Za-z0-9_]+):', 1) WHEN x NOT LIKE '[%' AND x NOT LIKE '#%' AND x NOT LIKE ';%' THEN regexp_extract(x, '^([A-Za-z0-9_]+) =', 1) ELSE '' END AS key FROM r),
            w AS (SELECT *, last_value(nullif(head, '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS section,
                  lead(key) OVER (PARTITION BY id ORDER BY ln) AS following FROM m WHERE head <> '' OR key <> '')
            SELECT DISTINCT id, dialect, CASE WHEN head <> '' AND (dialect <> 'yaml' OR coalesce(following, '') <> '') THEN 'type' ELSE 'function' END AS kind,
                   CASE WHEN head <> '' THEN head WHEN section IS NULL THEN key WHEN dialect = 'ini' THEN section || '.' || lower(key) ELSE section || '.' || key END AS name FROM w""",
        "file_summaries": """
            WITH f AS (SELECT DISTINCT file_path, package, imports FROM file_analysis),
            n AS (SELECT file_path, list(name ORDER BY ord, name) AS names FROM (SELECT DISTINCT file_path, ord, name FROM function_info) GROUP BY 1)
            SELECT file_path, concat_ws(chr(10), 'File: ' || file_path, CASE WHEN package <> '' THEN 'Package: ' || package END,
                   CASE WHEN len(names) > 0 THEN 'Functions: ' || array_to_string(names[1:20], ', ') END,
                   CASE WHEN len(imports) > 0 THEN 'Imports: ' || array_to_string(imports[1:15], ', ') END) AS content
            FROM f LEFT JOIN n USING (file_path)""",
        "python_functions": "SELECT DISTINCT file_path, ord, name, line, signature FROM function_info WHERE lower(file_path) LIKE '%.py'",
        "indent_bodies": f"""
            WITH t AS (SELECT id, {lines('content')} AS l FROM vector_store WHERE chunk_type IN ('function', 'class') AND lower(file_path) LIKE '%.py'),
            w AS (SELECT id, l, list_transform(l, lambda x: length(x) - length(regexp_replace(x, '^\\s+', ''))) AS d FROM t),
            p AS (SELECT id, l, list_position(list_transform(range(2, least(len(l), 200) + 1), lambda i: {strip('l[i]')} <> '' AND d[i] <= d[1]), true) AS pos FROM w)
            SELECT id, CAST(CASE WHEN pos > 0 THEN pos ELSE least(len(l), 200) END AS INTEGER) AS "end" FROM p""",
        "brace_bodies": f"""
            WITH t AS (SELECT id, {lines('content')} AS l FROM vector_store WHERE chunk_type = 'function' AND regexp_matches(file_path, '[.](go|js|ts|mjs|cjs)$')),
            m AS (SELECT id, unnest(string_split(s, '')) AS c, unnest(generate_series(1, length(s))) AS k
                  FROM (SELECT id, regexp_replace(array_to_string(l[1:300], chr(10)), '[^{{}}\\n]', '', 'g') AS s FROM t) WHERE s <> ''),
            w AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER o AS depth, max(CASE c WHEN '{{' THEN 1 ELSE 0 END) OVER o AS opened,
                  sum(CASE c WHEN chr(10) THEN 1 ELSE 0 END) OVER o AS line FROM m WINDOW o AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)),
            e AS (SELECT id, min(line) AS line FROM w WHERE c = '}}' AND opened = 1 AND depth = 0 GROUP BY 1)
            SELECT t.id, CAST(coalesce(e.line + 1, least(len(l), 30)) AS INTEGER) AS "end" FROM t LEFT JOIN e USING (id)""",
        "import_edges": _RESOLVED + "SELECT * FROM edges",
        "unresolved_imports": _RESOLVED + """
            SELECT namespace, project_id, file_path AS src, CAST(ord AS INTEGER) AS ord, imp AS "import" FROM r WHERE target IS NULL OR target = file_path""",
        "import_nodes": _RESOLVED + """
            SELECT node, coalesce(string_agg(DISTINCT o, ',' ORDER BY o), '') AS depends_on, coalesce(string_agg(DISTINCT i, ',' ORDER BY i), '') AS imported_by
            FROM sides GROUP BY namespace, project_id, node""",
        "enriched_rows": _RESOLVED + """,
            g AS (SELECT node, count(DISTINCT o) AS no, count(DISTINCT i) AS ni FROM sides GROUP BY namespace, project_id, node)
            SELECT id, CAST(coalesce(no, 0) AS INTEGER) AS n_out, CAST(coalesce(ni, 0) AS INTEGER) AS n_in FROM vector_store v LEFT JOIN g ON v.file_path = g.node""",
        "call_edges": _CALLS + "SELECT * FROM edges",
        "external_calls": _CALLS + "SELECT DISTINCT namespace, project_id, file_path, name, call FROM r WHERE callee IS NULL",
        "called_by": _CALLS + "SELECT dst AS callee, count(*) AS callers FROM edges GROUP BY 1",
        "call_names": _CALLS + "SELECT DISTINCT substr(src, strpos(src, '::') + 2) AS src, substr(dst, strpos(dst, '::') + 2) AS dst FROM edges",
        "enriched_functions": _CALLS + """,
            outs AS (SELECT src AS k, count(DISTINCT dst) AS n FROM edges GROUP BY 1), ins AS (SELECT dst AS k, count(DISTINCT src) AS n FROM edges GROUP BY 1),
            ext AS (SELECT file_path || '::' || name AS k, count(DISTINCT call) AS n FROM r WHERE callee IS NULL GROUP BY 1)
            SELECT id, CAST(coalesce(outs.n, 0) AS INTEGER) AS calls, CAST(coalesce(ins.n, 0) AS INTEGER) AS called_by, CAST(coalesce(ext.n, 0) AS INTEGER) AS external_calls
            FROM vector_store v LEFT JOIN outs ON outs.k = v.file_path || '::' || v.symbol_name LEFT JOIN ins ON ins.k = v.file_path || '::' || v.symbol_name
                 LEFT JOIN ext ON ext.k = v.file_path || '::' || v.symbol_name WHERE chunk_type = 'function' AND file_path IS NOT NULL AND symbol_name IS NOT NULL""",
        "symbol_lookup": _CALLS + "SELECT namespace, project_id, symbol, count(*) AS n FROM sym GROUP BY 1, 2, 3",
        "job_latest": """
            SELECT namespace, project_id, job_id, status FROM jobs
            QUALIFY row_number() OVER (PARTITION BY namespace, project_id ORDER BY updated_at DESC NULLS LAST, job_id DESC) = 1""",
        "job_lookup": "SELECT job_id, namespace, project_id, status, total_vectors FROM jobs WHERE job_id = (SELECT min(job_id) FROM jobs) QUALIFY row_number() OVER (ORDER BY updated_at DESC NULLS LAST) = 1",
        "job_updates": """
            SELECT job_id, CASE WHEN job_id = (SELECT min(job_id) FROM jobs) THEN 'failed' ELSE status END AS status,
                   CASE WHEN job_id = (SELECT min(job_id) FROM jobs) THEN 7 ELSE total_vectors END AS total_vectors
            FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST) = 1""",
        "project_list": f"""
            SELECT namespace || '/' || project_id AS id, project_id AS name, {_ISO.format('min(created_at)')} AS created_at FROM index_meta
            WHERE namespace = 'kestrel-works' GROUP BY namespace, project_id""",
        "project_changes": f"""
            WITH p AS (SELECT namespace || '/' || project_id AS id, project_id AS name, namespace, {_ISO.format('min(created_at)')} AS updated_at FROM index_meta GROUP BY namespace, project_id),
            e AS (SELECT min(id) AS a, max(id) AS z FROM p)
            SELECT id, CASE WHEN id = a THEN 'renamed' ELSE name END AS name, CASE WHEN id = a THEN 'elsewhere' ELSE namespace END AS namespace,
                   CASE WHEN id = a THEN '2031' ELSE updated_at END AS updated_at FROM p, e WHERE id <> z""",
        "tenant_replace": f"""
            WITH later AS (SELECT * FROM vector_store WHERE created_at >= TIMESTAMPTZ '{CUT} 00:00:00+00' AND namespace <> 'kestrel-works'),
            one AS (SELECT DISTINCT namespace, project_id, chunk_id FROM later),
            gone AS (SELECT namespace, project_id FROM later UNION SELECT namespace, project_id FROM vector_store WHERE namespace = 'kestrel-works'),
            rest AS (SELECT namespace, project_id FROM vector_store v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace IS NOT DISTINCT FROM v.namespace AND g.project_id IS NOT DISTINCT FROM v.project_id))
            SELECT namespace, project_id, count(*) AS total_vectors FROM (SELECT namespace, project_id FROM one UNION ALL SELECT * FROM rest) GROUP BY 1, 2""",
        "file_delete": """
            WITH one AS (SELECT namespace, project_id, file_path FROM vector_store WHERE file_path IS NOT NULL ORDER BY file_path, id LIMIT 1)
            SELECT v.namespace, v.project_id, count(*) AS total_vectors FROM vector_store v, one
            WHERE NOT coalesce(v.namespace = one.namespace AND v.project_id = one.project_id AND v.file_path = one.file_path, false) GROUP BY 1, 2""",
        "collection_size": "SELECT count(*) AS n, count(DISTINCT file_path) AS files, count(DISTINCT chunk_type) AS types FROM vector_store",
        "file_counts": """
            SELECT f.file_path, CAST(coalesce(n, 0) AS INTEGER) AS functions, CAST(0 AS INTEGER) AS types FROM (SELECT DISTINCT file_path FROM file_analysis) f
            LEFT JOIN (SELECT file_path, count(*) AS n FROM (SELECT DISTINCT file_path, ord, name FROM function_info) GROUP BY 1) USING (file_path)""",
        "job_counts": "SELECT status, count(*) AS n FROM jobs GROUP BY 1",
        "job_times": f"SELECT job_id, {_ISO.format('created_at')} AS created_at, {_ISO.format('updated_at')} AS updated_at FROM jobs",
        "tenant_info": """
            WITH m AS (SELECT * FROM index_meta QUALIFY row_number() OVER (PARTITION BY namespace, project_id
                       ORDER BY updated_at DESC NULLS LAST, embedder DESC NULLS LAST, model DESC NULLS LAST) = 1),
            c AS (SELECT namespace, project_id, count(*) AS total_vectors FROM vector_store GROUP BY 1, 2)
            SELECT c.*, m.embedder, m.embedding_dim FROM c LEFT JOIN m ON c.namespace = m.namespace AND c.project_id = m.project_id""",
        "meta_upsert": f"""
            SELECT namespace, project_id, {_ISO.format('min(created_at)')} AS created_at, {_ISO.format('max(updated_at)')} AS updated_at
            FROM index_meta GROUP BY 1, 2""",
        "recent_tenants": """
            SELECT CAST(row_number() OVER (ORDER BY c DESC NULLS LAST, namespace, project_id) AS INTEGER) AS nth, namespace, project_id
            FROM (SELECT namespace, project_id, max(created_at) AS c FROM index_meta GROUP BY 1, 2) QUALIFY nth <= 20""",
        "embedder_choice": f"""
            SELECT namespace, CASE WHEN count(*) > {LOCAL_LIMIT} THEN 'remote' ELSE 'local' END AS embedder FROM vector_store GROUP BY 1""",
    }
