"""The engine: index a tree, search it, look after its table."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.paths import base_name, dir_name, stem
from tessel.operators import chunks as C
from tessel.operators import graphs as G
from tessel.operators import registry, routing, symbols
from tessel.operators import vector_index as I
from tessel.operators.embedding import HashingEmbedder, embed
from tessel.schemas import INDEX_META, JOBS, VECTORS
from tessel.session import exists, ship, stored
from tessel.sources.archives import RemoteArchive, read_archives
from tessel.sources.tree import read_tree
from tessel.sources.webhook import notify


def packages(files: DataFrame) -> DataFrame:
    """``(file_path, package)``: the dotted package of Python files, the stem of others.

    A folder belongs to a package while it holds an ``__init__.py``; the climb is a join per level on the set
    of such folders, as deep as packages nest.
    """
    names = files.select(F.col("path").alias("file_path"), dir_name(F.col("path")).alias("dir"), stem(base_name(F.col("path"))).alias("package"))
    inits = names.where(base_name(F.col("file_path")) == "__init__.py").select(F.col("dir").alias("init")).distinct()
    prefixes = names.withColumn("parts", F.split("dir", "/")).select(
        "file_path", "package", "parts",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), F.size("parts") - i), "/"))).alias("up", "init"),
    )
    held = prefixes.join(inits.withColumn("yes", F.lit(True)), "init", "left")
    # how many folders from the file upwards are packages without a gap
    depth = held.groupBy("file_path", "package", "parts").agg(F.min(F.when(F.col("yes").isNull(), F.col("up"))).alias("gap"), F.count(F.lit(1)).alias("n"))
    count = F.coalesce("gap", "n").cast("int")
    dotted = F.when(
        F.lower("file_path").endswith(".py") & (count > 0),
        F.array_join(F.concat(F.slice("parts", F.size("parts") - count + 1, count), F.array("package")), "."),
    ).otherwise(F.col("package"))
    return depth.select("file_path", dotted.alias("package"))


class Engine:
    """Indexes and searches in a folder of tables; every method is a few Spark jobs on the caller's session."""

    def __init__(self, spark: SparkSession, home: str, embedder=None):
        ship(spark)
        self.spark, self.home = spark, home
        self.embedder = embedder or HashingEmbedder()
        self.vectors = I.VectorIndex(spark, f"{home}/vectors", VECTORS)
        self.meta_path = f"{home}/index_meta"
        self.jobs = registry.EventTable(spark, f"{home}/jobs", JOBS)

    def analyse(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Chunks of ``files(path, content)`` with both graphs, and the edges of the import and call graph.

        What is read more than once is stored, so files are parsed once whatever the plan branches into.
        """
        routed = routing.routed(files).withColumn("dialect", routing.config_dialect(F.col("path")))
        parsed = stored(symbols.extract_symbols(routed))
        texts = stored(symbols.decoded(routed, "path", "language"))
        all_symbols = stored(symbols.with_line_readers(parsed, texts))
        repo = [F.lit("").alias("namespace"), F.lit("").alias("project_id")]
        base = texts.select(F.col("path").alias("file_path"), "language", "text").join(packages(routed), "file_path", "left")

        names = base.select(*repo, "file_path", "language")
        listed = all_symbols.where("kind = 'import'").join(base.select("file_path", "language"), "file_path")
        imports = listed.select(*repo, "file_path", "language", "ord", F.col("name").alias("import"))
        import_edges = stored(G.import_edges(G.resolve_imports(imports, names)))
        functions = all_symbols.where("kind = 'function'").select(*repo, "file_path", "ord", "name", "calls")
        raw = functions.select(*repo, "file_path", "name", F.explode("calls").alias("call"))
        resolved = stored(G.resolve_calls(raw, functions))
        call_edges = G.call_edges(resolved)
        parts = C.with_import_graph(C.chunks(base, all_symbols), G.adjacency(import_edges))
        return C.with_call_graph(parts, G.adjacency(call_edges), G.external_calls(resolved)), import_edges, call_edges

    def index(self, root: str, namespace: str | None = None, project_id: str | None = None, include_dotfiles: bool = False) -> int:
        """Index a folder in place of the tenant's earlier index; the number of vectors."""
        if not os.path.isdir(root):
            raise ValueError(f"not a directory: {root}")
        name = os.path.basename(os.path.normpath(root))
        return self.index_files(read_tree(self.spark, root, include_dotfiles=include_dotfiles), namespace or name, project_id or name)

    def index_archive(self, archive: str, namespace: str, project_id: str, include_dotfiles: bool = False) -> int:
        """As ``index``, for a zip archive; its members are read where the archive lies, not unpacked."""
        return self.index_files(read_archives(self.spark, archive, include_dotfiles), namespace, project_id)

    def index_remote(self, source: RemoteArchive, owner: str, repo: str, target: str, namespace: str, project_id: str, ref: str | None = None) -> int:
        """As ``index_archive``, for an archive that ``source`` fetches to ``target``, a path all executors see."""
        source.check(owner, repo)
        source.fetch(owner, repo, ref, target)
        return self.index_archive(target, namespace, project_id)

    def index_files(self, files: DataFrame, namespace: str, project_id: str) -> int:
        """As ``index``, for files that are rows already."""
        parts, import_edges, call_edges = self.analyse(files)
        if parts.isEmpty():
            self.delete(namespace, project_id)
            return 0
        parts = embed(parts, self.embedder)
        known = [c for c in parts.columns if c not in ("embedding", "content", "chunk_id")]
        rows = parts.select(
            F.lit(namespace).alias("namespace"), F.lit(project_id).alias("project_id"), "chunk_id", "file_path", "chunk_type", "symbol_name",
            "line_number", "content", F.to_json(F.struct(*known)).alias("metadata"), "embedding", F.current_timestamp().alias("created_at"),
        )
        self.vectors.replace(namespace, project_id, rows)
        tenant = [F.lit(namespace).alias("namespace"), F.lit(project_id).alias("project_id")]
        for name, edges in (("import_edges", import_edges), ("call_edges", call_edges)):
            if edges.isEmpty():
                I.drop_partition(self.spark, f"{self.home}/{name}", namespace, project_id)
                continue
            out = edges.select(*tenant, "src", "dst").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy(*I.TENANT).parquet(f"{self.home}/{name}")
        total = self.vectors.count(namespace, project_id)
        now = F.current_timestamp()
        meta = self.spark.range(1).select(
            F.lit(namespace).alias("namespace"), F.lit(project_id).alias("project_id"), F.lit(type(self.embedder).__name__).alias("embedder"),
            F.lit(type(self.embedder).__name__).alias("model"), F.lit(self.embedder.dim).alias("embedding_dim"), F.lit(False).alias("use_cloud"),
            now.alias("created_at"), now.alias("updated_at"),
        )
        meta.write.mode("append").parquet(self.meta_path)
        return total

    def run_job(self, files: DataFrame, namespace: str, project_id: str, post: Callable | None = None, **given: str) -> str:
        """``index_files`` as a recorded job: its id. The job holds the number of vectors, or the error if it failed.

        Its end is told to the job's ``webhook_url`` by ``post``; a failure to index is recorded and not raised.
        """
        started = registry.new_job(self.spark, namespace, project_id, **given)
        one = self.spark.createDataFrame(started.collect(), JOBS)
        self.jobs.add(one)
        try:
            changes = {"status": "completed", "total_vectors": str(self.index_files(files, namespace, project_id))}
        except Exception as e:  # noqa: BLE001 - whatever went wrong belongs to the job
            changes = {"status": "failed", "error": str(e)[:2000]}
        self.jobs.add(registry.job_update(one, changes))
        job_id = one.first()["job_id"]
        if post is not None:
            notify(self.jobs.get(job_id), post)
        return job_id

    def search_vector(self, namespace: str, project_id: str, vector: Sequence[float], k: int | None = None) -> DataFrame:
        """Hits with score, rank, metadata and payload."""
        I.check_query(vector, k, self.embedder.dim)
        return I.search(self.vectors.read(namespace, project_id), vector, k)

    def search_text(self, namespace: str, project_id: str, text: str, k: int | None = None) -> DataFrame:
        if not text:
            raise ValueError("the query text is empty")
        return self.search_vector(namespace, project_id, self.embed(text), k)

    def embed(self, text: str) -> list[float]:
        if not text:
            raise ValueError("the text is empty")
        return [float(x) for x in self.embedder.encode([text])[0]]

    def info(self, namespace: str, project_id: str) -> dict:
        """Number of vectors and the tenant's metadata, ``{}`` without an index."""
        where = (F.col("namespace") == namespace) & (F.col("project_id") == project_id)
        if exists(self.spark, self.meta_path):
            events = self.spark.read.schema(INDEX_META).parquet(self.meta_path).where(where)
        else:
            events = self.spark.createDataFrame([], INDEX_META)
        rows = registry.upsert_meta(events.limit(0), events).collect()
        total = self.vectors.count(namespace, project_id)
        return {"total_vectors": total, "index_meta": rows[0].asDict() if rows and total else {}}

    def delete(self, namespace: str, project_id: str) -> None:
        """Drop the tenant's vectors and both of its graphs."""
        self.vectors.delete(namespace, project_id)
        for name in ("import_edges", "call_edges"):
            I.drop_partition(self.spark, f"{self.home}/{name}", namespace, project_id)
