"""An approximate index over the vector table: inverted lists around centroids, searched by partition pruning.

Centroids of a tenant are fitted by spherical k-means on a bounded sample; every row is stored in the list of its
nearest centroid, a partition of the table. A search opens the lists nearest to the query and ranks their rows exactly,
so a search over all lists is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.vector_index import TENANT, check_query, search
from tessel.session import exists

#: Rows the centroids are fitted on at most, and lists at most: what the driver holds and what is broadcast.
SAMPLE, MAX_LISTS = 20_000, 4_096


def fit_centroids(vectors: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of ``vectors`` by spherical k-means; at most as many as there are different vectors."""
    x = vectors[np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)]
    x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    if not len(x):
        return np.zeros((0, vectors.shape[1]))
    lists = min(lists, len(x))
    centroids = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        owner = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def with_lists(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` with ``list``, the number of the nearest centroid; -1 for vectors that have no direction."""
    dim = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))
    columns = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = columns.index("embedding")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = np.full(batch.num_rows, -1, dtype=np.int32)
            vectors = batch.column(at)
            sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
            right = np.flatnonzero(sizes == dim)
            if len(right) and len(shared.value):
                x = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                lists[right[usable]] = np.argmax(x[usable] @ shared.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], names=[*columns, "list"])

    return rows.mapInArrow(assign, f"{fields}, list int")


class ListIndex:
    """Inverted lists in a folder: rows partitioned by tenant and list, and a table of centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rows_path, self.centroids_path = spark, f"{path}/rows", f"{path}/centroids"

    def build(self, rows: DataFrame, namespace: str, project_id: str, lists: int | None = None) -> int:
        """Index the tenant's ``rows`` in place of its earlier index; the number of lists.

        By default as many lists as the root of the number of rows, so a list holds about as many rows as there are lists.
        """
        own = rows.withColumns({"namespace": F.lit(namespace), "project_id": F.lit(project_id)})
        total = own.count()
        lists = min(MAX_LISTS, lists or max(1, round(total**0.5)))
        sample = own.where("embedding IS NOT NULL").orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toArrow().column(0)
        vectors = sample.combine_chunks() if sample.num_chunks != 1 else sample.chunk(0)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False) if len(vectors) else np.zeros(0, dtype=int)
        dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        fitting = vectors.take(pa.array(np.flatnonzero(sizes == dim))) if dim else vectors.slice(0, 0)
        flat = fitting.flatten().to_numpy(zero_copy_only=False) if dim else np.zeros(0)
        centroids = fit_centroids(flat.astype(float).reshape(len(fitting), dim), lists)
        writer = with_lists(own, centroids).repartition(F.col("list")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        for_tenant = self.spark.createDataFrame(
            [(namespace, project_id, i, [float(x) for x in c]) for i, c in enumerate(centroids)] or [(namespace, project_id, -1, None)],
            "namespace string, project_id string, list int, centroid array<double>",
        )
        if exists(self.spark, self.rows_path):  # lists of the earlier index that have no rows now
            from tessel.operators.vector_index import drop_partition

            drop_partition(self.spark, self.rows_path, namespace, project_id)
        writer.partitionBy(*TENANT, "list").parquet(self.rows_path)
        for_tenant.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TENANT).parquet(self.centroids_path)
        return len(centroids)

    def search(self, namespace: str, project_id: str, vector: Sequence[float], k: int | None = None, probes: int = 8, id_col: str = "chunk_id", **options) -> DataFrame:
        """The ``k`` most similar rows of the ``probes`` nearest lists; exact with as many probes as lists."""
        k = check_query(vector, k, None)
        mine = (F.col("namespace") == namespace) & (F.col("project_id") == project_id)
        centroids = self.spark.read.parquet(self.centroids_path).where(mine & F.col("centroid").isNotNull()).select("list", "centroid").collect()
        q = np.asarray(vector, dtype=float)
        near = sorted(centroids, key=lambda r: -float(np.dot(r["centroid"], q)) if len(r["centroid"]) == len(q) else np.inf)[:probes]
        opened = [r["list"] for r in near] + ([-1] if len(near) == len(centroids) else [])
        rows = self.spark.read.parquet(self.rows_path).where(mine & F.col("list").isin(opened)).drop("list")
        return search(rows, vector, k, id_col, **options)
