"""The vector table: keyed upsert, atomic replace, delete, count and exact search.

Rows are ``(namespace, project_id, chunk_id, ..., embedding, created_at)``. The functions are plain
transformations; ``VectorIndex`` keeps a table as Parquet partitioned by tenant, so a tenant's predicate prunes
directories and replacing a tenant is one dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.functions import vectors as V
from tessel.session import ensure_checkpoint_dir, exists, remove

TENANT = ["namespace", "project_id"]
KEY = [*TENANT, "chunk_id"]
DEFAULT_K = 5


def steady(rows: DataFrame) -> Column:
    """A fixed order of different rows, where nothing else orders them."""
    return F.xxhash64(*(F.col(c) for c in rows.columns)).desc()


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` whose key is not in ``gone``; null keys equal each other."""
    other = gone.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct()
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key. The filter on the row number is a group limit, applied before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(rank)).where("__nth = 1").drop("__nth")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str] = tuple(KEY), sequence: str | None = None) -> DataFrame:
    """``current`` with ``incoming`` merged in: payloads of known keys overwritten, ``created_at`` kept.

    Of several incoming rows of a key the one with the largest ``sequence`` counts (a fixed one without it).
    """
    order = [F.col(sequence).desc_nulls_last()] if sequence else []
    new = latest(incoming, keys, *order, steady(incoming)).withColumn("__new", F.lit(1))
    both = current.withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    whole = Window.partitionBy(*keys)
    first = F.coalesce(F.max(F.when(F.col("__new") == 0, F.col("created_at"))).over(whole), F.col("created_at"))
    merged = both.withColumn("created_at", first).withColumn("__last", F.max("__new").over(whole))
    return merged.where("__new = __last").drop("__new", "__last")


def stale(current: DataFrame, incoming: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Rows of ``current`` whose key doesn't come in."""
    return without(current, incoming, keys)


def replace_all(current: DataFrame, incoming: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """``incoming`` in place of everything its tenants had; other tenants untouched.

    ``tenants`` names further tenants that are replaced: one without incoming rows becomes empty.
    """
    named = incoming.select(*TENANT)
    if tenants is not None:
        named = named.unionByName(tenants.select(*TENANT))
    return without(current, named, TENANT).unionByName(latest(incoming, KEY, steady(incoming)), allowMissingColumns=True)


def delete_tenant(current: DataFrame, namespace: str, project_id: str | None = None) -> DataFrame:
    gone = F.col("namespace") == namespace
    if project_id is not None:
        gone = gone & (F.col("project_id") == project_id)
    return current.where(~F.coalesce(gone, F.lit(False)))


def delete_file(current: DataFrame, namespace: str, project_id: str, file_path: str) -> DataFrame:
    gone = (F.col("namespace") == namespace) & (F.col("project_id") == project_id) & (F.col("file_path") == file_path)
    return current.where(~F.coalesce(gone, F.lit(False)))


def tenant_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TENANT).agg(F.count(F.lit(1)).alias("total_vectors"))


def dimensions(rows: DataFrame) -> DataFrame:
    """How many vectors have which length; the dimension check of a table."""
    return rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def check_query(vector: Sequence[float] | None, k: int | None, dim: int | None) -> int:
    """The number of hits to return; raises on empty vectors, other lengths and negative ``k``."""
    if not vector:
        raise ValueError("the query vector is empty")
    if dim is not None and len(vector) != dim:
        raise ValueError(f"the query has {len(vector)} dimensions, the index {dim}")
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    return k or DEFAULT_K


def search(
    rows: DataFrame, vector: Sequence[float], k: int | None = None, id_col: str = "chunk_id", digits: int | None = None,
    clamp: bool = False,
) -> DataFrame:
    """The ``k`` most similar rows with ``similarity_score`` and ``rank`` (from 1); ties by ``id_col``.

    Exact: one scan, a constant query vector, and a take-ordered of k rows per partition. Zero vectors and
    vectors of other lengths have a null score and come last.
    """
    k = check_query(vector, k, None)
    score = V.cosine(F.col("embedding"), V.literal(vector))
    if clamp:
        score = F.greatest(F.lit(0.0), score)
    if digits is not None:
        score = F.round(score, digits)
    top = rows.withColumn("similarity_score", score).orderBy(F.col("similarity_score").desc_nulls_last(), id_col).limit(k)
    order = Window.orderBy(F.col("similarity_score").desc_nulls_last(), id_col)
    return top.withColumn("rank", F.row_number().over(order))  # on k rows


def drop_partition(spark: SparkSession, path: str, namespace: str, project_id: str) -> None:
    """Remove the folder of one tenant from a table partitioned by tenant.

    The folder's name is Spark's own escaping of the values, in which no separator of paths is left, so nothing
    outside the table can be named.
    """
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    parts = [utils.getPartitionPathString(c, v) for c, v in zip(TENANT, (namespace, project_id))]
    if any("/" in p for p in parts):
        raise ValueError(f"not a tenant: {namespace!r}, {project_id!r}")
    remove(spark, "/".join([path, *parts]))


class VectorIndex:
    """A vector table in a folder, partitioned by tenant."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, namespace: str | None = None, project_id: str | None = None) -> DataFrame:
        if not exists(self.spark, self.path):
            rows = self.spark.createDataFrame([], self.schema)
        else:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        if namespace is not None:
            rows = rows.where(F.col("namespace") == namespace)
        return rows.where(F.col("project_id") == project_id) if project_id is not None else rows

    def write(self, rows: DataFrame) -> None:
        """Replace the partitions of the tenants in ``rows``, each in one step; readers never see half of one."""
        ordered = rows.select(*self.schema.fieldNames())
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TENANT).parquet(self.path)

    def replace(self, namespace: str, project_id: str, incoming: DataFrame) -> None:
        """``incoming`` in place of all rows of the tenant; without rows the tenant is gone."""
        named = incoming.withColumns({"namespace": F.lit(namespace), "project_id": F.lit(project_id)})
        if named.isEmpty():
            self.delete(namespace, project_id)
        else:
            self.write(latest(named, KEY, steady(named)))

    def add(self, incoming: DataFrame) -> None:
        """Upsert ``incoming``. The old rows are cut off by a checkpoint before the overwrite."""
        ensure_checkpoint_dir(self.spark)
        tenants = incoming.select(*TENANT).distinct()
        old = self.read().join(tenants, TENANT, "left_semi")
        self.write(upsert(old, incoming).checkpoint())

    def delete(self, namespace: str, project_id: str) -> None:
        """Drop a tenant's partition."""
        drop_partition(self.spark, self.path, namespace, project_id)

    def clear(self) -> None:
        """Drop all rows."""
        remove(self.spark, self.path)

    def delete_file(self, namespace: str, project_id: str, file_path: str) -> int:
        """Remove a file's rows; how many there were."""
        ensure_checkpoint_dir(self.spark)
        rows = self.read(namespace, project_id)
        gone = rows.where(F.col("file_path") == file_path).count()
        if gone:
            kept = delete_file(rows, namespace, project_id, file_path).checkpoint()
            if kept.isEmpty():
                self.delete(namespace, project_id)
            else:
                self.write(kept)
        return gone

    def count(self, namespace: str, project_id: str) -> int:
        return self.read(namespace, project_id).count()
