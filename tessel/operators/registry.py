"""Small state: jobs as events, index metadata, and projects. Last writer wins per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.functions.keys import iso_utc, random_id
from tessel.operators.vector_index import TENANT, latest, steady
from tessel.schemas import JOBS
from tessel.session import exists

JOB_STATES = ("queued", "downloading", "running", "completed", "failed")
PROJECT_FIELDS = ("name", "namespace", "description", "github_owner", "github_repo", "github_ref")


def job_states(events: DataFrame, key: Sequence[str] = ("job_id",), *order: Column) -> DataFrame:
    """The present state of each job: its event with the latest ``updated_at``."""
    return latest(events, key, *(order or (F.col("updated_at").desc_nulls_last(),)))


def job(events: DataFrame, job_id: str) -> DataFrame:
    """One job's present state; no row if it is unknown."""
    return job_states(events.where(F.col("job_id") == job_id))


def new_job(spark: SparkSession, namespace: str, project_id: str, now: Column | None = None, **given: str) -> DataFrame:
    """The first event of a job: a row of the jobs' schema with an id of its own; fields not given are null."""
    now = now if now is not None else F.current_timestamp()
    made = {"job_id": random_id(), "namespace": F.lit(namespace), "project_id": F.lit(project_id), "status": F.lit(JOB_STATES[0]), "created_at": now, "updated_at": now}
    made |= {k: F.lit(v) for k, v in given.items()}
    return spark.range(1).select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOBS.fields))


def job_update(current: DataFrame, changes: dict[str, str], now: Column | None = None) -> DataFrame:
    """The event that changes some columns of the jobs in ``current``; without changes, the jobs as they are."""
    if not changes:
        return current
    stamped = current.withColumns({k: F.lit(v).cast(current.schema[k].dataType) for k, v in changes.items()})
    return stamped.withColumn("updated_at", now if now is not None else F.current_timestamp())


def with_iso_times(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: iso_utc(F.col(c)) for c in columns})


def upsert_meta(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Index metadata per tenant: everything overwritten by the latest row but the first ``created_at``."""
    both = current.unionByName(incoming)
    first = F.min("created_at").over(Window.partitionBy(*TENANT))
    return latest(both.withColumn("created_at", first), TENANT, F.col("updated_at").desc_nulls_last())


def tenant_info(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts of vectors with the index metadata, null where there is none."""
    return counts.join(meta, TENANT, "left")


def create_project(projects: DataFrame, namespace: str, name: str, now: Column, **given: str) -> DataFrame:
    """``projects`` with one more, under an id of its own; unknown fields are ignored."""
    made = {"id": random_id(), "name": F.lit(name), "namespace": F.lit(namespace), "created_at": now, "updated_at": now}
    made |= {k: F.lit(v) for k, v in given.items() if k in PROJECT_FIELDS}
    one = projects.sparkSession.range(1).select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in projects.schema.fields))
    return projects.unionByName(one)


class EventTable:
    """Small state in a folder: every change is a row, the latest row of a key is its state.

    A row with nothing but key and time says that the key is gone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "job_id", time: str = "updated_at"):
        self.spark, self.path, self.schema, self.key, self.time = spark, path, schema, key, time

    def add(self, rows: DataFrame) -> None:
        """Append changes; nothing stored is touched, so writers never meet."""
        rows.select(*self.schema.fieldNames()).write.mode("append").parquet(self.path)

    def state(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        held = F.coalesce(*(F.col(c).cast("string") for c in self.schema.fieldNames() if c not in (self.key, self.time)))
        return latest(rows, [self.key], F.col(self.time).desc_nulls_last(), steady(rows)).where(held.isNotNull())

    def drop(self, value: str, now: Column | None = None) -> None:
        """Forget a key."""
        made = {self.key: F.lit(value), self.time: now if now is not None else F.current_timestamp()}
        self.add(self.spark.range(1).select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields)))

    def get(self, value: str) -> dict | None:
        found = self.state().where(F.col(self.key) == value).collect()
        return found[0].asDict() if found else None


def list_projects(projects: DataFrame, namespace: str | None = None) -> DataFrame:
    """Projects, newest first, of one namespace or all."""
    rows = projects if namespace is None else projects.where(F.col("namespace") == namespace)
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "id")


def update_project(projects: DataFrame, project_id: str, changes: dict[str, str], now: Column) -> DataFrame:
    """Allowed fields of one project changed, others ignored; ``updated_at`` is stamped in any case."""
    hit = F.col("id") == project_id
    wanted = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items() if k in PROJECT_FIELDS}
    return projects.withColumns(wanted | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def delete_project(projects: DataFrame, project_id: str) -> DataFrame:
    return projects.where(F.col("id") != project_id)
