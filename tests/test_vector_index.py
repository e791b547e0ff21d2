"""Upsert, replace, delete, search; and the stored table."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessel.operators import registry
from tessel.operators import vector_index as I
from tessel.schemas import INDEX_META, JOBS, PROJECTS, VECTORS
from tessel.streaming.ingest import job_state_stream, upsert_stream

T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def row(key, value, at, project="p", vector=(1.0, 0.0), path="f"):
    return ("n", project, key, path, "function", key, 1, value, "{}", list(vector), at)


def payload(df):
    return {(r.project_id, r.chunk_id): (r.content, r.created_at) for r in df.collect()}


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([row("k1", "v1", T0), row("k2", "v2", T0), row("k9", "x", T0, "q")], VECTORS)
    new = spark.createDataFrame([row("k1", "v1'", T1), row("k3", "v3", T1)], VECTORS)
    keep = {("q", "k9"): ("x", T0)}
    assert payload(I.upsert(old, new)) == keep | {("p", "k1"): ("v1'", T0), ("p", "k2"): ("v2", T0), ("p", "k3"): ("v3", T1)}
    assert payload(I.replace_all(old, new)) == keep | {("p", "k1"): ("v1'", T1), ("p", "k3"): ("v3", T1)}
    assert payload(I.replace_all(I.replace_all(old, new), new)) == payload(I.replace_all(old, new))
    assert [r.chunk_id for r in I.stale(old.where("project_id = 'p'"), new).collect()] == ["k2"]
    twice = spark.createDataFrame([(*row("k1", "a", T1), 1), (*row("k1", "b", T1), 2)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VECTORS) + ", seq int")
    assert payload(I.upsert(old.withColumn("seq", F.lit(0)), twice, sequence="seq"))["p", "k1"] == ("b", T0)
    assert payload(I.upsert(old.limit(0), new)) == {("p", "k1"): ("v1'", T1), ("p", "k3"): ("v3", T1)}
    assert payload(I.upsert(old, new.limit(0))) == payload(old)
    assert payload(I.delete_tenant(old, "n", "p")) == keep and payload(I.delete_file(old, "n", "p", "f")) == keep


def test_search(spark):
    rows = [row("a", "", T0), row("b", "", T0, vector=(1.0, 1.0)), row("c", "", T0, vector=(0.0, 1.0)), row("d", "", T0, vector=(-1.0, 0.0)), row("e", "", T0, vector=(0.0, 0.0)), row("a2", "", T0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(r.chunk_id, r.rank, r.similarity_score) for r in I.search(df, [1.0, 0.0], 10, digits=6).orderBy("rank").collect()]
    assert got == [("a", 1, 1.0), ("a2", 2, 1.0), ("b", 3, 0.707107), ("c", 4, 0.0), ("d", 5, -1.0), ("e", 6, None)]
    assert [r.similarity_score for r in I.search(df, [1.0, 0.0], 5, clamp=True).orderBy("rank").collect()][-1] == 0.0
    full = [r.chunk_id for r in I.search(df, [1.0, 0.3], 6).orderBy("rank").collect()]
    assert [r.chunk_id for r in I.search(df, [1.0, 0.3], 3).orderBy("rank").collect()] == full[:3]
    assert I.search(df, [1.0, 0.0], 0).count() == 5 and I.search(df, [1.0, 0.0], None).count() == 5
    assert "TakeOrderedAndProject" in I.search(df, [1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    for bad in ([], None):
        with pytest.raises(ValueError):
            I.check_query(bad, 5, 2)
    with pytest.raises(ValueError):
        I.check_query([1.0], 5, 2)
    with pytest.raises(ValueError):
        I.search(df, [1.0, 0.0], -1)


def test_stored_index(spark, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "v"), VECTORS)
    assert index.read().count() == 0
    index.add(spark.createDataFrame([row("k1", "v1", T0), row("k9", "x", T0, "q", path="g")], VECTORS))
    index.add(spark.createDataFrame([row("k1", "v2", T1), row("k2", "v2", T1, path="g")], VECTORS))
    assert payload(index.read("n", "p")) == {("p", "k1"): ("v2", T0), ("p", "k2"): ("v2", T1)}
    assert index.delete_file("n", "p", "g") == 1 and index.count("n", "p") == 1 and index.count("n", "q") == 1
    index.replace("n", "p", spark.createDataFrame([row("k5", "v5", T1)], VECTORS))
    assert payload(index.read()) == {("p", "k5"): ("v5", T1), ("q", "k9"): ("x", T0)}
    plan = index.read("n", "p")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan
    index.delete("n", "q")
    assert index.count("n", "q") == 0 and index.delete_file("n", "p", "nothing") == 0


def test_replace_by_nothing(spark):
    old = spark.createDataFrame([row("k1", "v", T0), row("k2", "w", T0, "q"), (None, None, *row("k3", "x", T0)[2:])], VECTORS)
    gone = spark.createDataFrame([("n", "p"), (None, None), ("never", "seen")], "namespace string, project_id string")
    assert payload(I.replace_all(old, old.limit(0), gone)) == {("q", "k2"): ("w", T0)}
    assert I.stale(old, old).count() == 0  # null keys equal each other


NAMES = ["a:b", "a/b", "50%", "..", "../../victim", "a b=c", "x#y?", "ä"]


def test_names_of_tenants_never_leave_the_table(spark, tmp_path):
    victim = tmp_path / "victim"
    victim.mkdir()
    (victim / "file").write_text("x")
    index = I.VectorIndex(spark, str(tmp_path / "t" / "v"), VECTORS)
    for name in NAMES:
        index.replace("n", name, spark.createDataFrame([row("k", name, T0)], VECTORS))
    for name in NAMES:
        assert [r.content for r in index.read("n", name).collect()] == [name]
    for i, name in enumerate(NAMES):
        index.delete("n", name)
        assert index.count("n", name) == 0 and index.read().count() == len(NAMES) - 1 - i
    index.delete("n", "p/../../../../victim")
    assert (victim / "file").exists()
    index.replace("n", "p", spark.createDataFrame([row("k", "v", T0)], VECTORS))
    index.replace("n", "p", spark.createDataFrame([], VECTORS))
    assert index.count("n", "p") == 0
    index.replace("n", "p", spark.createDataFrame([row("k", "v", T0)], VECTORS))
    index.clear()
    assert index.read().count() == 0


def test_new_jobs_and_projects(spark):
    made = registry.new_job(spark, "n", "p", filename="x.zip")
    one = made.first()
    assert made.columns == JOBS.fieldNames() and one.status == "queued" and len(one.job_id) == 32 and one.filename == "x.zip" and one.error is None
    none = spark.createDataFrame([], PROJECTS)
    got = registry.create_project(none, "n", "first", F.lit("t"), github_ref="main", other="dropped").collect()
    assert [(r.name, r.namespace, r.github_ref, r.created_at, len(r.id)) for r in got] == [("first", "n", "main", "t", 32)]


def test_projects_are_kept(spark, tmp_path):
    store = registry.EventTable(spark, str(tmp_path / "projects"), PROJECTS, key="id")
    none = spark.createDataFrame([], PROJECTS)
    for i, name in enumerate(("one", "two")):
        store.add(spark.createDataFrame(registry.create_project(none, "n", name, F.lit(f"2025-01-0{i + 1}")).collect(), PROJECTS))
    newest = [r.name for r in registry.list_projects(store.state(), "n").collect()]
    assert newest == ["two", "one"]
    first = store.state().where("name = 'one'").first().id
    changed = registry.update_project(store.state(), first, {"name": "uno", "namespace": "m"}, F.lit("2025-02-01")).where(F.col("id") == first)
    store.add(spark.createDataFrame(changed.collect(), PROJECTS))
    assert store.get(first)["name"] == "uno" and [r.name for r in registry.list_projects(store.state(), "n").collect()] == ["two"]
    store.drop(first, F.lit("2025-03-01"))
    assert store.get(first) is None and store.state().count() == 1


def test_stream_into_the_index(spark, tmp_path):
    source, index = tmp_path / "in", I.VectorIndex(spark, str(tmp_path / "v"), VECTORS)
    spark.createDataFrame([row("k1", "a", T0), row("k1", "b", T1)], VECTORS).coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(VECTORS).parquet(str(source))
    upsert_stream(stream(), index, str(tmp_path / "c")).awaitTermination()
    assert payload(index.read()) == {("p", "k1"): ("b", T1)}
    spark.createDataFrame([row("k2", "c", T1)], VECTORS).write.mode("append").parquet(str(source))
    upsert_stream(stream(), index, str(tmp_path / "c")).awaitTermination()
    assert payload(index.read()) == {("p", "k1"): ("b", T1), ("p", "k2"): ("c", T1)}


def test_job_stream(spark, tmp_path):
    jobs = [(f"j{i}", "n", "p", None, "running" if i % 2 else "failed", *[None] * 9, T0, T0) for i in range(5)]
    spark.createDataFrame(jobs, JOBS).write.parquet(str(tmp_path / "jobs"))
    stream = job_state_stream(spark.readStream.schema(JOBS).parquet(str(tmp_path / "jobs")))
    query = stream.writeStream.format("memory").queryName("jobs_by_state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.status, r.n) for r in spark.table("jobs_by_state").collect()} == {("failed", 3), ("running", 2)}


def test_registry(spark):
    jobs = spark.createDataFrame([("a", "n", "p", None, "queued", *[None] * 9, T0, T0), ("a", "n", "p", None, "running", *[None] * 9, T0, T1)], JOBS)
    now = registry.job(jobs, "a")
    assert now.first().status == "running" and registry.job(jobs, "zz").count() == 0
    changed = registry.job_update(now, {"status": "completed", "total_vectors": "3"}, F.lit(datetime(2025, 1, 3)))
    assert registry.job(jobs.unionByName(changed), "a").first().total_vectors == 3 and registry.job_update(now, {}).first().status == "running"
    meta = [("n", "p", "e1", "m", 64, False, T0, T0), ("n", "p", "e2", "m", 32, False, T1, T1), ("n", "q", "e", "m", 1, None, None, None)]
    merged = {r.project_id: r for r in registry.upsert_meta(spark.createDataFrame([], INDEX_META), spark.createDataFrame(meta, INDEX_META)).collect()}
    assert merged["p"].embedder == "e2" and merged["p"].created_at == T0 and merged["q"].embedding_dim == 1
    projects = spark.createDataFrame([("1", "a", "n", None, None, None, None, "2025-01-01", "x"), ("2", "b", "m", None, None, None, None, "2025-01-02", "x")], PROJECTS)
    assert [r.id for r in registry.list_projects(projects).collect()] == ["2", "1"] and [r.id for r in registry.list_projects(projects, "n").collect()] == ["1"]
    up = {r.id: r for r in registry.update_project(projects, "1", {"name": "z", "id": "9"}, F.lit("now")).collect()}
    assert up["1"].name == "z" and up["1"].updated_at == "now" and up["2"].updated_at == "x"
    assert registry.delete_project(projects, "1").count() == 1
