"""Inverted lists, embedders with a service or a model behind them, addresses of databases."""

import json

import numpy as np
import pytest

from tessel.operators import ann
from tessel.operators import vector_index as I
from tessel.operators.embedding import PooledEmbedder, ServiceEmbedder, embed, web_service
from tessel.plans.engine import Engine
from tessel.sources.database import jdbc_options


def test_lists(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * 0.4
    rows = [(f"c{i:03d}", [float(v) for v in x[i]], 1) for i in range(600)] + [("null", None, 1), ("zero", [0.0] * 16, 1), ("short", [1.0], 1)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, list_ int")
    index = ann.ListIndex(spark, str(tmp_path / "i"))
    assert index.build(df, "n", "a/b") == 25
    hits = total = 0
    for i in range(0, 600, 60):
        exact = [r.chunk_id for r in I.search(df, list(x[i]), 5).orderBy("rank").collect()]
        assert [r.chunk_id for r in index.search("n", "a/b", list(x[i]), 5, probes=25).orderBy("rank").collect()] == exact
        got = {r.chunk_id for r in index.search("n", "a/b", list(x[i]), 5, probes=6).collect()}
        hits, total = hits + len(got & set(exact)), total + 5
    assert hits / total >= 0.9
    assert index.search("n", "a/b", list(x[0]), 700, probes=25).count() == 603
    plan = index.search("n", "a/b", list(x[0]), 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan
    index.build(df.limit(5), "n", "a/b", 2)
    assert index.search("n", "a/b", list(x[0]), 50, probes=2).count() == 5
    assert index.build(df.where("chunk_id = 'null'"), "n", "none") == 0


def test_service(spark):
    calls = []

    def post(texts, kind):
        calls.append((len(texts), kind))
        if len(calls) == 1:
            raise OSError("busy")
        return [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]

    service = ServiceEmbedder(post, 2, batch=2, wait=0)
    assert service.encode(["a", "bb", "ccc"]).tolist() == [[1, 1], [2, 1], [3, 1]] and calls == [(2, "document"), (2, "document"), (1, "document")]
    assert service.encode_query("four").tolist() == [4, 1] and calls[-1] == (1, "query")
    assert service.encode([]).shape == (0, 2)

    def down(texts, kind):
        raise OSError("down")

    with pytest.raises(OSError):
        ServiceEmbedder(down, 2, wait=0).encode(["a"])
    df = spark.createDataFrame([("x",), (None,)], "content string")
    pooled = PooledEmbedder(lambda texts: (np.ones((len(texts), 3, 4)), np.array([[1, 1, 0]] * len(texts))), 4)
    assert all(abs(sum(v * v for v in r.embedding) - 1) < 1e-6 for r in embed(df, pooled).collect())
    assert pooled.encode([]).shape == (0, 4)


def test_web_service():
    sent = []

    def send(url, body, headers):
        asked = json.loads(body)
        sent.append((url, asked["input_type"], asked["model"], headers["Authorization"]))
        return json.dumps({"data": [{"index": i, "embedding": [len(t)]} for i, t in enumerate(asked["input"])]}).encode()

    service = ServiceEmbedder(web_service("http://s", "m", "key", send), 1)
    assert service.encode(["ab", "c"]).tolist() == [[2], [1]] and service.encode_query("abc").tolist() == [3]
    assert sent == [("http://s", "document", "m", "Bearer key"), ("http://s", "query", "m", "Bearer key")]


class Failing:
    dim = 2

    def encode(self, texts):
        raise OSError("no vectors today")


def test_jobs(spark, tmp_path):
    files = spark.createDataFrame([("/r/a.py", bytearray(b"def f():\n    return 1\n"))], "path string, content binary")
    engine, sent = Engine(spark, str(tmp_path / "h")), []
    assert engine.jobs.state().count() == 0 and engine.jobs.get("x") is None
    done = engine.jobs.get(engine.run_job(files, "n", "p", lambda *a: sent.append(a), webhook_url="http://hook", source="test"))
    assert (done["status"], done["total_vectors"], done["source"], done["error"]) == ("completed", 2, "test", None) and sent[0][0] == "http://hook"
    failing = Engine(spark, str(tmp_path / "h"), Failing())
    failed = failing.jobs.get(failing.run_job(files, "n", "q"))
    assert failed["status"] == "failed" and "no vectors today" in failed["error"] and engine.jobs.state().count() == 2


def test_addresses():
    got = jdbc_options("postgres://me:p%40ss@db.host/app?sslmode=require", 4)
    assert got == {"url": "jdbc:postgresql://db.host:5432/app?sslmode=require", "numPartitions": "4", "user": "me", "password": "p@ss"}
    assert jdbc_options("postgresql+driver://h:99/x") == {"url": "jdbc:postgresql://h:99/x", "numPartitions": "20"}
    for bad in ("mysql://h/x", "postgres:///x", "postgres://h", ""):
        with pytest.raises(ValueError):
            jdbc_options(bad)
