"""Paths, texts, keys and vectors against their plain-Python counterparts."""

import hashlib
import math
import os
import posixpath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import keys, paths, text, vectors


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


NAMES = ["a.py", ".env", "a.", "..a.b", "a.tar.gz", "noext", ".a.b.c", "dir.x/file", "x/.hidden", "", "...", "a/b.C", "/r/.x/y.z.w"]


def test_split_extension(spark):
    assert values(spark, NAMES, paths.extension) == [os.path.splitext(n)[1] for n in NAMES]
    assert values(spark, NAMES, paths.base_name) == [os.path.basename(n) for n in NAMES]
    assert values(spark, NAMES, paths.stem) == [os.path.splitext(os.path.basename(n))[0] for n in NAMES]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), min_size=1, max_size=6).map("/".join), min_size=1, max_size=30))
def test_normalize(spark, raw):
    raw = [p for p in raw if not p.startswith("//")]
    assert values(spark, raw, paths.normalize) == [posixpath.normpath(p) for p in raw]


TEXTS = ["", "a", "a\n", "a\nb", "\n", "a\r\nb\rc\n", "\n\n", "x\r", "é\n ü "]


def test_lines(spark):
    import io

    expected = [[x.rstrip("\n") for x in io.StringIO(t.replace("\r\n", "\n").replace("\r", "\n"))] for t in TEXTS]
    assert values(spark, TEXTS, text.lines) == expected


def test_text_helpers(spark):
    raw = ["  a b ", "\t\n x\n", "", "a" * 150, "'q\"", "   y"]
    assert values(spark, raw, text.strip) == [r.strip() for r in raw]
    assert values(spark, raw, text.rstrip) == [r.rstrip() for r in raw]
    assert values(spark, raw, text.collapse) == [" ".join(r.split()) for r in raw]
    assert values(spark, raw, text.unquote) == [r.strip("'\"") for r in raw]
    assert values(spark, raw, text.clip)[3] == "a" * 100 + "…"
    assert values(spark, raw, text.indent) == [len(r) - len(r.lstrip()) for r in raw]
    got = values(spark, ["a\nb\nkey", "key", "none", ""], lambda c: text.first_line_of(c, F.lit("key")))
    assert got == [2, 0, 0, 0]


def test_chunk_ids_are_the_recipe(spark):
    rows = [("/r/a.py", "function", "A.run", None, 6), ("/r/a.py", "class", None, "A", 4), ("/r/a.py", "imports", None, None, None), ("/r/a.py", "file_summary", "", "a.py", None), (None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string, f string, s string, l int")
    got = [r[0] for r in df.orderBy("i").select(keys.chunk_id(F.col("p"), F.col("t"), F.col("f"), F.col("s"), line=F.col("l"))).collect()]
    want = ["::".join([r[0] or "", r[1] or "", r[2] or r[3] or "", str(r[4] if r[4] is not None else "")]) for r in rows]
    assert got == [hashlib.md5(w.encode()).hexdigest() for w in want]
    # known values
    assert got[:4] == ["0f0fb1d300db2d6a4f1801504fc2e1a3", "63b230f928f8eb6d12159c9b0f4e84e1", "d96fe594b43a57c039b75618dbeb3633", "a40263c093c1f2869b630246bf43e586"]


def test_times_and_ids(spark):
    row = spark.sql("SELECT timestamp'2025-01-02 03:04:05.678901+00:00' AS t").select(keys.iso_utc(F.col("t")), keys.random_id()).first()
    assert row[0] == "2025-01-02T03:04:05.678901Z" and len(row[1]) == 32
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert spark.sql("SELECT timestamp'2025-01-02 03:04:05+00:00' AS t").select(keys.iso_utc(F.col("t"))).first()[0] == "2025-01-02T03:04:05.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert keys.sign(b"{}", "s").startswith("sha256=") and len(keys.sign(b"{}", "s")) == 71


def test_vectors(spark):
    rows = [[1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0], [1.0], None]
    query = lambda c: F.round(vectors.cosine(c, vectors.literal([1.0, 0.0])), 6)
    assert values(spark, rows, query, "array<float>") == [1.0, 0.707107, 0.0, -1.0, None, None, None]
    assert values(spark, rows[:2], vectors.norm, "array<float>") == [1.0, math.sqrt(2)]
    assert values(spark, rows[4:5], vectors.unit, "array<float>") == [[0.0, 0.0]]
