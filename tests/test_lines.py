"""Line windows: frames, bodies, key-value and shell readers, against golden inputs and brute force."""

import random

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import lines as L

ENV = "# db\nHOST=localhost\n\n[sec]\nKEY: 'v'\n*.log\n; note\n\nLATE = x\n"
SHELL = "#!/bin/bash\n# Say hi\ngreet() {\n  echo hi\n}\nalias ll='ls -l'\nsource ./lib.sh\nexport FOO=1\nfunction greet {\n:\n}\nif () {\n}\n"


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "id int, content string, ln string")


def test_key_values(spark):
    df = frame_of(spark, [(1, ENV, "x"), (2, None, "x"), (3, "", "x")])
    got = sorted((r.line, r.kind, r.name, r.signature, r.docstring) for r in L.key_values(df, "content", "id").collect())
    assert got == [
        (1, "entry", "HOST", "HOST = localhost", "db"), (3, "section", "sec", "", ""), (4, "entry", "sec.KEY", "KEY = v", ""), (5, "entry", "*.log", "*.log", ""),
        (8, "entry", "sec.LATE", "LATE = x", ""),
    ]


def test_shell(spark):
    df = frame_of(spark, [(1, SHELL, "x"), (2, None, "x"), (3, "", "x")])
    got = sorted((r.line, r.name, r.signature, r.docstring) for r in L.shell_symbols(df, "content", "id").collect())
    # the keyword form of a name comes first; keywords are no names
    assert got == [(5, "alias:ll", "alias ll='ls -l'", ""), (8, "greet", "function greet", "")]
    plain = frame_of(spark, [(1, SHELL.replace("function greet {\n:\n}\n", ""), "x")])
    got = sorted((r.line, r.name, r.signature, r.docstring) for r in L.shell_symbols(plain, "content", "id").collect())
    assert got[0] == (2, "greet", "greet()", "!/bin/bash Say hi")
    assert [r["import"] for r in L.shell_imports(df, "content", "id").collect()] == ["./lib.sh"]


def test_config_imports(spark):
    df = frame_of(spark, [(1, "Include 'a.conf'\ninclude\nx = 1\n. b.sh\nincludePath c\n", "x"), (2, None, "x")])
    assert [(r.line, r["import"]) for r in L.config_imports(df, "content", "id").orderBy("line").collect()] == [(0, "a.conf"), (3, "b.sh"), (4, "c")]


def indent_end(lines, start, reach=200):
    base = len(lines[start]) - len(lines[start].lstrip())
    for i in range(start + 1, min(len(lines), start + reach)):
        if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= base:
            return i
    return min(len(lines), start + reach)


def brace_end(lines, start, reach=300, default=30):
    depth, opened = 0, False
    for i in range(start, min(len(lines), start + reach)):
        for c in lines[i]:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
            if c == "}" and opened and depth == 0:
                return i + 1
    return min(len(lines), start + default)


def test_bodies_equal_brute_force(spark):
    rng = random.Random(5)
    pieces = ["def f():", "    x = 1", "        y", "", "{", "}", "  a { b", "} c", "{}", "\tz"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rows = [(i, t, rng.randrange(len(t.split("\n")))) for i, t in enumerate(texts) if t.strip()]
    rows = [(i, t, min(s, len(t.rstrip("\n").split("\n")) - 1)) for i, t, s in rows]
    df = spark.createDataFrame(rows, "i int, t string, s int").withColumn("l", T.lines(F.col("t")))
    got = df.orderBy("i").select("t", "s", L.body_end_by_indent(F.col("l"), F.col("s"), 12), L.body_end_by_braces(F.col("l"), F.col("s"), 12, 5), L.frame(F.col("l"), F.col("s"), 2, 4)).collect()
    for t, s, a, b, f in got:
        lines = t.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert a == indent_end(lines, s, 12) and b == brace_end(lines, s, 12, 5)
        assert f == "\n".join(lines[max(0, s - 2) : s + 4]).rstrip() + "\n"
