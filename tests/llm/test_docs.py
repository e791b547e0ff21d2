"""Problem 3: functions and their documentation."""

import pytest

from tessel.llm import docs as D

PY = '''import os

# about f
def f(a):
    """Loads rows from disk lazily."""
    return a


class A:
    def g(
        self,
        b,
    ) -> int:
        # a comment first
        \'\'\'Keeps the
        order of entries.\'\'\'
        def inner():
            pass
        return 1

    def h(self): return "no doc"


def last():
    x = """not the opener"""
'''
GO = "package m\n\n// A reads\n// two lines of text.\nfunc A() { b() }\n\n// apart\n\nfunc (s *T) B(x int) error {\n\tif x > 0 {\n\t\treturn nil\n\t}\n\treturn nil\n}\n"
JS = "/**\n * Splits the text quickly.\n * @param {string} t\n */\nexport function f(t) {\n  return t.split(\"}\");\n}\n\nclass K {\n  // Never fails here, really.\n  m(a) {\n    if (a) { return 1; }\n  }\n}\nconst g = (x) => {\n  return x;\n};\n"
LUA = "--- Adds both numbers carefully.\nlocal function add(a, b)\n  if a then\n    return b\n  end\n  return a + b\nend\n\nfunction M.run(x) end\n"


def spans(spark, files):
    df = spark.createDataFrame([(p, t.encode(), 1) for p, t in files], "path string, content binary, doc int")
    return {(r.file_path, r.name): (r.first, r.last, r.doc) for r in D.function_spans(df).collect()}


def test_spans_and_comments(spark):
    got = spans(spark, [("a.py", PY), ("a.py", PY), ("b.go", GO), ("c.js", JS), ("d.lua", LUA), ("e.rb", ""), ("f.txt", "def f(): pass")])
    assert got["a.py", "f"] == (3, 5, "Loads rows from disk lazily.")
    assert got["a.py", "g"][0] == 9 and got["a.py", "g"][1] == 18 and " ".join(got["a.py", "g"][2].split()) == "Keeps the order of entries."
    assert got["a.py", "h"][2] is None and got["a.py", "last"][2] is None
    assert got["b.go", "A"] == (4, 4, "A reads\ntwo lines of text.")
    assert got["b.go", "B"] == (8, 13, None)
    assert got["c.js", "f"][:2] == (4, 6) and "Splits the text quickly." in got["c.js", "f"][2]
    assert got["c.js", "m"] == (10, 12, "Never fails here, really.") and got["c.js", "g"] == (14, 16, None)
    assert got["d.lua", "add"] == (1, 6, "Adds both numbers carefully.") and got["d.lua", "run" if ("d.lua", "run") in got else "M.run"][:2] == (8, 8)


TRIVIAL = [
    (None, "f", [], ""), ("", "f", [], ""), ("TODO: document", "f", [], ""), ("{@inheritDoc}", "f", [], ""), ("pylint: disable=C0116", "f", [], ""), ("eslint-disable-next-line", "f", [], ""),
    ("Loads the chunk edge.", "loadChunkEdge", [], ""), ("Trim the frame.\n\n@param offset the offset\n@return the result", "trim_frame", ["offset"], ""), (":param buffer: the buffer", "f", ["buffer"], ""),
    ("@param filter\n@param queue\n@return", "g", [], "g(filter, queue) {"), ("See above.", "f", [], ""), ("=====", "f", [], ""), ("类型", "f", [], ""), ("@param {string} self\n@returns", "f", [], ""), ("type: ignore", "f", [], ""),
    ("Store.read(path)", "Store.readPath", ["path"], ""),
]
USEFUL = [
    ("Safe to call twice.", "f", [], ""), ("Keeps input order.", "sort_rows", [], ""), ("下一层重新检查所有过期的条目", "f", [], ""), (":param graph: 每个查询直接丢弃每条重复的记录", "f", ["graph"], ""),
    ("Trim segment.\nAssumes UTC everywhere.", "trim_segment", [], ""), ("Рабочий процесс удаляет состояние сеанса", "f", [], ""), ("@param x how many rows to keep", "f", ["x"], ""),
]


@pytest.mark.parametrize("doc,name,params,signature", TRIVIAL)
def test_trivial(doc, name, params, signature):
    assert D.is_trivial(doc, name, params, signature)


@pytest.mark.parametrize("doc,name,params,signature", USEFUL)
def test_not_trivial(doc, name, params, signature):
    assert not D.is_trivial(doc, name, params, signature)


def test_pairs(spark):
    files = spark.createDataFrame([("a.py", PY.encode()), ("b.go", GO.encode()), ("b.go", GO.encode())], "path string, content binary")
    rows = [
        ("a.py", 0, "f", 4, "def f(a)", None, ["a"]), ("a.py", 1, "A.g", 10, "def g(self, b)", " \t", None), ("a.py", 1, "A.g", 10, "def g(self, b)", " \t", None), ("a.py", 2, "A.h", 20, None, None, []),
        ("b.go", 0, "A", 4, "func A()", "", []), ("b.go", 1, "T.B", 8, "func (s *T) B(x int) error", None, []), ("b.go", 2, "C", 99, "", "Holds many useful rows", None), ("gone.go", 0, "D", 3, "", None, None),
        ("gone.go", 1, None, None, None, "Some words that say something", None), ("b.go", 3, "E", 3, "", "TODO", None),
    ]
    fi = spark.createDataFrame([(*r, "x") for r in rows], "file_path string, ord int, name string, line int, signature string, docstring string, params array<string>, doc string")
    got = {(r.file_path, r.ord) for r in D.documented_functions(fi, files).collect()}
    assert got == {("a.py", 0), ("a.py", 1), ("b.go", 0), ("b.go", 2), ("gone.go", 1)}
    assert D.documented_functions(fi.limit(0), files).count() == 0
    assert {(r.file_path, r.ord) for r in D.documented_functions(fi, files.limit(0)).collect()} == {("b.go", 2), ("gone.go", 1)}


def test_heads_of_any_length_and_copies_of_a_file(spark):
    args = "".join(f"    argument_{i}: int,\n" for i in range(60))
    text = f"# Reads every block of the shard and merges them.\ndef wide(\n{args}) -> int:\n    '''Doc of the wide one.'''\n    return 1\n\n\ndef next_one(x):\n    return x\n"
    rows = [("/r/a.py", text)] * 50 + [("/r/a.py", text + "# a later delivery\n")]
    df = spark.createDataFrame([(p, t.encode(), 1) for p, t in rows], "path string, content binary, ln int").repartition(7)
    got = sorted((r.name, r.first, r.last, r.doc) for r in D.function_spans(df).collect())
    assert got == [("next_one", 67, 68, None), ("wide", 1, 64, "Doc of the wide one.")]
