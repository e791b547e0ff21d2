"""Golden repositories through symbols, chunks, graphs and the whole engine."""

import numpy as np
import pytest

from tessel.operators import embedding, metadata, symbols
from tessel.plans.engine import Engine, packages

UTIL = "def helper(x):\n    return x\n"
A = 'import os\nfrom util import helper\n\nclass A:\n    """Doc."""\n    def run(self, x: int) -> str:\n        helper(x)\n        return self.fmt(x)\n\ndef main():\n    A().run(1)\n'
GO = 'package m\n\nimport (\n    "fmt"\n    "x/y"\n)\n\n// Doc one\nfunc A() { fmt.Println(1) }\nfunc B(r int) int {\n    return A2(r)\n}\n'
JS = "class K {\n  m() { return n(); }\n  z() {\n    return 1;\n  }\n}\n"
SH = "#!/bin/bash\n# Say hi\ngreet() {\n  echo hi\n}\nalias ll='ls -l'\nsource ./lib.sh\nexport FOO=1\n"
ENV = "# db\nHOST=localhost\n\n[sec]\nKEY: 'v'\n*.log\n"


def rows(text, lang, dialect=None, kind="function"):
    return [r for r in symbols.file_symbols("x", lang, text, dialect) if r[0] == kind]


def test_python_symbols():
    f = rows(A, "python")
    assert [(r[2], r[3], r[4], r[6], r[7]) for r in f] == [("A.run", 6, "def run(self, x: int) -> str", ["self", "x"], "str"), ("main", 10, "def main()", [], None)]
    assert f[0][9] == ["fmt", "helper"] and f[1][9] == ["A", "run"]
    assert [(r[2], r[3], r[5], r[8]) for r in rows(A, "python", kind="type")] == [("A", 4, "Doc.", "class")]
    assert [r[2] for r in rows(A, "python", kind="import")] == ["os", "util"]
    assert symbols.python_symbols("def f(:\n") == [] and symbols.python_symbols("") == []


def test_lexical_symbols():
    assert [(r[2], r[3], r[4], r[5], r[9]) for r in rows(GO, "go")] == [("A", 8, "func A()", "Doc one", ["Println"]), ("B", 9, "func B(r int) int", "", ["A2"])]
    assert [r[2] for r in rows(GO, "go", kind="import")] == ["fmt", "x/y"]
    assert [(r[2], r[3]) for r in rows(JS, "javascript")] == [("m", 1), ("z", 2)] and rows(JS, "javascript", kind="type")[0][2] == "K"
    rust = "use a::b;\npub struct S;\nimpl S {\n    /// Reads.\n    pub fn get(&self, n: u8) -> u8 {\n        take(n)\n    }\n}\nfn free() {}\n"
    assert [(r[2], r[3], r[5]) for r in rows(rust, "rust")] == [("S.get", 4, "Reads."), ("free", 8, "")]
    java = "package p;\nimport a.B;\npublic class C {\n    /** Doc. */\n    public int f(String s) {\n        return g(s);\n    }\n}\n"
    assert [(r[2], r[3], r[6]) for r in rows(java, "java")] == [("f", 4, ["s"])] and rows(java, "java", kind="import")[0][2] == "import a.B;"
    assert [r[2] for r in rows("require 'x'\nclass A\n  def f(a)\n  end\nend\n", "ruby")] == ["f"]
    assert [r[2] for r in rows('local a = require("b")\nlocal function f(x)\nend\n', "lua")] == ["f"]
    assert [r[2] for r in rows("#include <a.h>\nstatic int f(int a, char *b) {\n  return 0;\n}\n", "c")] == ["f"]


def test_config_symbols():
    text = '{"name": "x", "scripts": {"a": "b"}, "files": ["y"]}'
    assert [(r[2], r[4]) for r in rows(text, "config", "json")] == [("name", '"name": "x"'), ("scripts.a", '"a": "b"')]
    assert [(r[2], r[8]) for r in rows(text, "config", "json", "type")] == [("scripts", "json_object"), ("files", "json_array")]
    assert symbols.config_symbols("[1]", "json") == [] and symbols.config_symbols("{", "json") is None
    assert [(r[2], r[3]) for r in rows("a = 1\n[t]\nb = 'c'\n", "config", "toml")] == [("a", 0), ("t.b", 2)]
    assert [r[4] for r in rows("[s]\nK = v\n", "config", "ini")] == ["k = v"]
    pytest.importorskip("yaml")
    assert [(r[2], r[3]) for r in rows("a: 1\nb:\n  c: d\ne:\n  - f\n", "config", "yaml")] == [("a", 0), ("b.c", 2)]


def test_packages(spark):
    files = spark.createDataFrame([("/r/top/__init__.py",), ("/r/top/in/__init__.py",), ("/r/top/in/m.py",), ("/r/x.py",), ("/r/top/gap/y.py",), ("/r/top/z.go",)], "path string")
    got = {r.file_path: r.package for r in packages(files).collect()}
    assert got["/r/top/in/m.py"] == "top.in.m" and got["/r/x.py"] == "x" and got["/r/top/gap/y.py"] == "y" and got["/r/top/z.go"] == "z"


def test_whole_engine(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    for name, text in {"util.py": UTIL, "a.py": A, "m.go": GO, "k.js": JS, "s.sh": SH, "prod.env": ENV, "empty.py": "", "bad.py": "def f(:\n", "notes.txt": "x"}.items():
        (repo / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "home"))
    total = engine.index(str(repo))
    table = engine.vectors.read("repo", "repo").toPandas()
    assert total == len(table) and table.chunk_id.is_unique
    of = lambda name: table[table.file_path.str.endswith("/" + name)]
    assert sorted(of("a.py").chunk_type) == ["class", "file_summary", "function", "function", "imports"]
    one = of("a.py").set_index("symbol_name")
    assert of("a.py")[of("a.py").chunk_type == "imports"].content.iloc[0] == "import os\nfrom util import helper"
    path = f"{repo}/a.py"
    assert one.loc["a.py"].content == f"File: {path}\nPackage: a\nFunctions: A.run, main\nTypes: A\nImports: os, util"
    assert one.loc["A.run"].content == "\n".join(A.split("\n")[:8]) + "\n" and one.loc["main"].content == A
    import json

    run, main = (json.loads(one.loc[n].metadata) for n in ("A.run", "main"))
    assert run["calls"] == ["helper"] and run["external_calls"] == ["fmt"] and run["called_by"] == ["main"]
    # the Go function A answers to the call of the Python class A: names are looked up across languages
    assert main["calls"] == ["A.run", "A"] and main["external_calls"] == [] and run["depends_on"] == [f"{repo}/util.py"]
    assert json.loads(of("util.py").metadata.iloc[0])["imported_by"] == [path]
    assert sorted(of("empty.py").chunk_type) == ["file", "file_summary"] and of("empty.py")[of("empty.py").chunk_type == "file"].content.iloc[0].endswith("# [Empty file]")
    assert sorted(of("bad.py").chunk_type) == ["file", "file_summary"]
    assert set(of("s.sh").symbol_name.dropna()) == {"greet", "alias:ll", "s.sh"} and set(of("prod.env").symbol_name) == {"HOST", "sec.KEY", "*.log", "sec", "prod.env"}
    go = of("m.go").set_index("symbol_name")
    assert go.loc["A"].content == "\n".join(GO.split("\n")[:9]) + "\n" and go.loc["B"].content == go.loc["A"].content
    assert not len(of("notes.txt"))

    hits = engine.search_text("repo", "repo", "helper return x", 3).orderBy("rank").collect()
    assert [r["rank"] for r in hits] == [1, 2, 3] and hits[0].symbol_name == "helper"
    info = engine.info("repo", "repo")
    assert info["total_vectors"] == total and info["index_meta"]["embedding_dim"] == 64
    edges = spark.read.parquet(f"{engine.home}/import_edges").collect()
    assert [(r.src, r.dst, r.project_id) for r in edges] == [(path, f"{repo}/util.py", "repo")]
    (repo / "a.py").unlink()
    assert engine.index(str(repo)) == total - 5

    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("top/x.py", "def only(a):\n    return a\n")
    assert engine.index_archive(str(tmp_path / "z.zip"), "z", "z") == 2 and engine.vectors.count("repo", "repo") == total - 5
    (tmp_path / "bare").mkdir()
    assert engine.index(str(tmp_path / "bare"), "repo", "repo") == 0 and engine.vectors.count("repo", "repo") == 0
    left = spark.read.schema("src string, dst string, namespace string, project_id string").parquet(f"{engine.home}/import_edges")
    assert left.where("project_id = 'repo'").count() == 0
    engine.delete("repo", "repo")
    assert engine.info("repo", "repo") == {"total_vectors": 0, "index_meta": {}}
    for bad in (lambda: engine.search_text("a", "b", ""), lambda: engine.embed(""), lambda: engine.search_vector("a", "b", [1.0]), lambda: engine.index("/nowhere")):
        with pytest.raises(ValueError):
            bad()


class Broken:
    dim = 3

    def encode(self, texts):
        return np.zeros((len(texts), 2))


def test_embedders(spark):
    hashing = embedding.HashingEmbedder(16)
    rows = spark.createDataFrame([(1, "a b b"), (2, None), (3, "")], "i int, content string")
    got = {r.i: r.embedding for r in embedding.embed(rows, hashing).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and sum(got[2]) == 0 == sum(got[3])
    assert np.allclose(got[1], hashing.encode(["a b b"])[0], atol=1e-6)
    with pytest.raises(Exception, match="embedder gave"):
        embedding.embed(rows, Broken()).collect()
    assert embedding.choose_embedder(99_999, "l", "r") == "l" and embedding.choose_embedder(100_000, "l", "r") == "r"
    assert embedding.reordered([{"index": 1, "embedding": "b"}, {"index": 0, "embedding": "a"}]) == ["a", "b"]
    states, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert np.allclose(embedding.masked_mean(states, mask), [[2, 3, 4, 5]])


def test_metadata(spark):
    df = spark.createDataFrame([(1, '{"language": "go", "n": 3}'), (2, '{"language": "g'), (3, None), (4, "[]")], "i int, m string")
    got = [r[0] for r in df.orderBy("i").select(metadata.field(df.m, "language")).collect()]
    assert got == ["go", None, None, None]
    rich = spark.createDataFrame([(["a"], None, 3), (None, "x", None)], "calls array<string>, name string, n int")
    flat = metadata.flat(rich)
    assert [tuple(r) for r in flat.collect()] == [('["a"]', "", "3"), ("[]", "x", "")]
    assert [r.calls for r in metadata.restored(flat).collect()] == [["a"], []]
    assert [r.calls for r in metadata.restored(spark.createDataFrame([("[bad",)], "calls string")).collect()] == [[]]


def test_source_queries_use_the_line_readers(spark, tmp_path):
    from tessel import queries

    files = {"/r/a.sh": SH, "/r/b.env": ENV, "/r/c.json": "{\nbroken: yes\n", "/r/top/__init__.py": "", "/r/top/m.py": UTIL}
    # the same file delivered twice counts once
    rows = [(p, bytearray(t.encode())) for p, t in [*files.items(), ("/r/a.sh", SH)]]
    spark.createDataFrame(rows, "path string, content binary").write.parquet(f"{tmp_path}/source_files.parquet")
    got = sorted((r.file_path, r.kind, r.ord, r.name, r.line) for r in queries.source_symbols(spark, str(tmp_path)).collect())
    assert got == [
        ("/r/a.sh", "function", 0, "greet", 2), ("/r/a.sh", "function", 1, "alias:ll", 5), ("/r/a.sh", "import", 0, "./lib.sh", 6),
        ("/r/b.env", "function", 0, "HOST", 1), ("/r/b.env", "function", 1, "sec.KEY", 4), ("/r/b.env", "function", 2, "*.log", 5), ("/r/b.env", "type", 0, "sec", 3),
        ("/r/c.json", "function", 0, "{", 0), ("/r/c.json", "function", 1, "broken", 1), ("/r/top/m.py", "function", 0, "helper", 1),
    ]
    mine = {(r.file_path, r.chunk_type, r.symbol_name, r.chunk_id, r.content) for r in queries.source_chunks(spark, str(tmp_path)).collect()}
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")
    whole = Engine(spark, f"{tmp_path}/home").analyse(df)[0].selectExpr("file_path", "chunk_type", "symbol_name", "chunk_id", "md5(content) AS content")
    assert mine == {tuple(r) for r in whole.collect()}
    assert {c for p, c, *_ in mine if p == "/r/a.sh"} == {"function", "imports", "file_summary"}
