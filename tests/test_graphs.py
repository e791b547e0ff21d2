"""Import and call graphs against brute force and the golden repository."""

import posixpath
import random

from tessel.operators import graphs as G

ANALYSES = "namespace string, project_id string, file_path string, language string, imports array<string>"


def resolve(imp, cur, files, lang):
    if lang == "javascript" and imp.startswith(("./", "../")):
        base = posixpath.normpath(posixpath.join(posixpath.dirname(cur), imp))
        return next((base + s for s in G.SCRIPT_SUFFIXES if base + s in files), None)
    if lang == "python":
        m = imp.replace(".", "/")
        return min((f for f in files if f.endswith(m + ".py") or f.endswith(m + "/__init__.py")), default=None)
    if lang == "go":
        return min((f for f in files if f.endswith(".go") and posixpath.basename(posixpath.dirname(f)) == imp.split("/")[-1]), default=None)
    return None


def test_imports_equal_brute_force(spark):
    rng = random.Random(1)
    names = ["util", "macutil", "os", "cos", "net", "a", "ba"]
    rows = []
    for p in ("p", "q"):
        for i in range(40):
            lang, ext = rng.choice([("python", ".py"), ("javascript", ".js"), ("javascript", ".ts"), ("go", ".go"), ("rust", ".rs")])
            folder = "/".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
            name = rng.choice([*names, "__init__", "index"])
            imports = [rng.choice([f"./{rng.choice(names)}", f"../{rng.choice(names)}", rng.choice(names), f"{rng.choice(names)}.{rng.choice(names)}", f"x.io/{rng.choice(names)}"]) for _ in range(4)]
            rows.append(("n", p, f"/{p}/{folder}/{name}{ext}", lang, imports if i % 9 else None))
    rows = list({r[2]: r for r in rows}.values())
    df = spark.createDataFrame(rows + rows[:3], ANALYSES)
    resolved = G.resolve_imports(G.import_rows(df), df)
    edges = {(r.src, r.dst) for r in G.import_edges(resolved).collect()}
    lost = sorted((r.src, r["import"]) for r in G.unresolved_imports(resolved).collect())
    want_edges, want_lost = set(), []
    for _, p, f, lang, imports in rows:
        files = {r[2] for r in rows if r[1] == p}
        for imp in imports or []:
            t = resolve(imp, f, files, lang)
            if t and t != f:
                want_edges.add((f, t))
            else:
                want_lost.append((f, imp))
    assert edges == want_edges and len(edges) > 20
    assert lost == sorted(want_lost)
    nodes = {r.node: (r.out, r["in"]) for r in G.adjacency(G.import_edges(resolved)).collect()}
    for a, b in edges:
        assert b in nodes[a][0] and a in nodes[b][1]
    strict = {(r.src, r.dst) for r in G.import_edges(G.resolve_imports(G.import_rows(df), df, strict=True)).collect()}
    assert not any(d.endswith("macutil.py") and s for s, d in strict - edges)


def test_calls(spark):
    fn = [("n", "p", "/r/a.py", 0, "A.run"), ("n", "p", "/r/a.py", 1, "main"), ("n", "p", "/r/util.py", 0, "helper")] + [("n", "p", f"/r/z{i}.py", 0, "many") for i in range(9)]
    functions = spark.createDataFrame(fn, "namespace string, project_id string, file_path string, ord int, name string")
    raw = [("A.run", "helper"), ("A.run", "fmt"), ("A.run", "run"), ("main", "run"), ("main", "A"), ("main", "many"), ("main", "main"), ("main", "many")]
    calls = spark.createDataFrame([("n", "p", "/r/a.py", a, b) for a, b in raw], "namespace string, project_id string, file_path string, name string, call string")
    resolved = G.resolve_calls(calls, functions)
    edges = {(r.src, r.dst) for r in G.call_edges(resolved).collect()}
    assert edges == {("/r/a.py::A.run", "/r/util.py::helper"), ("/r/a.py::main", "/r/a.py::A.run")} | {("/r/a.py::main", f"/r/z{i}.py::many") for i in range(5)}
    assert {(r.name, r.call) for r in G.external_calls(resolved).collect()} == {("A.run", "fmt"), ("main", "A")}
    assert G.resolve_calls(calls.limit(0), functions).count() == 0
