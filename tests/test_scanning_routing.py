"""Which files are read, and in which language: the golden tables of the fixtures."""

from pyspark.sql import functions as F

from tessel.operators import routing, scanning
from tessel.sources.archives import HostedArchive, archive_url, read_archives, collapse_root, extract
from tessel.sources.tree import TreeReader, read_tree

KEPT = ["pkg/__init__.py", "_under.py", "Makefile", "empty.py", "exact.py"]
HIDDEN = [".zshrc", ".hid/b.py"]
DROPPED = ["node_modules/x/c.js", "tmp/x.py", ".git/config", "a.min.js", "x.PNG", "yarn.lock", "z.pb.go", "big.py"]
SIZES = {"exact.py": 524_288, "big.py": 524_289, "empty.py": 0}


def test_predicates(spark):
    rows = [(p, SIZES.get(p, 10), 1) for p in KEPT + HIDDEN + DROPPED] + [(None, 1, 1), ("a.py", None, 1)]
    df = spark.createDataFrame(rows, "rel_path string, length bigint, reason int")
    assert {r.rel_path for r in scanning.scannable(df).collect()} == set(KEPT)
    assert {r.rel_path for r in scanning.scannable(df, include_dotfiles=True).collect()} == set(KEPT + HIDDEN)
    assert scanning.scannable(df.limit(0)).count() == 0


def build(root):
    for p in KEPT + HIDDEN + DROPPED:
        path = root / p
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * SIZES.get(p, 10))


def test_tree_source(spark, tmp_path):
    root = tmp_path / "tmp"  # the root's own name is never tested
    build(root)
    df = read_tree(spark, str(root), partitions=3)
    rows = {r.rel_path: r for r in df.collect()}
    assert set(rows) == set(KEPT) and rows["empty.py"].content == b"" and rows["exact.py"].length == 524_288
    assert {r.rel_path for r in read_tree(spark, str(root), include_dotfiles=True).collect()} == set(KEPT + HIDDEN)
    assert df.rdd.getNumPartitions() <= 3
    # few partitions, so deep folders are listed by the executors; many, so the driver opens all of them
    for n in (1, 100):
        units = [u for p in TreeReader({"root": str(root), "partitions": n}).partitions() for u in p.units]
        assert (n == 1 or not any(deep for _, deep in units)) and len(units) == len(set(units))
        assert {r.rel_path for r in read_tree(spark, str(root), partitions=n).collect()} == set(KEPT)


class Shelf:
    """A remote archive that is a local file."""

    def __init__(self, archive):
        self.archive = archive

    def check(self, owner, repo):
        if owner != "o":
            raise ValueError("no access")

    def fetch(self, owner, repo, ref, target):
        import shutil

        shutil.copy(self.archive, target)


def test_archives_are_read_in_place(spark, tmp_path):
    import zipfile

    import pytest

    from tessel.plans.engine import Engine

    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        for name, text in {"r-1/a.py": "x = 1", "r-1/.hid/b.py": "y", "r-1/node_modules/c.js": "z", "r-1/d/e.min.js": "w", "r-1/d/f.go": ""}.items():
            z.writestr(name, text)
    got = {r.rel_path: bytes(r.content) for r in read_archives(spark, str(tmp_path / "g.zip")).collect()}
    assert got == {"a.py": b"x = 1", "d/f.go": b""}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.py", "x")
    with pytest.raises(Exception, match="unsafe path"):
        read_archives(spark, str(tmp_path / "b.zip")).collect()
    engine = Engine(spark, str(tmp_path / "home"))
    shelf = Shelf(tmp_path / "g.zip")
    assert engine.index_remote(shelf, "o", "r", str(tmp_path / "fetched.zip"), "n", "p") == 4
    with pytest.raises(ValueError):
        engine.index_remote(shelf, "else", "r", str(tmp_path / "x.zip"), "n", "p")


def test_hosted_archives(tmp_path):
    import pytest

    asked = []

    def get(url, headers):
        asked.append((url, headers.get("Authorization")))
        return (404, b"") if "/secret" in url else (500, b"") if "/broken" in url else (200, b"PK")

    host = HostedArchive("https://h/", "t", get)
    host.check("o", "r")
    host.fetch("o", "r", "v1", str(tmp_path / "a.zip"))
    assert (tmp_path / "a.zip").read_bytes() == b"PK" and asked == [("https://h/repos/o/r", "Bearer t"), ("https://h/repos/o/r/zipball/v1", "Bearer t")]
    with pytest.raises(PermissionError):
        host.check("o", "secret")
    with pytest.raises(OSError):
        host.fetch("o", "broken", None, str(tmp_path / "b.zip"))
    assert HostedArchive("https://h", None, get).headers == {}


def test_archives(tmp_path):
    import zipfile

    import pytest

    good, bad = tmp_path / "g.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("repo-1/a.py", "x = 1")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../extracted_evil/a.py", "x")
    root = extract(str(good), str(tmp_path))
    assert root.endswith("repo-1") and extract(str(good), str(tmp_path)) != root
    with pytest.raises(ValueError):
        extract(str(bad), str(tmp_path))
    (tmp_path / "two").mkdir()
    for d in "ab":
        (tmp_path / "two" / d).mkdir()
    assert collapse_root(str(tmp_path / "two")).endswith("two")
    assert archive_url("https://h/", "o", "r", "v1") == "https://h/repos/o/r/zipball/v1" and archive_url("https://h", "o", "r").endswith("zipball")


def test_languages(spark):
    rows = [
        ("X.PY", "", "python"), ("x.tsx", "", "javascript"), ("lib.hpp", "", "cpp"), ("Gemfile", "", "ruby"), (".zshrc", "", "shell"), ("Makefile", "", "config"),
        ("prod.env", "", "config"), ("config", "", "config"), (".env", "", None), ("notes.txt", "", None), ("run", "#!/usr/bin/env python3", "python"),
        ("run", "#!/bin/bash -e", None), ("run", "#!/usr/bin/lua5.4", "lua"), ("run", "#! /usr/bin/ZSH ", "shell"), ("run", "", None), ("run", None, None), ("run.txt", "#!/bin/sh", None),
    ]
    df = spark.createDataFrame([(i, f"/r/{p}", f) for i, (p, f, _) in enumerate(rows)], "i int, path string, first string")
    got = [r[0] for r in df.orderBy("i").select(routing.language(F.col("path"), F.col("first"))).collect()]
    assert got == [w for _, _, w in rows]


def test_routed_files(spark):
    df = spark.createDataFrame([("/r/a.py", b"x"), ("/r/b.txt", b"x"), ("/r/run", b"#!/bin/sh\necho \xff"), ("/r/c.go", None)], "path string, content binary")
    assert {(r.path, r.language) for r in routing.routed(df).select("path", "language").collect()} == {("/r/a.py", "python"), ("/r/run", "shell"), ("/r/c.go", "go")}


def test_dialects(spark):
    pairs = [("a.YML", "yaml"), ("a.toml", "toml"), ("a.json", "json"), ("a.cfg", "ini"), ("Makefile", "ini"), ("prod.env", "env"), ("config", "config"), ("a.jsonc", "jsonc")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pairs)], "i int, path string")
    assert [r[0] for r in df.orderBy("i").select(routing.config_dialect(F.col("path"))).collect()] == [d for _, d in pairs]


def test_webhook():
    from tessel.sources.webhook import notice, notify

    sent = []
    job = {"job_id": "1", "webhook_url": "https://h/x"}
    assert notify(job, lambda *a: sent.append(a), "s") and sent[0][0] == "https://h/x" and sent[0][2]["X-Signature"].startswith("sha256=")
    assert not notify({"job_id": "1"}, lambda *a: sent.append(a)) and "X-Signature" not in notice(job)[1]

    def fails(*_):
        raise OSError

    assert not notify(job, fails)
