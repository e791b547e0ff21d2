"""Every query against its SQL, over the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(repr([r[c] for c in order]) for r in df.collect())
    theirs = sorted(repr([r[columns.index(c)] for c in order]) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", ["import_edges", "import_nodes", "call_edges", "function_table", "json_entries", "enriched_functions"])
def test_graphs_have_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
