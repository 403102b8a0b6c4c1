"""Every registered query of the engine's own operators gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from folioscope import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    rows = sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    assert rows
    if name in plans.ORACLE_SQL:
        want = duck.sql(plans.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        at = [want.columns.index(c) for c in sorted(want.columns)]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "rank", "id", "collection", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_before_there_is_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 40)"], cwd=root, capture_output=True, text=True)
    assert out.stdout.strip() == "True", out.stderr
