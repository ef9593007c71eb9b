"""Every registered query that has SQL gives the same rows in Spark and DuckDB, at the smallest size."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(v):
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    found = sorted(repr([cell(r[c]) for c in cols]) for r in df.collect())
    ran = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    assert found == sorted(repr([cell(r[names.index(c)]) for c in cols]) for r in ran.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bounds_reach_the_scan(spark):
    df = entry.queries()["kv_between"](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "LessThan(o_orderkey,200)" in plan
    assert "o_orderdate" not in plan
