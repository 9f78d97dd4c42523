"""Every query against its SQL on the smallest test tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def test_each_query_has_sql():
    assert set(entry._review_queries()) == set(entry._review_sql())


@pytest.mark.parametrize("name", list(entry._review_queries()))
def test_query_equals_sql(spark, base, name):
    df = entry.queries()[name](spark, str(FOLDER))
    result = base.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert got and got == sorted(result.fetchall(), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("CartesianProduct", "NestedLoop", "Python") if word in plan]


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 150
