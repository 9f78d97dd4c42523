"""The registered queries on the smallest test tables, against SQL where there is some."""

from pathlib import Path

import corpus_pipeline
import pytest

from plaudit.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")

ROWS_OF = {
    "op1_minhash_dedup": "documents", "op2_minimax_sharding": "documents", "op4_viterbi_counts": "documents",
    "op5_weak_toxicity": "documents", "op6_cover_tree": "embeddings", "op7_template_removal": "pages", "op8_pareto_mixing": "documents",
    "op11_pointer_alignment": "documents", "op12_difference_cover": "documents", "op13_merkle_manifest": "documents",
}


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, base, name):
    df = QUERIES[name](spark, str(FOLDER))
    rows = df.collect()
    assert rows and not [w for w in ("CartesianProduct", "NestedLoop") if w in df._jdf.queryExecution().executedPlan().toString()]
    if name in ROWS_OF:
        assert len(rows) == base.execute(f"select count(*) from {ROWS_OF[name]}").fetchall()[0][0]
    if name in ORACLE_SQL:
        result = base.execute(ORACLE_SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted(result.fetchall(), key=repr)


def test_entry_has_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
