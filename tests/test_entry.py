from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "question", "answer", "status", "n_hits"]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.catalog.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    canon = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert canon(want) == canon(got)
