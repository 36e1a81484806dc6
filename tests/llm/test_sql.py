from pathlib import Path

import pytest

from palimpsest.llm import queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
    assert got and got == sorted(want.fetchall(), key=str)
