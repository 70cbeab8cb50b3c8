import os

import duckdb
import pytest

from skyloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    out = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(out.fetchall(), key=str)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    assert len(got) == len(want) and [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []
