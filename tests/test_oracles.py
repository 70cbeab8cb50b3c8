import math
import os

import duckdb
import pytest
from pyspark.sql import DataFrameReader

from skyloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
#: Queries that train models, round by round, and so run jobs while they are planned; ``test_products`` holds them. All others are one lazy plan.
EAGER = {"M2_quantiles", "M4_leave_one_out", "M4_distance_curve", "M5_forecast_model", "M6_backtest", "M9_normalised", "M10_city_daily", "M10_station_normalised", "M15_model_ablation", "K13_metrics", "B10_receipts_document", "B4_cells", "B4_ward_rollup", "B5_ward_forecast", "B12_replay_forecast", "M16_replay_cells"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_query(spark, duck, name, monkeypatch):
    reads, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda *a, **b: reads.append(a) or parquet(*a, **b))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    df = QUERIES[name](spark, SF)
    assert jobs() - before <= len(reads)  # reading a table's schema is a job
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        out = duck.execute(ORACLES[name])
        columns = [c[0] for c in out.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows(columns, out.fetchall())
        assert len(got) == len(want)
        assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []
