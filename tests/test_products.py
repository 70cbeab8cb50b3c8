"""Models on the test tables: bounds that hold whatever the data, and errors held against what a baseline makes of the same rows."""

import json

import numpy as np
import pytest

from skyloom.plans import learned
from skyloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_present_level(spark):
    got = np.array([(r.pm25, r.p50, r.p90) for r in rows(spark, "M2_quantiles")])
    assert len(got) > 1000 and (got[:, 1] >= 0).all() and (got[:, 2] >= got[:, 1]).all()
    assert 0.42 < (got[:, 0] <= got[:, 1]).mean() < 0.58 and 0.84 < (got[:, 0] <= got[:, 2]).mean() < 0.96


def test_left_out_stations(spark):
    got = rows(spark, "M4_leave_one_out")
    assert {r.station for r in got} == set(range(12)) and all(r.p50 is not None and r.p50 >= 0 for r in got)
    curve = rows(spark, "M4_distance_curve")
    assert sum(r.n for r in curve) == sum(r.idw is not None for r in got)
    rmse = lambda c: np.sqrt(np.mean([(r.pm25 - r[c]) ** 2 for r in got if r.idw is not None]))
    assert rmse("p50") < 1.6 * rmse("idw") and abs(np.sqrt(sum(r.model_rmse**2 * r.n for r in curve) / sum(r.n for r in curve)) - rmse("p50")) < 0.05


def test_forecast(spark):
    got = np.array([(r.y, r.p50, r.p90) for r in rows(spark, "M5_forecast_model")])
    assert len(got) > 100 and (got[:, 2] >= got[:, 1]).all() and (got[:, 0] <= got[:, 2]).mean() > 0.75
    tested = {r.horizon: r for r in rows(spark, "M6_backtest")}
    assert [tested[h].embargo_h for h in (24, 48, 72)] == [192, 216, 240]
    for r in tested.values():
        assert r.rmse == 0 or (r.seasonal_naive_rmse != r.persistence_rmse and abs(r.skill_pct - 100 * (1 - r.rmse / r.persistence_rmse)) < 0.1)


def test_too_little_to_learn_from(spark):
    got = QUERIES["M6_backtest"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.horizon, r.rmse, r.skill_pct, r.embargo_h) for r in got} == {(24, 0.0, 0.0, 192), (48, 0.0, 0.0, 216), (72, 0.0, 0.0, 240)}


def test_normalised(spark):
    got = rows(spark, "M9_normalised")
    raw, normal = (np.array([r[c] for r in got], float) for c in ("pm25", "normal"))
    assert (normal >= 0).all() and abs(normal.mean() / raw.mean() - 1) < 0.4 and normal.std() < raw.std()
    assert {r.station for r in rows(spark, "M10_station_normalised")} == set(range(12))
    assert len(rows(spark, "M10_city_daily")) >= 30


def test_ablation(spark):
    (r,) = rows(spark, "M15_model_ablation")
    assert abs(r.delta_pct - 100 * (r.without_rmse - r.with_rmse) / r.without_rmse) < 0.05


@pytest.mark.parametrize("name", ["B4_cells", "B4_ward_rollup"])
def test_cells(spark, name):
    got = rows(spark, name)
    assert len(got) == (100 if name == "B4_cells" else len({r.ward_id for r in got})) and got
    assert all(0 <= r.pm25_p50 <= r.pm25_p90 and r.category and r.confidence in ("low", "med", "high") for r in got)


def test_receipts(spark):
    got = {r.path.split("receipts.")[1]: r.value for r in rows(spark, "B10_receipts_document")}
    assert len(got) == 5 and all(v is not None for v in got.values())
    assert got["lineage[source=events].rows"] == "10000" and got["methodology.aqi_breakpoints[0].index_hi"] == "50"
    assert got["cities.delhi.attribution_directional_checks[check_name=north].observed"].endswith("of 12 stations") and float(got["cities.delhi.metrics.nowcast_cv.overall.model_rmse"]) > 0


def test_ward_forecast(spark):
    got = rows(spark, "B5_ward_forecast")
    by = {}
    for r in got:
        by.setdefault(r.ward_id, []).append(r)
        assert 0 <= r.pm25_p50 <= r.pm25_p90 and r.category
    assert len(by) == 25 and all(sorted((r.h, r.confidence) for r in of) == [(24, "high"), (48, "med"), (72, "low")] for of in by.values())


def test_replay(spark):
    first, end = learned.REPLAYED
    seen = learned.unseen(spark, SF, first, end)
    assert 0 < seen.count() < QUERIES["A1_hourly"](spark, SF).count()
    # Neither an origin nor an aim nor what is known at an origin lies in the replayed time.
    learned_from = learned.supervised(spark, SF, 24, seen).select("h", "target_h", *(f"lag{k}" for k in (0, *learned.LAGS))).toPandas()
    inside = lambda h: (h >= first) & (h < end)
    assert len(learned_from) and not (inside(learned_from.h) | inside(learned_from.target_h)).any()
    assert all(learned_from[f"lag{k}"][inside(learned_from.h - k)].isna().all() for k in learned.LAGS)
    ahead, told = QUERIES["B12_replay_forecast"](spark, SF), QUERIES["M16_replay_cells"](spark, SF)
    index = json.loads(learned.replay_index(told, ahead).first()["document"])
    assert [x["date"] for x in index["dates"]] == ["2024-01-13", "2024-01-14", "2024-01-15", "2024-01-16", "2024-01-17"] and index["window"] == {"start": "2024-01-13", "end": "2024-01-17"}
    assert {(x["cells"], x["wards"]) for x in index["dates"]} == {(100, 25)}
    got = ahead.where("actual is not null").toPandas()
    assert (got.pm25_p90 >= got.pm25_p50).all() and set(got.h) == {24, 48, 72} and (got.actual <= got.pm25_p90).mean() > 0.6


def test_audit_of_every_brief(spark):
    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    got = {r.brief_id: r.ok for r in rows(spark, "X12_audit")}
    assert set(got) == suppliers and {k % 10 for k in got if got[k]} > {9}
