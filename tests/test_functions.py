
import pytest
from pyspark.sql import functions as F

from skyloom.functions import aqi, domain, geo, text
from skyloom.sources import feeds, store


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(("value", "want"), [(31.0, 51), (45.0, 75), (60.0, 100), (30.5, 51), (250.0, 400), (380.0, 500), (900.0, 500), (None, None), (-5.0, None)])
def test_sub_index(spark, value, want):
    assert one(spark, aqi.sub_index("pm25", F.lit(value).cast("double"))) == want


def test_full_index(spark):
    got = one(spark, aqi.full_index({"pm25": F.lit(250.0), "pm10": F.lit(100.0), "no2": F.lit(50.0)}))
    assert tuple(got) == (400, "pm25", "Very Poor")
    assert one(spark, aqi.full_index({"pm25": F.lit(250.0), "pm10": F.lit(100.0)})) is None
    assert one(spark, aqi.full_index({"so2": F.lit(25.0), "o3": F.lit(10.0), "no2": F.lit(50.0)})) is None


def test_grid_and_bearings(spark):
    assert one(spark, geo.cell_id("delhi", F.lit(28.6139), F.lit(77.2090), 28.40, 76.84)) == "delhi_21_36"
    assert abs(one(spark, geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 90) < 1e-9
    assert one(spark, geo.angle_between(F.lit(350.0), F.lit(10.0))) == 20
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))))
    assert [one(spark, geo.inside_ring(F.lit(x), F.lit(y), ring)) for x, y in ((0.5, 0.5), (5.0, 5.0), (0.0, 0.5), (1.0, 0.5), (0.5, 1.0))] == [True, False, False, False, False]


def test_shares_add_up(spark):
    s = one(spark, domain.source_shares(F.lit(0.4), F.lit(0.7), F.lit(2.0), F.lit(50.0), F.lit(0.2), F.lit(None).cast("double")))
    assert abs(sum(s) - 1) < 1e-9 and max(s) == s.industry
    assert abs(one(spark, domain.hazard_ratio(F.lit(2.0))) - 1) < 1e-12


def test_strings(spark):
    assert one(spark, text.sanitize(F.lit(" a<b> &amp; é\x01 c "))) == "a b é c"
    assert one(spark, text.violations(F.lit("JavaScript:x <b> sk-" + "a" * 20))) == ["angle", "scheme", "token"]
    assert one(spark, text.strip_query(F.lit("https://x/y?z#q"))) == "https://x/y"
    doc = F.lit('{"w": [{"id": "a", "v": 1}, {"id": "b c", "v": {"x": 2.5}}, {"id": 7, "v": true}]}')
    assert [one(spark, text.resolve_path(doc, p)) for p in ("d.w[0].v", "d.w[id=b c].v.x", "d.w[id=7].v", "d.w[id=b c].v", "d.w[9].v", "d.q")] == ["1", "2.5", "true", None, None, None]
    assert one(spark, text.values_match(F.lit("100"), F.lit("101.9"))) and not one(spark, text.values_match(F.lit("100"), F.lit("103")))


def test_store(spark):
    df = spark.createDataFrame([("s", 210.0), ("s", float("nan"))], "station_id string, pm25 double")
    out = store.finalized(df)
    assert store.problems(out) == [] and store.problems(df)
    rows = out.collect()
    assert rows[0].fire_count_upwind == 0 and rows[1].pm25 is None and rows[0].aod550 is None


def test_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text("latitude,longitude,frp,acq_date,acq_time\n28.1,77.2,5.5,2024-01-01,5\n,77,1,2024-01-01,100\n28.1,77.2,5.5,2024-01-01,5\n")
    got = feeds.fires(spark, str(tmp_path / "f.csv")).collect()
    assert len(got) == 1 and got[0].acq_utc.minute == 5
    (tmp_path / "n.csv").write_text("No fire alerts\n")
    assert feeds.fires(spark, str(tmp_path / "n.csv")).count() == 0
    day = tmp_path / "a" / "locationid=7" / "year=2024" / "month=1"
    day.mkdir(parents=True)
    (day / "x.csv").write_text("location_id,sensors_id,location,datetime,lat,lon,parameter,units,value\n7,1,n,2024-01-01T03:45:00+05:30,28,77,pm25,u,10\n7,1,n,2024-01-01T03:50:00+05:30,28,77,pm25,u,30\n7,1,n,2024-01-01T03:50:00+05:30,28,77,no2,u,-1\n7,1,n,2024-01-01T03:50:00+05:30,28,77,bc,u,1\n")
    got = feeds.archive(spark, str(tmp_path / "a")).collect()
    assert [(r.station_id, r.ts_utc.hour, r.pm25, r.no2, r.co) for r in got] == [("7", 22, 20.0, None, None)]
    (tmp_path / "m.json").write_text('{"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wind_speed_10m": [1.5, null]}}')
    got = sorted(feeds.meteo(spark, str(tmp_path / "m.json")).collect(), key=lambda r: r.ts_utc)
    assert [r.wind_speed_10m for r in got] == [1.5, None] and got[0].blh_m is None
    (tmp_path / "w.json").write_text('{"type": "FeatureCollection", "features": [{"properties": {"n": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]]]}}, {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[5, 5], [6, 5], [5, 5]]]}}]}')
    assert [r.rings[0][0].x for r in feeds.ward_polygons(spark, str(tmp_path / "w.json")).collect()] == [0.0, 5.0]
    assert feeds.months((2023, 11), (2024, 2)) == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]


def test_snapshot_by_nearest_station(spark):
    rows = [("28.6001", "77.2", "PM2.5", "50", "2024-01-01 10:00:00"), ("28.6001", "77.2", "PM2.5", "70", "01-01-2024 10:00:00"), ("28.6001", "77.2", "NO2", "NA", "2024-01-01T10:00:00"), ("28.9", "77.2", "PM10", "9", "2024-01-01 10:00:00"), ("28.65", "77.2", "PM10", "9", "2024-01-01 10:00:00"), ("x", None, "PM10", "9", "")]
    records = spark.createDataFrame(rows, "latitude string, longitude string, pollutant_id string, avg_value string, last_update string")
    stations = spark.createDataFrame([("a", 28.6, 77.2), ("b", 28.606, 77.2)], "station_id string, lat double, lon double")
    got = feeds.matched_snapshot(records, stations, (77.0, 28.5, 77.5, 28.7)).collect()
    assert [(r.station_id, r.ts_utc.hour, r.ts_utc.minute, r.pm25, r.no2, r.pm10) for r in got] == [("a", 4, 30, 60.0, None, None)]
