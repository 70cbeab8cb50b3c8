import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.functions import display, geo, shapes, text
from skyloom.operators import contract, gate, models
from skyloom.operators import relational as rel
from skyloom.plans import details, documents, publish
from skyloom.sources import feeds, store


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def ring(*points):
    return F.array(*(shapes.point(float(x), float(y)) for x, y in points))


def test_shapes_by_hand(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    assert one(spark, shapes.area(square)) == 4 and tuple(one(spark, shapes.vertex_mean(square))) == (0.8, 0.8)
    assert tuple(one(spark, shapes.representative(square))) == (1.0, 1.0)
    notch = ring((0, 0), (4, 0), (4, 4), (2, 0.5), (0, 4), (0, 0))
    inside = one(spark, shapes.representative(notch))
    assert one(spark, geo.inside_ring(F.lit(inside.x), F.lit(inside.y), notch))
    around = ring((-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5))
    assert abs(one(spark, shapes.area_in_circle(around, 1.0)) - math.pi) < 1e-12
    assert abs(one(spark, shapes.area_in_circle(ring((0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1), (0, 0)), 1.0)) - 0.01) < 1e-12
    assert abs(one(spark, shapes.area_in_circle(ring((0, -9), (9, -9), (9, 9), (0, 9), (0, -9)), 2.0)) - 2 * math.pi) < 1e-9
    assert abs(one(spark, shapes.length_in_circle(ring((-9, 0), (9, 0), (9, 5)), 2.0)) - 4) < 1e-12
    assert one(spark, shapes.distance_to_line(ring((3, -1), (3, 1)))) == 3 and one(spark, shapes.distance_to_line(ring((3, 4), (6, 8)))) == 5
    assert one(spark, F.size(shapes.simplified(ring((0, 0), (1, 0.001), (2, 0), (2, 2)), 0.01))) == 3
    assert one(spark, F.size(shapes.simplified(F.array().cast("array<struct<x:double,y:double>>"), 0.01))) == 0
    p = one(spark, shapes.utm(F.lit(28.6139), F.lit(77.2090), 43))
    assert abs(p.x - 715_999) < 800 and abs(p.y - 3_167_100) < 800  # New Delhi
    centre = one(spark, shapes.utm(F.lit(0.0), F.lit(75.0), 43))
    assert abs(centre.x - 500_000) < 1e-6 and abs(centre.y) < 1e-6


def test_display(spark):
    shown = [one(spark, display.number(F.lit(x).cast("double"), d)) for x, d in ((1234567.0, 0), (-12.50, 2), (999.0, 0), (100000.0, 0), (None, 0), (0.004, 2))]
    assert shown == ["12,34,567", "-12.5", "999", "1,00,000", "-", "0"]
    assert one(spark, display.signed(F.lit(3.14159))) == "+3.1" and one(spark, display.signed(F.lit(-2.0))) == "-2"
    assert [one(spark, display.data_age(F.lit(s))) for s in (-5, 20, 300, 7200, 200_000)] == ["scheduled", "just now", "5m ago", "2h ago", "2d ago"]
    assert one(spark, display.safe_href(F.lit("javascript:alert(1)"))) is None and one(spark, display.safe_href(F.lit("HTTPS://a.b/c"))) == "HTTPS://a.b/c"
    assert one(spark, display.diverging(F.lit(-9.0), F.lit(9.0))) == list(display.STOPS[0][1])


def test_paths(spark):
    doc = '{"w": [{"id": "a", "v": 1}, {"id": "b c", "v": {"x": 2.5}}, {"id": 7, "v": true}], "n": null, "t": "text"}'
    paths = ["d.w[0].v", "d.w[id=b c].v.x", "d.w[id=7].v", "d.w[id=7.0].v", "d.w[id=b c].v", "d.w[9].v", "d.q", "d.n", "d.t", "", "d.", "d[", "d.a[x]", "9d", "d" + ".a" * 17, "other.w[0].v"]
    refs = spark.createDataFrame([(i, p, "") for i, p in enumerate(paths)], "brief_id int, path string, value string")
    got = {r.path: r.truth for r in gate.resolved(spark.createDataFrame([("d", doc)], "root string, document string"), refs).collect()}
    assert got == {"d.w[0].v": "1", "d.w[id=b c].v.x": "2.5", "d.w[id=7].v": "true", "d.w[id=7.0].v": "true", "d.n": "None", "d.t": "text"}  # a JSON null is a scalar
    assert one(spark, text.with_nulls(F.lit("{}"), ["a", "b"])) == '{"a":null,"b":null}'


def test_trailing_join_keeps_equal_rows(spark):
    probe = spark.createDataFrame([("s", 100), ("s", 100), ("s", 500)], "k string, at long")
    build = spark.createDataFrame([("s", 95, 1), ("s", 40, 2), ("t", 99, 3)], "k string, then long, v int")
    rows = sorted(tuple(r) for r in rel.trailing_join(probe, build, ["k"], "at", "then", 50).select("at", F.coalesce("v", F.lit(0))).collect())
    assert rows == [(100, 1), (100, 1), (500, 0)]
    assert rel.trailing_join(probe, build, ["k"], "at", "then", 50, "inner").count() == 2


def test_nearest_by_cells_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)] + [(500 + i, 28 + rng.random(), 77 + rng.random()) for i in range(100)]
    places = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(40)] + [(900 + i, 28 + rng.random(), 77 + rng.random()) for i in range(60)]
    p, q = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "place long, lat double, lon double")
    want = {r.id: (r.place, round(r.km, 6)) for r in rel.nearest(p, q, ["id"], "place").collect()}
    close = {r.id: r.place for r in rel.nearest(p, q, ["id"], "place", within=20.0).collect()}
    monkeypatch.setattr(rel, "BROADCAST_ROWS", 10)
    assert {r.id: (r.place, round(r.km, 6)) for r in rel.nearest(p, q, ["id"], "place").collect()} == want and len(want) == 250
    assert {r.id: r.place for r in rel.nearest(p, q, ["id"], "place", within=20.0).collect()} == close


def test_ranks_and_quantiles(spark):
    rng = random.Random(5)
    rows = [("a", rng.random()) for _ in range(501)] + [("b", 7.0)] * 40 + [("c", float(i)) for i in range(4)] + [("d", None), ("a", None), ("e", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r.k: r.q for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", 0.9).alias("q")).collect()}
    got = {r.k: r.q for r in rel.quantiles(df, "k", "v", 0.9, "q").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ward_ids(spark):
    w = spark.createDataFrame([("x", "7"), ("y", "12.0"), (None, "3")], "name string, code string")
    assert sorted((r.name, r.ward_id) for r in details.ward_ids(w, "delhi", True).collect()) == [("Ward 3", "delhi_003"), ("x", "delhi_007"), ("y", "delhi_012")]
    with pytest.raises(Exception, match="no id of its own"):
        details.ward_ids(w.union(spark.createDataFrame([("z", "7")], w.schema)), "delhi", True).collect()


def test_contract(spark):
    schema = contract.schema_differences(spark.range(1), spark.createDataFrame([], "id int, x string").schema)
    assert schema == [("id", "int", "bigint"), ("x", "string", None)]
    with pytest.raises(Exception, match="leaks"):
        contract.gated(spark.createDataFrame([("a </think> b",)], "document string")).collect()


def test_feeds(spark, tmp_path):
    spark.createDataFrame([(2023, 12, 1), (2024, 1, 2), (2024, 2, 3)], "year int, month int, v int").write.partitionBy("year", "month").parquet(str(tmp_path / "m"))
    kept, fetch = feeds.cached_months(spark, str(tmp_path / "m"), [(2023, 12), (2024, 1), (2024, 2), (2024, 3)], (2024, 2))
    assert sorted(r.v for r in kept.collect()) == [1, 2] and fetch == [(2024, 2), (2024, 3)]
    assert feeds.sources("all") == list(feeds.SOURCES) and feeds.sources("firms, osm,firms") == ["firms", "osm"]
    with pytest.raises(ValueError, match="unknown source"):
        feeds.sources("nope")
    (tmp_path / "c.json").write_text('{"slug": "delhi", "tier": "deep"}\n{"slug": "pune", "tier": "standard"}\n')
    assert [r.slug for r in feeds.cities(spark, str(tmp_path / "c.json"), "pune, x").collect()] == ["pune"] and feeds.cities(spark, str(tmp_path / "c.json"), "all").count() == 2
    (tmp_path / "s.json").write_text('[{"id": 1, "name": "n", "parameters": ["pm25"]}]')
    assert feeds.seeds(spark, str(tmp_path / "s.json")).first().parameters == ["pm25"]
    (tmp_path / "w.json").write_text(json.dumps({"elements": [
        {"type": "way", "id": 1, "tags": {"highway": "primary"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]},
        {"type": "way", "id": 2, "tags": {"building": "yes"}, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}]}, {"type": "node", "id": 3}]}))
    got = {r.id: (len(r.line), r.closed) for r in feeds.ways(spark, str(tmp_path / "w.json")).collect()}
    assert got == {1: (2, False), 2: (4, True)}
    bad = feeds.validated(spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "body string"), "a int").collect()
    assert [r.error for r in bad] == [None, "json", "json"] and bad[0].data.a == 1


def test_store_is_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2024-01-05 00:00:00", 1.0), ("s", "2024-02-05 00:00:00", 2.0)], "station_id string, at string, pm25 double").withColumn("ts_utc", F.to_timestamp("at"))
    path = str(tmp_path / "store")
    store.write(store.finalized(rows), path)
    store.write(store.finalized(rows.where("pm25 = 2.0").withColumn("pm25", F.lit(9.0))), path)
    assert sorted(r.pm25 for r in store.read(spark, path).collect()) == [1.0, 9.0]
    plan = store.read(spark, path).select("pm25")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<pm25:double>" in plan
    with pytest.raises(ValueError, match="column"):
        store.write(rows, path)
    new = store.enriched(store.read(spark, path), rows.select("station_id", "ts_utc", F.lit(5.0).alias("no2")), ["station_id", "ts_utc"])
    assert [r.no2 for r in new.collect()] == [5.0, 5.0] and store.problems(store.finalized(new)) == []
    store.emit(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1}'
    log = spark.createDataFrame([("x", "https://a/b?key=1", "2024-01-01")], "source string, base_url string, fetched_at string")
    assert [(r.base_url, r.fetched_at) for r in store.merged_lineage(log, log.withColumn("fetched_at", F.lit("2024-02-01"))).collect()] == [("https://a/b", "2024-02-01")]


def test_publish_and_lookups(spark, tmp_path):
    assert publish.order("standard") == ["nowcast", "forecast", "advisories"]
    root = str(tmp_path / "city")
    assert publish.publish(spark, "/root/testdata/sf0.001", root, "standard") == ["nowcast", "forecast", "advisories"]
    got = publish.call(spark, root, "get_nowcast", ward_id="delhi_003")
    assert got["available"] and json.loads(got["entries"][0])["ward_id"] == "delhi_003"
    assert len(publish.call(spark, root, "get_advisories", top=5)["entries"]) == 5
    assert publish.call(spark, root, "get_ledger")["available"] is False
    assert "error" in publish.call(spark, root, "drop_table") and "error" in publish.call(spark, root, "get_nowcast", city="x")
    doc = publish.loaded(spark, root, "nowcast")
    slim = documents.stripped(doc, spark.createDataFrame([], "city string").schema)
    assert slim.first().document == '{"city":"delhi"}'


def test_numbered(spark):
    rows, n = models.numbered(spark.range(500).withColumnRenamed("id", "k"), "k", "i", 16)
    assert n == 500 and sorted(r.i for r in rows.collect()) == list(range(500))


def test_live_snapshot_and_many_points(spark, tmp_path):
    at = lambda h: {"utc": f"2024-01-01T0{h}:20:00Z"}
    (tmp_path / "l.json").write_text(json.dumps({"results": [{"datetime": at(1), "value": 5.0, "sensorsId": 1, "locationsId": 9}, {"datetime": at(3), "value": 7.0, "sensorsId": 1, "locationsId": 9}, {"datetime": at(2), "value": -1.0, "sensorsId": 2, "locationsId": 9}, {"datetime": {"utc": "x"}, "value": 1.0, "sensorsId": 1}]}))
    sensors = spark.createDataFrame([(1, "pm25"), (2, "no2"), (3, "bc")], "sensor long, parameter string")
    got = sorted((r.parameter, r.ts_utc.hour, r.value) for r in feeds.live(spark, str(tmp_path / "l.json"), sensors).collect())
    assert got == [("no2", 2, None), ("pm25", 3, 7.0)]
    rows = [("A", "PM2.5", "31", "05-01-2024 10:00:00"), ("A", "OZONE", "NA", "05-01-2024 10:00:00"), ("B", "NH3", "4", "05-01-2024 10:00:00"), ("B", "CO", "2", "bad")]
    (tmp_path / "s.json").write_text(json.dumps({"records": [dict(zip(("station", "pollutant_id", "avg_value", "last_update"), r, strict=True)) for r in rows]}))
    got = feeds.snapshot(spark, str(tmp_path / "s.json")).collect()
    assert [(r.station, r.ts_utc.hour, r.ts_utc.minute, r.pm25, r.o3) for r in got] == [("A", 4, 30, 31.0, None)]
    (tmp_path / "m.json").write_text(json.dumps([{"latitude": x, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [x]}} for x in (1.0, 3.0)]))
    assert sorted((r.latitude, r.temp_2m) for r in feeds.meteo(spark, str(tmp_path / "m.json")).collect()) == [(1.0, 1.0), (3.0, 3.0)]
    assert feeds.span("2024-01-01", datetime.date(2024, 1, 5)) == (datetime.date(2024, 1, 1), datetime.date(2024, 1, 4))
    with pytest.raises(ValueError, match="not before"):
        feeds.span("2024-01-05", datetime.date(2024, 1, 5))
