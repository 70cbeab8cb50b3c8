import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import relational as rel
from skyloom.sources import feeds


def star(rng, x, y, r, n):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    ring = [(float(x + r * k * np.cos(t)), float(y + r * k * np.sin(t))) for t, k in zip(a, rng.uniform(0.4, 1, n), strict=True)]
    return [*ring, ring[0]]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [0.05, 0.3, 2.0])
def test_equals_brute_force(spark, size):
    rng = np.random.default_rng(2)
    places = {}
    for k in range(8):
        x, y = rng.uniform(-1, 1, 2)
        places[f"p{k}"] = [star(rng, x, y, 0.5, 14), star(rng, x, y, 0.15, 6), star(rng, x, y, 0.05, 5), star(rng, x + 1.5, y, 0.2, 7)]
    places["box"] = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5), (0.25, 0.25)]]
    points = [(float(a), float(b)) for a, b in rng.uniform(-1.5, 3, (1500, 2))] + [(0.0, 0.5), (1.0, 1.0), (0.25, 0.3), (0.5, 0.5), (0.3, 0.25), (0.3, 0.3), (0.1, 0.1), (0.5, 0.75)] + [places["p0"][0][3]]
    table = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rs]) for k, rs in places.items()], "name string, rings array<array<struct<x:double,y:double>>>")
    frame = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "id int, lon double, lat double")
    got = {r.id: r.name for r in rel.points_in_areas(frame, table, size, "name", F.lit("none")).select("id", "name").collect()}
    want = {k: min((n for n, rs in places.items() if inside(x, y, rs)), default="none") for k, (x, y) in enumerate(points)}
    assert got == want and len(set(want.values())) > 5


def test_inner_cells_need_no_edges(spark):
    box = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]
    cover = rel.area_cover(spark.createDataFrame([("a", box)], "name string, rings array<array<struct<x:double,y:double>>>"), 0.1, "name")
    rows = cover.collect()
    assert sum(all(s.inner and s.edges is None for s in r["_subs"]) for r in rows) >= 64
    assert all(len(s.edges) <= 4 for r in rows for s in r["_subs"] if not s.inner)


def test_parts_stay_apart(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"features": [{"properties": {"n": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[9,0],[9,9],[0,0]],[[1,1],[2,1],[2,2],[1,1]]],[[[20,0],[21,0],[21,1],[20,0]]]]}}, {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    got = feeds.ward_polygons(spark, str(tmp_path / "w.json")).collect()
    assert [[len(part) for part in r.parts] for r in got] == [[2, 1], [1]] and [len(r.rings) for r in got] == [3, 1]
