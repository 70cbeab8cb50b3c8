import json

import numpy as np
import pytest

from skyloom.operators import borders

RINGS = "name string, rings array<array<struct<x:double,y:double>>>"


def table(spark, places):
    return spark.createDataFrame([(k, None if rs is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in rs]) for k, rs in places.items()], RINGS)


def thin(spark, places, tolerance):
    return {r.name: None if r.rings is None else [[(p.x, p.y) for p in ring] for ring in r.rings] for r in borders.thinned(table(spark, places), "name", tolerance).collect()}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def segments(places):
    return [(a, b) for rs in places.values() for r in rs for a, b in zip(r, r[1:], strict=False)]


def crossing(parts):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = []
    for i, (a, b) in enumerate(parts):
        for c, d in parts[:i]:
            if not {a, b} & {c, d} and side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                out.append((a, b, c, d))
    return out


def country(n, steps, rough, seed):
    """A square of n x n wards with rough borders, the same places on both sides."""
    rng = np.random.default_rng(seed)
    corner = {(i, j): (i + rng.uniform(-0.2, 0.2), j + rng.uniform(-0.2, 0.2)) for i in range(n + 1) for j in range(n + 1)}
    lines = {}

    def side(a, b):
        if a > b:
            return side(b, a)[::-1]
        if (a, b) not in lines:
            t = np.linspace(0, 1, steps + 1)[1:-1]
            p, q = np.array(corner[a]), np.array(corner[b])
            away = np.array([p[1] - q[1], q[0] - p[0]])
            off = rng.uniform(-rough, rough, len(t)) * np.minimum(t, 1 - t)
            lines[a, b] = [corner[a], *(tuple(map(float, p + (q - p) * k + away * o)) for k, o in zip(t, off, strict=True)), corner[b]]
        return lines[a, b]

    out = {}
    for i in range(n):
        for j in range(n):
            around = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
            out[f"{i}-{j}"] = [[p for a, b in zip(around, around[1:], strict=False) for p in side(a, b)[:-1]] + [corner[i, j]]]
    return out


@pytest.mark.parametrize(("tolerance", "rough"), [(0.01, 0.1), (0.1, 0.4), (0.6, 0.4)])
def test_wards_still_fit(spark, tolerance, rough):
    before = country(4, 24, rough, 7)
    before["0-0"].append([(0.4, 0.4), (0.41, 0.6), (0.6, 0.61), (0.6, 0.4), (0.4, 0.4)])
    before["island"] = [[(0.4, 0.4), (0.6, 0.4), (0.6, 0.61), (0.41, 0.6), (0.4, 0.4)]]
    assert not crossing(sorted({tuple(sorted(s)) for s in segments(before)}))
    after = thin(spark, before, tolerance)
    parts = segments(after)
    assert len(parts) < 0.8 * len(segments(before))
    assert not crossing(sorted({tuple(sorted(s)) for s in parts}))
    # Each piece inside is on two sides, in both directions; the pieces outside bound the whole.
    count = {}
    for a, b in parts:
        assert a != b
        count[a, b] = count.get((a, b), 0) + 1
    assert max(count.values()) == 1
    outer = [(a, b) for a, b in count if (b, a) not in count]
    assert len({a for a, _ in outer}) == len(outer)
    whole = sum(a[0] * b[1] - b[0] * a[1] for a, b in outer) / 2
    assert abs(sum(abs(area(r)) for k, rs in after.items() if k != "island" for r in rs[:1]) - whole) < 1e-9
    assert set(p for s in parts for p in s) <= set(p for s in segments(before) for p in s)
    assert all(len(r) >= 4 and abs(area(r)) > 0 for rs in after.values() for r in rs)
    if tolerance < 0.2:
        for a, b in {p for p in segments(before) if (p[1], p[0]) in set(segments(before))}:
            assert min(distance(a, s) for s in parts) <= tolerance + 1e-12


def distance(p, s):
    (ax, ay), (bx, by) = s
    dx, dy = bx - ax, by - ay
    t = min(1, max(0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy)))
    return np.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy)


def test_a_place_close_by_keeps_a_bend(spark):
    # The bump would vanish, but another ward's corner lies in it.
    bump = [(0, 0), (4, 0), (4, 4), (2, 4.5), (0, 4), (0, 0)]
    assert len(thin(spark, {"a": [bump]}, 1)["a"][0]) == 5
    assert len(thin(spark, {"a": [bump], "b": [[(1.9, 4.3), (1.9, 1), (1.5, 1), (1.9, 4.3)]]}, 1)["a"][0]) == 6


def test_odd_rings(spark):
    line = [(0, 0), (1, 0), (0, 0)]
    got = thin(spark, {"none": None, "no": [], "empty": [[]], "point": [[(1, 1)]], "line": [line], "twice": [[(5, 5), (6, 5), (6, 5), (6, 6), (5, 5)]], "small": [[(9, 9), (9.001, 9), (9.001, 9.001), (9, 9)]]}, 0.1)
    assert got["none"] is None and got["no"] == [] and got["empty"] == [[]] and got["point"] == [[(1.0, 1.0), (1.0, 1.0)]]
    assert sorted(got["line"][0]) == sorted((float(x), float(y)) for x, y in line)
    assert len(got["twice"][0]) == 4 and len(got["small"][0]) == 4
    assert borders.thinned(spark.createDataFrame([], RINGS), "name", 0.1).count() == 0


def test_slivers_do_not_collapse(spark):
    a = [(0, 0), (1, 0.01), (2, 0), (1, -0.01), (0, 0)]
    b = [(0, 0), (1, 0.01), (2, 0), (2, 3), (0, 3), (0, 0)]
    c = [(0, 0), (1, -0.01), (2, 0), (2, -3), (0, -3), (0, 0)]
    got = thin(spark, {"a": [a], "b": [b], "c": [c]}, 0.5)
    assert sorted(set(got["a"][0])) == sorted({(float(x), float(y)) for x, y in a})


def test_published_parts(spark):
    from skyloom.plans.details import bordered_features

    square = lambda x, y, k: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + k / 2, y + 0.001), (x + k, y), (x + k, y + k), (x, y + k), (x, y))]
    rows = spark.createDataFrame([("a", [[square(0, 0, 1), square(0.2, 0.2, 0.2)], [square(5, 5, 1)]]), ("b", [[square(1, 0, 1)]]), ("c", [])], "name string, parts array<array<array<struct<x:double,y:double>>>>")
    got = {r.name: json.loads(r.feature) for r in bordered_features(rows, "name", 0.01, 3, "name").collect()}
    assert got["c"]["geometry"] is None and got["b"]["properties"] == {"name": "b"}
    assert got["a"]["geometry"]["type"] == "MultiPolygon" and [[len(r) for r in part] for part in got["a"]["geometry"]["coordinates"]] == [[5, 5], [5]]
    assert got["b"]["geometry"]["type"] == "Polygon" and got["b"]["geometry"]["coordinates"][0][0] in ([1.0, 0.0], [1.0, 1.0])
