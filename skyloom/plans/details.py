"""Registered queries of polygons and shapes, displayed values, windows and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aqi, display, geo, shapes, text
from ..operators import borders
from ..operators import relational as rel
from . import documents as docs
from . import tables as t
from .registry import _A10, mean24, query, r6, station_rows

# Polygons.

_CROSSED = "CASE WHEN (ay > {y}) <> (bz > {y}) AND {x} < (bx - ax) * ({y} - ay) / (bz - ay) + ax THEN 1 ELSE 0 END"
_IN_WARD = "SELECT event_id, ward_id FROM fires, edges GROUP BY 1, 2 HAVING sum(" + _CROSSED.format(x="lon", y="lat") + ") % 2 = 1"


@query("J3_polygons", f"SELECT event_id, coalesce(min(ward_id), 'delhi_unassigned') AS ward_id FROM fires LEFT JOIN ({_IN_WARD}) USING (event_id) GROUP BY 1", "fires edges")
def _(spark, d):
    points = t.fires(spark, d).select("event_id", "lat", "lon")
    return rel.points_in_rings(points, t.rings(spark, d).select("ward_id", "ring"), 0.05, "ward_id", F.lit("delhi_unassigned")).select("event_id", "ward_id")


@query("J3_areas", f"SELECT event_id, coalesce(min(ward_id), 'delhi_unassigned') AS ward_id FROM fires LEFT JOIN ({_IN_WARD.replace('edges', 'area_edges')}) USING (event_id) GROUP BY 1", "fires area_edges")
def _(spark, d):
    """Fires in wards that have holes, islands in them and parts by themselves."""
    points = t.fires(spark, d).select("event_id", "lat", "lon")
    return rel.points_in_areas(points, t.areas(spark, d).select("ward_id", "rings"), 0.05, "ward_id", F.lit("delhi_unassigned")).select("event_id", "ward_id")


@query("J4_cells_in_polygons", "SELECT ward_id, count(*) AS cells FROM (SELECT id, min(ward_id) AS ward_id FROM (SELECT id, ward_id FROM (SELECT i * 60 + j AS id, 28.40::DOUBLE + (i + 0.5::DOUBLE) / 100.0 AS lat, 76.83::DOUBLE + (j + 0.5::DOUBLE) / 100.0 AS lon FROM range(60) a(i), range(60) b(j)), edges GROUP BY 1, 2 HAVING sum("
       + _CROSSED.format(x="lon", y="lat") + ") % 2 = 1) GROUP BY 1) GROUP BY 1", "edges")
def _(spark, d):
    cells = spark.range(3600).select("id", (28.40 + (F.floor(F.col("id") / 60) + 0.5) / 100.0).alias("lat"), (76.83 + (F.col("id") % 60 + 0.5) / 100.0).alias("lon"))
    inside = rel.points_in_rings(cells, t.rings(spark, d).select("ward_id", "ring"), 0.05, "ward_id", F.lit(None).cast("string")).where("ward_id is not null")
    return inside.groupBy("ward_id").agg(F.count(F.lit(1)).alias("cells"))


@query("S17_zonal_sum", "SELECT ward_id, sum(people) AS population FROM (SELECT id, min(ward_id) AS ward_id, any_value(people) AS people FROM (SELECT id, ward_id, any_value(people) AS people FROM (SELECT i * 100 + j AS id, i * 7 % 40 + j AS people, 28.40::DOUBLE + (i * 5 + 2) / 1000.0::DOUBLE AS lat, 76.83::DOUBLE + (j * 5 + 2) / 1000.0::DOUBLE AS lon FROM range(100) a(i), range(100) b(j)), edges GROUP BY 1, 2 HAVING sum("
       + _CROSSED.format(x="lon", y="lat") + ") % 2 = 1) GROUP BY 1) GROUP BY 1", "edges")
def _(spark, d):
    """The cells of a raster are points; those within a ward are summed."""
    i, j = F.floor(F.col("id") / 100), F.col("id") % 100
    raster = spark.range(10_000).select("id", (i * 7 % 40 + j).alias("people"), (28.40 + (i * 5 + 2) / F.lit(1000.0)).alias("lat"), (76.83 + (j * 5 + 2) / F.lit(1000.0)).alias("lon"))
    inside = rel.points_in_rings(raster, t.rings(spark, d).select("ward_id", "ring"), 0.05, "ward_id", F.lit(None).cast("string")).where("ward_id is not null")
    return inside.groupBy("ward_id").agg(F.sum("people").alias("population"))


@query("G8_cell_rings", "SELECT i, j, p, round(76.83::DOUBLE + (j + dx) * 0.01, 6) AS x, round(28.4::DOUBLE + (i + dy) * 0.01, 6) AS y FROM (SELECT DISTINCT CAST(floor(round_even(lat / 0.01, 6)) - 2840 AS BIGINT) AS i, CAST(floor(round_even(lon / 0.01, 6)) - 7683 AS BIGINT) AS j FROM fires), (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(p, dx, dy)", "fires")
def _(spark, d):
    """The outlines of all cells in which a fire was seen."""
    index = lambda c, least: (geo.cell_floor(F.col(c)) - least).cast("long")
    cells = t.fires(spark, d).select(index("lat", 2840).alias("i"), index("lon", 7683).alias("j")).distinct()
    ring = shapes.cell_ring(F.lit(t.SOUTH), F.lit(t.WEST), F.col("i"), F.col("j"), geo.CELL)
    return cells.select("i", "j", F.posexplode(ring).alias("p", "v")).select("i", "j", "p", r6("v.x").alias("x"), r6("v.y").alias("y"))


@query("G9_ward_ids", "SELECT name, 'delhi_' || lpad(CAST(dense_rank() OVER (ORDER BY code) AS VARCHAR), 3, '0') AS ward_id, code FROM (SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE 'Z' || n_nationkey END AS code FROM nation)")
def _(spark, d):
    wards = t.read(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("Z"), F.col("n_nationkey").cast("string"))).alias("code"))
    return ward_ids(wards, "delhi", False)


def ward_ids(wards: DataFrame, city: str, numeric: bool) -> DataFrame:
    """``name, code, ward_id``: a numeric code padded to three digits, other codes by their place in order; a missing code is
    the name. Equal ids are an error: the plan raises where one occurs. As many rows as a city has wards."""
    code = F.coalesce(F.col("code").cast("string"), F.col("name"))
    number = F.col("code").cast("double").cast("long") if numeric else F.dense_rank().over(Window.orderBy("_code"))
    out = wards.withColumn("_code", code).withColumn("_i", number).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_i")))
    sound = F.when((F.col("_n") > 1) | F.col("_i").isNull(), F.raise_error(F.concat(F.lit("no id of its own: "), F.coalesce("_code", F.lit(""))))).otherwise(F.lpad(F.col("_i").cast("string"), 3, "0"))
    return out.select(F.coalesce("name", F.concat(F.lit("Ward "), F.col("_code"))).alias("name"), F.col("_code").alias("code"), F.concat(F.lit(f"{city}_"), sound).alias("ward_id"))


_MID = "SELECT ward_id, (min(ay) + max(ay)) / 2 AS y FROM edges GROUP BY 1"


@query("G10_representative", "SELECT ward_id, round(arg_max(mid, w), 6) AS x, round(any_value(y), 6) AS y FROM (SELECT ward_id, y, (x + nx) / 2 AS mid, nx - x AS w, n FROM (SELECT *, lead(x) OVER (PARTITION BY ward_id ORDER BY x) AS nx, row_number() OVER (PARTITION BY ward_id ORDER BY x) AS n FROM (SELECT ward_id, y, ax + (y - ay) / (bz - ay) * (bx - ax) AS x FROM edges JOIN ("
       + _MID + ") USING (ward_id) WHERE (ay > y) <> (bz > y)))) WHERE n % 2 = 1 GROUP BY 1", "edges")
def _(spark, d):
    return t.rings(spark, d).select("ward_id", shapes.representative(F.col("ring")).alias("p")).select("ward_id", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query("G11_vertex_mean", "SELECT ward_id, round((sum(ax) + min(ax) FILTER (WHERE i = 0)) / 6, 6) AS x, round((sum(ay) + min(ay) FILTER (WHERE i = 0)) / 6, 6) AS y FROM edges GROUP BY 1", "edges")
def _(spark, d):
    return t.rings(spark, d).select("ward_id", shapes.vertex_mean(F.col("ring")).alias("p")).select("ward_id", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query("A28_feature_bounds", "SELECT round(min(ax), 6) AS west, round(min(ay), 6) AS south, round(max(ax), 6) AS east, round(max(ay), 6) AS north, round(avg(ax), 6) AS x, round(avg(ay), 6) AS y FROM (SELECT ax, ay FROM edges UNION ALL SELECT ax, ay FROM edges WHERE i = 0)", "edges")
def _(spark, d):
    v = t.rings(spark, d).select(F.explode("ring").alias("v")).select("v.x", "v.y")
    return v.agg(r6(F.min("x")).alias("west"), r6(F.min("y")).alias("south"), r6(F.max("x")).alias("east"), r6(F.max("y")).alias("north"), r6(F.avg("x")).alias("x"), r6(F.avg("y")).alias("y"))


#: Kilometres over which the sites of industry are looked for.
SITE_KM = 100.0


def _places(spark, d, km: float = 2.0) -> DataFrame:
    """Stations with the polygons that may come within ``km``, met by the cells that the station's reach and the polygon's
    bounds touch: each ward's outline is a road, and a building or an industrial site. Coordinates are metres from the station."""
    st = t.station(spark).select("station", F.col("lat").alias("y0_"), F.col("lon").alias("x0_"))
    tall = km / rel.DEGREE_KM
    wide = F.lit(tall) / F.cos(F.radians(F.least(F.lit(89.0), F.abs("y0_") + tall)))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / rel.PLACE_CELL).cast("int"), F.floor(hi / rel.PLACE_CELL).cast("int")))
    near = st.withColumn("_x", cells(F.col("x0_") - wide, F.col("x0_") + wide)).withColumn("_y", cells(F.col("y0_") - tall, F.col("y0_") + tall))
    own = t.rings(spark, d).select("ward_id", "ring", shapes.bounds(F.col("ring")).alias("_box"))
    own = own.withColumn("_x", cells(F.col("_box.west"), F.col("_box.east"))).withColumn("_y", cells(F.col("_box.south"), F.col("_box.north")))
    # A polygon over several cells is kept once, in the first cell that both touch.
    first = (F.col("_x") == F.greatest(F.floor((F.col("x0_") - wide) / rel.PLACE_CELL), F.floor(F.col("_box.west") / rel.PLACE_CELL))) & (F.col("_y") == F.greatest(F.floor((F.col("y0_") - tall) / rel.PLACE_CELL), F.floor(F.col("_box.south") / rel.PLACE_CELL)))
    return near.join(own, ["_x", "_y"]).where(first).drop("_x", "_y", "_box").withColumn("m", shapes.to_metres(F.col("ring"), F.col("y0_"), F.col("x0_")))


_DEG = "(pi() / 180 * 6371008.8)"
_METRES = f"SELECT station, ward_id, i, (ax - lon) * {_DEG} * cos(radians(lat)) AS ax, (ay - lat) * {_DEG} AS ay, (bx - lon) * {_DEG} * cos(radians(lat)) AS bx, (bz - lat) * {_DEG} AS bz FROM station, edges"
_CLIP = f"SELECT *, (bx - ax) * (bx - ax) + (bz - ay) * (bz - ay) AS l2, ax * (bx - ax) + ay * (bz - ay) AS ab, ax * ax + ay * ay AS a2 FROM ({_METRES})"
_ROOTS = "SELECT *, ab * ab - l2 * (a2 - {r} * {r}) AS disc, greatest(0.0, -ab / l2 - sqrt(greatest(0.0, ab * ab - l2 * (a2 - {r} * {r}))) / l2) AS t0, least(1.0, -ab / l2 + sqrt(greatest(0.0, ab * ab - l2 * (a2 - {r} * {r}))) / l2) AS t1 FROM (" + _CLIP + ")"


@query("G12_road_density", "SELECT station, round(sum(CASE WHEN disc > 0 AND t1 > t0 THEN (t1 - t0) * sqrt(l2) ELSE 0 END) / 1000 / (pi() * 2.0 * 2.0), 6) AS density FROM (" + _ROOTS.format(r="2000.0") + ") GROUP BY 1", "station edges")
def _(spark, d):
    """Kilometres of road in a circle of 2 km, by its area."""
    got = _places(spark, d).groupBy("station").agg(r6(F.sum(shapes.length_in_circle(F.col("m"), 2000.0)) / 1000 / (F.pi() * 4.0)).alias("density"))
    return t.station(spark).select("station").join(got, "station", "left").select("station", F.coalesce("density", F.lit(0.0)).alias("density"))


_SECTOR = "atan2({0} * {3} - {1} * {2}, {0} * {2} + {1} * {3}) * (2000.0 * 2000.0 / 2)"


@query("G13_built_up", "SELECT station, round(least(1.0, sum(abs(part)) / (pi() * 2000.0 * 2000.0)), 6) AS fraction FROM (SELECT station, ward_id, sum(CASE WHEN disc > 0 AND v > u THEN " + _SECTOR.format("ax", "ay", "px", "py") + " + (px * qy - py * qx) / 2 + " + _SECTOR.format("qx", "qy", "bx", "bz") + " ELSE " + _SECTOR.format("ax", "ay", "bx", "bz")
       + " END) AS part FROM (SELECT *, ax + u * (bx - ax) AS px, ay + u * (bz - ay) AS py, ax + v * (bx - ax) AS qx, ay + v * (bz - ay) AS qy FROM (SELECT *, least(1.0, greatest(0.0, t0)) AS u, least(1.0, greatest(0.0, t1)) AS v FROM (" + _ROOTS.format(r="2000.0") + "))) GROUP BY 1, 2) GROUP BY 1", "station edges")
def _(spark, d):
    got = _places(spark, d).groupBy("station").agg(r6(F.least(F.lit(1.0), F.sum(shapes.area_in_circle(F.col("m"), 2000.0)) / (F.pi() * 2000.0 * 2000.0))).alias("fraction"))
    return t.station(spark).select("station").join(got, "station", "left").select("station", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


_ALONG = "least(1.0, greatest(0.0, -ab / l2))"


@query("G14_industrial_km", f"SELECT station, round(min(km), 6) AS km FROM (SELECT station, ward_id, CASE WHEN sum(" + _CROSSED.format(x="0.0", y="0.0") + f") % 2 = 1 THEN 0.0 ELSE min(sqrt(pow(ax + {_ALONG} * (bx - ax), 2) + pow(ay + {_ALONG} * (bz - ay), 2))) / 1000 END AS km FROM ({_CLIP}) WHERE CAST(right(ward_id, 3) AS INT) % 6 = 0 GROUP BY 1, 2) GROUP BY 1", "station edges")
def _(spark, d):
    sites = _places(spark, d, SITE_KM).where(F.substring("ward_id", -3, 3).cast("int") % 6 == 0)
    km = F.when(geo.inside_ring(F.lit(0.0), F.lit(0.0), F.col("m")), 0.0).otherwise(shapes.distance_to_line(F.col("m")) / 1000)
    return sites.groupBy("station").agg(r6(F.min(km)).alias("km"))


def _utm_sql() -> str:
    n = shapes.FLATTENING / (2 - shapes.FLATTENING)
    radius = shapes.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    north = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    k = f"{shapes.SCALE * radius!r}::DOUBLE"
    return (f"SELECT event_id, round(500000 + {k} * ({east}), 3) AS x, round({k} * ({north}), 3) AS y FROM (SELECT event_id, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM ("
            f"SELECT event_id, radians(lon - 75) AS away, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM fires))")


@query("G15_utm", _utm_sql(), "fires")
def _(spark, d):
    return t.fires(spark, d).select("event_id", shapes.utm(F.col("lat"), F.col("lon"), 43).alias("p")).select("event_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("G16_rounded", "SELECT ward_id, i, round(ax, 3) AS x, round(ay, 3) AS y FROM edges", "edges")
def _(spark, d):
    ring = shapes.rounded(F.col("ring"), 3)
    return t.rings(spark, d).select("ward_id", F.posexplode(ring).alias("i", "p")).where("i < 5").select("ward_id", "i", "p.x", "p.y")


@query("K7_roads", "SELECT ward_id, CAST(2 AS BIGINT) AS n, round(x0 + 0.0013::DOUBLE, 4) AS x, round(y0 + 0.0017::DOUBLE, 4) AS y FROM wards", "wards")
def _(spark, d):
    """Nearly straight roads: all places between the ends lie within the tolerance."""
    bent = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: shapes.point(F.col("x0") + 0.0013 + i * 0.004, F.col("y0") + 0.0017 + i * 0.003 + F.when(i % 2 == 1, 0.0009).otherwise(0.0)))
    roads = t.wards(spark, d).select("ward_id", shapes.simplified(bent, 0.003).alias("line"))
    return roads.select("ward_id", F.size("line").cast("long").alias("n"), F.get(shapes.rounded(F.col("line"), 4), 0).alias("p")).select("ward_id", "n", "p.x", "p.y")


@query("G17_svg_paths", "SELECT ward_id, string_agg((CASE WHEN i = 0 THEN 'M' ELSE 'L' END) || printf('%.1f %.1f', x, y), '' ORDER BY i) || 'Z' AS path FROM (SELECT ward_id, i, 8 + (384 - (w * k) * s) / 2 + (ax - 76.83) * k * s AS x, 8 + (284 - 0.5 * s) / 2 + (28.9 - ay) * s AS y FROM (SELECT ward_id, i, ax, ay FROM edges UNION ALL SELECT ward_id, 5, ax, ay FROM edges WHERE i = 0), "
       "(SELECT 0.5::DOUBLE AS w, cos(radians(28.65)) AS k, least(384 / (0.5 * cos(radians(28.65))), 284 / 0.5::DOUBLE) AS s)) GROUP BY 1", "edges")
def _(spark, d):
    at = F.transform("ring", lambda p: shapes.projected(p["x"], p["y"], (76.83, 28.4, 77.33, 28.9), 400, 300))
    return t.rings(spark, d).select("ward_id", shapes.svg_path(at).alias("path"))


@query("K8_wards", "SELECT ward_id, ward_id AS id, CAST(6 AS INTEGER) AS corners, round(x0 + 0.0871::DOUBLE, 5) AS x2, round(y0 + 0.0557::DOUBLE, 5) AS y2 FROM wards", "wards")
def _(spark, d):
    """Features as they are published: simplified by 0.0001 degrees, rounded to 5 digits, as JSON."""
    f = features(t.rings(spark, d), "ring", 0.0001, 5, "ward_id")
    ring = F.from_json(F.get_json_object("feature", "$.geometry.coordinates[0]"), "array<array<double>>")
    return f.select("ward_id", F.get_json_object("feature", "$.properties.ward_id").alias("id"), ring.alias("r")).select("ward_id", "id", F.size("r").alias("corners"), F.col("r")[2][0].alias("x2"), F.col("r")[2][1].alias("y2"))


def features(rows: DataFrame, ring: str, tolerance: float, digits: int, *properties: str) -> DataFrame:
    """Adds ``feature``: the JSON of each polygon, thinned and rounded."""
    coordinates = F.array(F.transform(shapes.rounded(shapes.simplified(F.col(ring), tolerance), digits), lambda p: F.array(p["x"], p["y"])))
    return rows.withColumn("feature", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))))


_BIG = "CASE WHEN (7 * {0} + 13 * j) % 4 = 0 THEN 1 ELSE 0 END"


@query("K8_shared_borders", f"SELECT i, j, CAST(5 + low + high AS INTEGER) AS corners, round(0.0009::DOUBLE * (1 + (high - low) * 0.1::DOUBLE), 8) AS area FROM (SELECT i, j, {_BIG.format('i')} AS low, {_BIG.format('(i + 1)')} AS high FROM (SELECT DISTINCT CAST(floor(round((lat - 28) * 100) / 3) AS BIGINT) AS i, CAST(floor(round((lon - 76.3) * 100) / 3) AS BIGINT) AS j FROM fires))", "fires")
def _(spark, d):
    """The cells in which fires were seen, as areas with uneven borders, published: small bends go, large ones stay on both sides."""
    index = lambda c, least: F.floor(F.round((F.col(c) - least) * 100) / 3).cast("long").alias("i" if c == "lat" else "j")
    cells = t.fires(spark, d).select(index("lat", 28), index("lon", 76.3)).distinct()
    i, j = F.col("i"), F.col("j")
    corner = lambda y, x: (x, y + F.lit(0.15) * ((x + y) % 2))
    bend = lambda y: (j + 0.5, y + F.when((7 * y + 13 * j) % 4 == 0, 0.275).otherwise(0.115))
    ring = [corner(i, j), bend(i), corner(i, j + 1), (j + 1, i + 0.5), corner(i + 1, j + 1), bend(i + 1), corner(i + 1, j), (j, i + 0.5), corner(i, j)]
    areas = cells.select("i", "j", F.concat_ws("_", i, j).alias("cell"), F.array(F.array(F.array(*(shapes.point(x * F.lit(0.03), y * F.lit(0.03)) for x, y in ring)))).alias("parts"))
    f = bordered_features(areas, "cell", 0.003, 5, "cell")
    back = F.transform(F.from_json(F.get_json_object("feature", "$.geometry.coordinates[0]"), "array<array<double>>"), lambda p: shapes.point(p[0], p[1]))
    return f.select("i", "j", back.alias("r")).select("i", "j", F.size("r").alias("corners"), F.round(shapes.area(F.col("r")), 8).alias("area"))


def bordered_features(rows: DataFrame, key: str, tolerance: float, digits: int, *properties: str) -> DataFrame:
    """Adds ``feature``: the JSON of each area, given as ``parts`` (arrays of closed rings, holes after the outline). Borders are
    thinned alike on both sides and rounded, so that areas still fit together. An area without parts has no geometry."""
    thin = borders.thinned(rows.withColumn("_flat", F.flatten("parts")), key, tolerance, "_flat")
    before = lambda k: F.aggregate(F.slice("parts", 1, k), F.lit(0), lambda n, part: n + F.size(part))
    cut = F.transform("parts", lambda part, k: F.slice("_flat", before(k) + 1, F.size(part)))
    plain = F.transform(cut, lambda part: F.transform(part, lambda ring: F.transform(shapes.rounded(ring, digits), lambda p: F.array(p["x"], p["y"]))))
    shape = lambda kind, at: F.to_json(F.struct(F.lit(kind).alias("type"), at.alias("coordinates")))
    geometry = F.when(F.size("_plain") == 1, shape("Polygon", F.get("_plain", 0))).when(F.size("_plain") > 1, shape("MultiPolygon", F.col("_plain"))).otherwise("null")
    thin = thin.withColumn("_plain", plain)
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), geometry, F.lit("}"))
    return thin.withColumn("feature", feature).drop("_flat", "_plain")


# Nearest places, joins and windows.

CITIES = (("delhi", 28.61, 77.21), ("gurugram", 28.46, 77.03), ("noida", 28.57, 77.32), ("rohtak", 28.90, 76.61), ("meerut", 28.98, 77.71))
_CITY = ", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE)" for n, a, o in CITIES)


@query("J11_nearest_city", f"SELECT event_id, arg_min(city, km) AS city FROM (SELECT event_id, city, " + t.haversine_sql("f", "c").replace("6371.0088", "6371.0") + f" AS km FROM fires f, (VALUES {_CITY}) c(city, lat, lon)) GROUP BY 1", "fires")
def _(spark, d):
    """The cities are a short list, so each point works out its nearest one without a join."""
    parts = [F.struct(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(a), F.lit(o), 6371.0).alias("km"), F.lit(n).alias("city")) for n, a, o in CITIES]
    return t.fires(spark, d).select("event_id", F.array_min(F.array(*parts))["city"].alias("city"))


@query("J21_coordinates", "SELECT station, h, round(pm25, 6) AS pm25, lat, lon FROM obs JOIN (SELECT station, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon FROM (SELECT o.station, event_id, lat + event_id % 3 / 1000.0::DOUBLE AS lat, lon FROM obs_long o JOIN station USING (station)) GROUP BY 1) USING (station)", "obs station")
def _(spark, d):
    rows = t.obs_long(spark, d).join(t.station(spark), "station")
    first = rows.groupBy("station").agg(F.min_by(F.col("lat") + F.col("event_id") % 3 / F.lit(1000.0), "event_id").alias("lat"), F.min_by("lon", "event_id").alias("lon"))
    return t.obs_hour(spark, d).join(first, "station").select("station", "h", r6("pm25").alias("pm25"), "lat", "lon")


@query("P17_satellite", "SELECT station, h, no2_sat, CAST(NULL AS DOUBLE) AS aod550 FROM obs LEFT JOIN (SELECT CAST(floor(h / 24) AS BIGINT) AS day, round(avg(value), 6) AS no2_sat FROM obs_long WHERE parameter = 'no2' GROUP BY 1) s ON s.day = CAST(floor(h / 24) AS BIGINT)", "obs")
def _(spark, d):
    """City-day values of a satellite on each hour; a product that was not fetched is a null column."""
    day = F.floor(F.col("h") / 24).cast("long")
    sat = t.obs_long(spark, d).where("parameter = 'no2'").groupBy(day.alias("day")).agg(r6(F.avg("value")).alias("no2_sat"))
    return with_columns(t.obs_hour(spark, d).withColumn("day", day).join(sat, "day", "left"), ["no2_sat", "aod550"]).select("station", "h", "no2_sat", "aod550")


def with_columns(df: DataFrame, names: list[str], kind: str = "double") -> DataFrame:
    """``df`` with all named columns, those that it lacks being null."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


@query("P13_feature_matrix", "SELECT station, h, round(pm25, 6) AS pm25, wind_speed, CAST('nan' AS DOUBLE) AS blh_m FROM met", "met")
def _(spark, d):
    rows = t.with_meteo(t.obs_hour(spark, d)).withColumn("pm25", r6("pm25"))
    return matrix(rows, ["station", "h"], ["pm25", "wind_speed", "blh_m"])


def matrix(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """The named features in order, as doubles; an absent or null one is not a number, as models expect."""
    nan = F.lit(float("nan"))
    return rows.select(*key, *(F.coalesce(F.col(n).cast("double"), nan).alias(n) if n in rows.columns else nan.alias(n) for n in names))


@query("P10_complete_rows", "SELECT station, h, round(pm25, 6) AS pm25 FROM (SELECT station, h, pm25, lead(pm25, 24) OVER (PARTITION BY station ORDER BY h) AS target FROM series) WHERE pm25 IS NOT NULL AND target IS NOT NULL", "series")
def _(spark, d):
    s = rel.hourly_spine(t.obs_hour(spark, d), "station").withColumn("target", F.lead("pm25", 24).over(Window.partitionBy("station").orderBy("h")))
    return s.dropna(subset=["pm25", "target"]).select("station", "h", r6("pm25").alias("pm25"))


@query("P6_time_range", "SELECT station, h FROM obs WHERE h > (SELECT max(h) FROM obs) - 24 AND h <= (SELECT max(h) FROM obs)", "obs")
def _(spark, d):
    return docs.recent(spark, d, 24).select("station", "h")


@query("W8_trailing_fires", "SELECT event_id, count(*) OVER w AS n, round(sum(frp) OVER w, 4) AS frp FROM (SELECT *, CAST(floor(lat * 10) AS BIGINT) AS band FROM fires) WINDOW w AS (PARTITION BY band ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)", "fires")
def _(spark, d):
    rows = t.fires(spark, d).withColumn("band", F.floor(F.col("lat") * 10))
    near = rel.trailing_totals(rows, ["band"], "s", "frp", 86_400)
    return rows.select("event_id", "band", "s").join(near, ["band", "s"]).select("event_id", "n", F.round("total", 4).alias("frp"))


@query("W12_recent_history", "SELECT ward_id, " + ", ".join(f"round(max(pm25) FILTER (WHERE ahead = {k}), 5) AS o{k}" for k in (0, 1, 6, 25)) + f" FROM (SELECT ward_id, (SELECT max(h) FROM obs) - h AS ahead, {docs._WEIGHTED.format('pm25')} AS pm25 FROM ward_km JOIN (SELECT * FROM obs WHERE h > (SELECT max(h) - 26 FROM obs)) USING (station) GROUP BY ward_id, h) GROUP BY 1", "obs ward_km")
def _(spark, d):
    rows = docs.recent(spark, d, 26).select("station", "pm25", (F.col("last") - F.col("h")).alias("ahead"))
    est = rows.join(docs.ward_km(spark, d), "station").groupBy("ward_id", "ahead").agg(docs.weighted("pm25").alias("pm25"))
    wide = est.groupBy("ward_id").pivot("ahead", [0, 1, 6, 25]).agg(F.max("pm25"))
    return wide.select("ward_id", *(F.round(F.col(str(k)), 5).alias(f"o{k}") for k in (0, 1, 6, 25)))


@query("D6_spatial_context", "SELECT a.station, a.h, round(sum(b.pm25 / pow(greatest(km, 0.05), 2)) / sum(CASE WHEN b.pm25 IS NOT NULL THEN 1 / pow(greatest(km, 0.05), 2) END), 6) AS idw, round(min(km), 6) AS nearest_km, count(*) AS n FROM obs a JOIN series b ON b.h = a.h AND b.station <> a.station JOIN (SELECT p.station AS x, q.station AS y, " + t.haversine_sql("p", "q") + " AS km FROM station p, station q) k ON k.x = a.station AND k.y = b.station GROUP BY 1, 2", "series station")
def _(spark, d):
    """Like the leave-one-out estimate, but stations without a value at that hour still count as near."""
    every = rel.hourly_spine(t.obs_hour(spark, d), "station")
    near = rel.surroundings(station_rows(spark, every), "station", "h", "pm25").where(F.col("pm25").isNotNull() & (F.size("others") > 0))
    return near.select("station", "h", r6(rel.weighted_others(0.05)).alias("idw"), r6(F.array_min(F.transform("others", lambda x: x["km"]))).alias("nearest_km"), F.size("others").cast("long").alias("n"))


@query("Q3_headline", "SELECT station, h, idx AS subindex24h, " + t.category_sql("idx") + f" AS category, 'PM2.5, mean of 24 hours' AS label FROM (SELECT station, h, {t.sub_index_sql('pm25', 'm')} AS idx FROM ({_A10}) WHERE m IS NOT NULL)", "series")
def _(spark, d):
    return mean24(spark, d).select("station", "h", aqi.headline(F.col("m")).alias("q")).where("q is not null").select("station", "h", "q.*")


@query("O1_ordered", "SELECT station, h, row_number() OVER (PARTITION BY station ORDER BY h) - 1 AS place FROM obs", "obs")
def _(spark, d):
    """In order of station and hour, numbered within each station: no task orders the whole table."""
    return t.obs_hour(spark, d).select("station", "h", (F.row_number().over(Window.partitionBy("station").orderBy("h")) - 1).alias("place"))


@query("O5_cluster_slice", "SELECT place, y, x FROM (SELECT row_number() OVER (ORDER BY frp DESC, y, x) AS place, y, x FROM (SELECT CAST(round_even(lat / 0.05, 0) AS BIGINT) AS y, CAST(round_even(lon / 0.05, 0) AS BIGINT) AS x, round(sum(frp), 4) AS frp FROM fires WHERE s > (SELECT max(s) - 259200 FROM fires) GROUP BY 1, 2)) WHERE place <= 5", "fires")
def _(spark, d):
    doc = docs.document(docs.fire_clusters(t.fires(spark, d)), "clusters")
    stored = doc.select(F.from_json("document", "clusters array<struct<place: int, y: bigint, x: bigint>>").alias("d"))
    return stored.select(F.explode(F.slice("d.clusters", 1, 5)).alias("c")).select("c.*")


@query("O6_brief_cap", "SELECT ward_id FROM enforcement WHERE place <= 6", "enforcement")
def _(spark, d):
    return docs.enforcement(spark, d).orderBy("place").limit(6).select("ward_id")


@query("O10_shift_order", "SELECT row_number() OVER (ORDER BY shift DESC) AS place, shift, coalesce(exposure, 0.0) AS exposure FROM (SELECT 0 AS shift, 0.0::DOUBLE AS exposure UNION ALL SELECT shift, round(exposure * abs(shift) / hours, 1) FROM (" + docs._TOTALS + "), season, (VALUES (-72), (-48), (-24)) s(shift))", "ledger")
def _(spark, d):
    base = spark.createDataFrame([(0, 0.0)], "shift int, exposure double")
    rows = base.unionByName(docs.counterfactuals(docs.totals(docs.ledger(spark, d)), docs.season(spark, d)).select("shift", "exposure"))
    return rows.select(F.row_number().over(Window.orderBy(F.desc("shift"))).alias("place"), "shift", "exposure")


# Displayed values.


@query("D22_diverging", "SELECT s_suppkey, round(x, 6) AS share, CASE WHEN x <= 0 THEN [CAST(floor(33 + (x + 1) * 207 + 0.5) AS INT), CAST(floor(102 + (x + 1) * 138 + 0.5) AS INT), CAST(floor(172 + (x + 1) * 68 + 0.5) AS INT)]::VARCHAR ELSE [CAST(floor(240 + x * -62 + 0.5) AS INT), CAST(floor(240 + x * -216 + 0.5) AS INT), CAST(floor(240 + x * -197 + 0.5) AS INT)]::VARCHAR END AS rgb FROM (SELECT s_suppkey, greatest(-1.0, least(1.0, s_acctbal / greatest(1.0, max(abs(s_acctbal)) OVER ()))) AS x FROM supplier)")
def _(spark, d):
    s = t.read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("v"))
    s = s.join(F.broadcast(s.agg(F.max(F.abs("v")).alias("top"))))
    rgb = F.concat(F.lit("["), F.array_join(display.diverging(F.col("v"), F.col("top")).cast("array<string>"), ", "), F.lit("]"))
    return s.select("s_suppkey", r6(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v") / F.greatest(F.lit(1.0), F.col("top"))))).alias("share"), rgb.alias("rgb"))


@query("D23_age", "SELECT event_id, CASE WHEN a < 0 THEN 'scheduled' WHEN a < 3600 THEN CASE WHEN greatest(1, floor(a / 60.0 + 0.5)) <= 1 THEN 'just now' ELSE CAST(CAST(floor(a / 60.0 + 0.5) AS BIGINT) AS VARCHAR) || 'm ago' END WHEN a < 86400 THEN CAST(CAST(floor(a / 3600.0 + 0.5) AS BIGINT) AS VARCHAR) || 'h ago' ELSE CAST(CAST(floor(a / 86400.0 + 0.5) AS BIGINT) AS VARCHAR) || 'd ago' END AS age, "
       "strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y, %-I:%M %p') || ' IST' AS shown FROM (SELECT event_id, ts, (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) - 60 - CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events)")
def _(spark, d):
    e = t.read(spark, d, "events").select("event_id", "ts", t.second_number(F.col("ts")).alias("s"))
    now = e.agg((F.max("s") - 60).alias("now"))
    return e.join(F.broadcast(now)).select("event_id", display.data_age(F.col("now") - F.col("s")).alias("age"), display.ist(F.col("ts")).alias("shown"))


_ABS = "CAST(floor(abs(v) + 0.5) AS BIGINT)"
_GROUPED = f"(CASE WHEN n >= 10000000 THEN (n // 10000000) || ',' || lpad(((n // 100000) % 100)::VARCHAR, 2, '0') || ',' || lpad(((n // 1000) % 100)::VARCHAR, 2, '0') || ',' || lpad((n % 1000)::VARCHAR, 3, '0') WHEN n >= 100000 THEN (n // 100000) || ',' || lpad(((n // 1000) % 100)::VARCHAR, 2, '0') || ',' || lpad((n % 1000)::VARCHAR, 3, '0') WHEN n >= 1000 THEN (n // 1000) || ',' || lpad((n % 1000)::VARCHAR, 3, '0') ELSE n::VARCHAR END)"


@query("X18_numbers", f"SELECT o_orderkey, {_GROUPED} AS shown, '+' || {_GROUPED} AS signed, {_GROUPED} || ' to ' || {_GROUPED} AS interval FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 37 + 1) AS BIGINT) AS n FROM orders)")
def _(spark, d):
    n = F.floor(F.col("o_totalprice") * 37 + 1).cast("double")
    return t.read(spark, d, "orders").select("o_orderkey", display.number(n).alias("shown"), display.signed(n, 0).alias("signed"), display.interval(n, n).alias("interval"))


@query("X5_href", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE url END AS href FROM pages WHERE url LIKE 'http%'")
def _(spark, d):
    p = t.read(spark, d, "pages").where("url like 'http%'")
    return p.select("page_id", display.safe_href(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("javascript:"), F.col("url"))).otherwise(F.col("url"))).alias("href"))


@query("X13_thinking", "SELECT conv_id, turn, CASE WHEN contains(x, '</think>') THEN length(split_part(x, '</think>', 1)) ELSE 0 END AS thought, CASE WHEN contains(x, '</think>') THEN trim(substr(x, strpos(x, '</think>') + 8)) ELSE trim(x) END AS answer FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE 'first </think> ' END || coalesce(text, '') || CASE WHEN turn % 3 = 1 THEN ' </think> end' ELSE '' END AS x FROM conversations)")
def _(spark, d):
    third = F.col("turn") % 3
    x = F.concat(F.when(third == 0, "").otherwise("first </think> "), F.coalesce("text", F.lit("")), F.when(third == 1, " </think> end").otherwise(""))
    return t.read(spark, d, "conversations").select("conv_id", "turn", text.thinking(x).alias("s")).select("conv_id", "turn", F.length("s.thought").cast("long").alias("thought"), "s.answer")


@query("X15_redaction", "SELECT event_id, event_type, '***' AS token, CASE WHEN event_id % 2 = 0 THEN '***' ELSE NULL END AS apikey FROM events")
def _(spark, d):
    e = t.read(spark, d, "events")
    event = F.map_concat(F.create_map(F.lit("type"), F.col("event_type"), F.lit("Access_Token"), F.lit("abc")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x-api-key"), F.lit("k"))).otherwise(F.create_map(F.lit("kind"), F.lit("none"))))
    shown = e.select("event_id", display.redacted(event).alias("m"))
    return shown.select("event_id", F.col("m")["type"].alias("event_type"), F.col("m")["Access_Token"].alias("token"), F.try_element_at("m", F.lit("x-api-key")).alias("apikey"))


@query("X16_station_names", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN CAST(s_suppkey % 4 + 100 AS VARCHAR) END AS station_id FROM supplier")
def _(spark, d):
    known = F.create_map(*[F.lit(x) for kv in (("Anand Vihar", 100), ("Dwarka", 101), ("Rohini", 102)) for x in kv])
    name = F.get(F.array(*map(F.lit, ("Anand Vihar", "Dwarka", "Rohini", "Elsewhere"))), (F.col("s_suppkey") % 4).cast("int"))
    return t.read(spark, d, "supplier").select("s_suppkey", F.try_element_at(known, name).cast("string").alias("station_id"))


@query("X14_nested_prune", """SELECT event_id, '{"a":{' || CASE WHEN event_id % 2 = 0 THEN '"b":1' ELSE '' END || '},"n":null}' AS doc FROM events""")
def _(spark, d):
    """Nulls go at every depth but for the fields that must be there."""
    e = t.read(spark, d, "events")
    body = F.to_json(F.struct(F.struct(F.when(F.col("event_id") % 2 == 0, 1).alias("b"), F.lit(None).cast("string").alias("c")).alias("a")))
    return e.select("event_id", text.with_nulls(body, ["n"]).alias("doc"))
