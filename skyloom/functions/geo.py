"""Great-circle and grid functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in km, cell size in degrees, reach and half width of the upwind sector.
RADIUS_KM, CELL, REACH_KM, HALF_SECTOR = 6371.0088, 0.01, 100.0, 45.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM, cosines: Column | None = None) -> Column:
    """Great-circle distance; ``cosines``: the product of the latitudes' cosines, where it is at hand."""
    cosines = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) if cosines is None else cosines
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + cosines * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first to the second point, degrees clockwise from north."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def is_upwind(km: Column, towards: Column, wind_from: Column) -> Column:
    return (km <= REACH_KM) & (angle_between(towards, wind_from) <= HALF_SECTOR)


def cell_floor(v: Column) -> Column:
    """Index of the cell on an axis; multiples of the cell size fall in their own cell despite binary fractions."""
    return F.floor(F.bround(v / CELL, 6)).cast("long")


def cell_index(v: Column, low: float) -> Column:
    return cell_floor(v) - cell_floor(F.lit(low))


def cell_id(city: str, lat: Column, lon: Column, south: float, west: float) -> Column:
    return F.concat_ws("_", F.lit(city), cell_index(lat, south).cast("string"), cell_index(lon, west).cast("string"))


def in_range(b: Column, low: float, high: float) -> Column:
    """A bearing between two, over north if the first is larger."""
    return b.between(low, high) if low <= high else (b >= low) | (b <= high)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over a closed ring ``array<struct<x, y>>``, the boundary excluded."""
    n = F.size(ring) - 1
    return inside_area(x, y, F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def inside_area(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting over the edges ``array<struct<a, b>>`` of all rings of an area, outlines, holes and further parts alike: a point
    is inside if the ray to the east meets an odd number of them. The boundary is excluded."""
    def crossed(e):
        a, b = e["a"], e["b"]
        above = (a["y"] > y) != (b["y"] > y)
        return F.when(above, x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)

    def touched(e):
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return (F.size(F.filter(edges, crossed)) % 2 == 1) & ~F.exists(edges, touched)
