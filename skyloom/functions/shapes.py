"""Plane geometry of rings and lines ``array<struct<x, y>>`` as Column expressions, and a helper where there is none."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Of the ellipsoid WGS 84: half axis in metres and flattening; scale on the central meridian of a UTM zone, its false easting.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def point(x, y) -> Column:
    return F.struct(F.lit(x).alias("x") if not isinstance(x, Column) else x.alias("x"), F.lit(y).alias("y") if not isinstance(y, Column) else y.alias("y"))


def edges(line: Column) -> Column:
    """The pieces of a line or closed ring: array<struct<a, b>>."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def cell_ring(south: Column, west: Column, i: Column, j: Column, size: float) -> Column:
    """A grid cell's corners from the south-western one on, closed."""
    y, x = south + i * size, west + j * size
    return F.array(point(x, y), point(x + size, y), point(x + size, y + size), point(x, y + size), point(x, y))


def bounds(ring: Column) -> Column:
    """struct<west, south, east, north>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def vertex_mean(ring: Column) -> Column:
    """Mean of all vertices, the closing one too."""
    return point(total(F.transform(ring, lambda p: p["x"])) / F.size(ring), total(F.transform(ring, lambda p: p["y"])) / F.size(ring))


def representative(ring: Column) -> Column:
    """A point inside: the middle of the widest piece of the line across the middle that lies inside."""
    def across(y):
        def at(e):
            a, b = e["a"], e["b"]
            return F.when((a["y"] > y) != (b["y"] > y), a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]))

        def widest(xs):
            pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1), lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), ((F.get(xs, 2 * i + 1) + F.get(xs, 2 * i)) / 2).alias("m")))
            return F.when(F.size(xs) >= 2, point(F.array_max(pairs)["m"], y))

        return bound(F.array_sort(F.array_compact(F.transform(edges(ring), at))), widest)

    return bound(bounds(ring), lambda b: bound((b["south"] + b["north"]) / 2, across))


def area(ring: Column) -> Column:
    """Of a ring, without its direction."""
    return F.abs(total(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def to_metres(ring: Column, lat: Column, lon: Column) -> Column:
    """Places near a point, as metres east and north of it."""
    k = F.lit(np.pi / 180 * 6371008.8)
    return F.transform(ring, lambda p: point((p["x"] - lon) * k * F.cos(F.radians(lat)), (p["y"] - lat) * k))


def length_in_circle(line: Column, radius: float) -> Column:
    """Length of the part of a line within a circle around the origin."""
    def part(e):
        a, b = e["a"], e["b"]

        def clipped(d):
            # |a + t (b - a)| <= radius between the roots of a quadratic, cut to the piece.
            half, disc = F.try_divide(d["ab"], d["l2"]), d["ab"] * d["ab"] - d["l2"] * (d["a2"] - radius * radius)
            root = F.try_divide(F.sqrt(F.greatest(disc, F.lit(0.0))), d["l2"])
            t0, t1 = F.greatest(F.lit(0.0), -half - root), F.least(F.lit(1.0), -half + root)
            return F.when((d["l2"] > 0) & (disc > 0) & (t1 > t0), (t1 - t0) * F.sqrt(d["l2"])).otherwise(0.0)

        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return bound(F.struct((dx * dx + dy * dy).alias("l2"), (a["x"] * dx + a["y"] * dy).alias("ab"), (a["x"] * a["x"] + a["y"] * a["y"]).alias("a2")), clipped)

    return total(F.transform(edges(line), part))


def area_in_circle(ring: Column, radius: float) -> Column:
    """Area of a ring within a circle around the origin: each edge gives triangles inside the circle and sectors outside."""
    r2 = radius * radius

    def sector(ax, ay, bx, by):
        return F.atan2(ax * by - ay * bx, ax * bx + ay * by) * (r2 / 2)

    def part(e):
        a, b = e["a"], e["b"]

        def pieces(d):
            half, disc = F.try_divide(d["ab"], d["l2"]), d["ab"] * d["ab"] - d["l2"] * (d["a2"] - r2)
            root = F.try_divide(F.sqrt(F.greatest(disc, F.lit(0.0))), d["l2"])
            t0, t1 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -half - root)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), -half + root))
            px, py, qx, qy = a["x"] + t0 * d["dx"], a["y"] + t0 * d["dy"], a["x"] + t1 * d["dx"], a["y"] + t1 * d["dy"]
            through = sector(a["x"], a["y"], px, py) + (px * qy - py * qx) / 2 + sector(qx, qy, b["x"], b["y"])
            return F.when((d["l2"] > 0) & (disc > 0) & (t1 > t0), through).otherwise(sector(a["x"], a["y"], b["x"], b["y"]))

        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return bound(F.struct(dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("l2"), (a["x"] * dx + a["y"] * dy).alias("ab"), (a["x"] * a["x"] + a["y"] * a["y"]).alias("a2")), pieces)

    return F.abs(total(F.transform(edges(ring), part)))


def distance_to_line(line: Column) -> Column:
    """From the origin to the nearest place of a line; null for an empty one."""
    def part(e):
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        l2 = dx * dx + dy * dy
        t = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(-(a["x"] * dx + a["y"] * dy), l2)))).otherwise(0.0)
        return F.hypot(a["x"] + t * dx, a["y"] + t * dy)

    return F.array_min(F.transform(edges(line), part))


def utm(lat: Column, lon: Column, zone: int) -> Column:
    """struct<x, y>: metres in a northern UTM zone, by the series in the third flattening to its third power (millimetres)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * np.sqrt(n) / (1 + n)
    away = F.radians(lon - (6 * zone - 183))

    def mapped(t):
        xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        north = xi + sum((F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) * a for j, a in enumerate(alpha)), F.lit(0.0))
        east = eta + sum((F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) * a for j, a in enumerate(alpha)), F.lit(0.0))
        return point(EASTING + SCALE * radius * east, SCALE * radius * north)

    s = F.sin(F.radians(lat))
    return bound(F.sinh(F.atanh(s) - e * F.atanh(e * s)), mapped)


def rounded(line: Column, digits: int) -> Column:
    return F.transform(line, lambda p: point(F.round(p["x"], digits), F.round(p["y"], digits)))


@F.pandas_udf(ArrayType(DoubleType()))
def _kept(xs: pd.Series, ys: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Places (x and y in turn) that stay when a line is thinned: those farther from the chord than the tolerance, and the ends."""
    def thin(x, y, most):
        x, y = np.asarray(x, float), np.asarray(y, float)
        keep, open_ = {0, len(x) - 1} if len(x) else set(), [(0, len(x) - 1)]
        while open_:
            lo, hi = open_.pop()
            if hi - lo < 2:
                continue
            dx, dy, px, py = x[hi] - x[lo], y[hi] - y[lo], x[lo + 1:hi] - x[lo], y[lo + 1:hi] - y[lo]
            size = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / size, 0, 1) if size else np.zeros(len(px))
            off = np.hypot(px - t * dx, py - t * dy)
            at = int(off.argmax())
            if off[at] > most:
                keep.add(lo + 1 + at)
                open_ += [(lo, lo + 1 + at), (lo + 1 + at, hi)]
        return [float(v) for i in sorted(keep) for v in (x[i], y[i])]

    return pd.Series([None if x is None else thin(x, y, m) for x, y, m in zip(xs, ys, tolerance, strict=True)])


def simplified(line: Column, tolerance: float) -> Column:
    """A line without the places that lie within the tolerance of it. Recursive, so there is no built-in form."""
    flat = _kept(F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"]), F.lit(tolerance))
    return bound(flat, lambda f: F.when(F.size(f) > 0, F.transform(F.sequence(F.lit(0), (F.size(f) / 2).cast("int") - 1), lambda i: point(F.get(f, 2 * i), F.get(f, 2 * i + 1)))).otherwise(F.slice(line, 1, 0)))


def projected(lon: Column, lat: Column, box: tuple[float, float, float, float], width: float, height: float, padding: float = 8) -> Column:
    """struct<x, y>: a place on a drawing that holds a box (west, south, east, north) whole and centred."""
    west, south, east, north = box
    k = np.cos(np.radians((south + north) / 2))
    w, h = (east - west) * k or 1e-6, (north - south) or 1e-6
    scale = min((width - 2 * padding) / w, (height - 2 * padding) / h)
    left, top = padding + (width - 2 * padding - w * scale) / 2, padding + (height - 2 * padding - h * scale) / 2
    return point(F.lit(left) + (lon - west) * k * scale, F.lit(top) + (F.lit(north) - lat) * scale)


def svg_path(line: Column, closed: bool = True) -> Column:
    """Drawing commands of a line of ``projected`` places."""
    steps = F.transform(line, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), F.format_string("%.1f %.1f", p["x"], p["y"])))
    return F.concat(F.array_join(steps, ""), F.lit("Z" if closed else ""))
