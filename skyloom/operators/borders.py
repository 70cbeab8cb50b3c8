"""Thinning of areas that border on one another: a border is thinned once for both sides, and nothing comes to cross.

Borders are cut where they part (places with other than two neighbours) into arcs. Between two such places a border can run on
in one way only, so its first two places name an arc. An arc is thinned by splitting at the place farthest from the chord; a
piece becomes its chord if its places lie within the tolerance and the rectangle along the chord that holds them holds no other
place of any border. Such a rectangle is convex, so a line that crossed the chord would have to end in it: no two chords cross,
however their neighbours are thinned, and no further round is needed. Chords with the same two ends get one more place each,
so that no part collapses.

Only places near an arc travel to it (within twice the tolerance, met by cells); what one task holds is one arc or one ring.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import shapes

#: A cell's width, in tolerances, and how far from an arc other places matter.
CELLS, MARGIN = 64, 2.01


@F.pandas_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in ("lo", "hi", "mid")])))
def _chords(xs: pd.Series, ys: pd.Series, near_x: pd.Series, near_y: pd.Series, tolerance: pd.Series) -> pd.Series:
    """The chords that an arc becomes, each with the place between that is farthest from it (-1: none)."""
    return pd.Series([_of_arc(*row) for row in zip(xs, ys, near_x, near_y, tolerance, strict=True)])


def _of_arc(xs, ys, near_x, near_y, most) -> list[dict]:
    own = np.column_stack([xs, ys]).astype(float)
    known = set(map(tuple, own))
    near = [] if near_x is None else [p for p in zip(near_x, near_y, strict=True) if p not in known]
    others = np.array(near, float).reshape(-1, 2)
    out, open_ = [], [(0, len(own) - 1)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            out.append({"lo": lo, "hi": hi, "mid": -1})
            continue
        way = own[hi] - own[lo]
        size = float(np.hypot(*way))
        # Places in the chord's own directions: along it and across; of a closed arc there are none, only distances.
        axes = np.array([way, [-way[1], way[0]]]).T / size if size else np.eye(2)
        part = (own[lo:hi + 1] - own[lo]) @ axes
        off = np.hypot(part[1:-1, 0] - np.clip(part[1:-1, 0], 0, size), part[1:-1, 1])
        mid = lo + 1 + int(off.argmax())
        if size and off.max() <= most:
            rest = np.concatenate([own[:lo], own[hi + 1:], others])
            rest = rest[(rest != own[lo]).any(axis=1) & (rest != own[hi]).any(axis=1)]
            at = (rest - own[lo]) @ axes
            if not ((at >= part.min(axis=0)) & (at <= part.max(axis=0))).all(axis=1).any():
                out.append({"lo": lo, "hi": hi, "mid": mid})
                continue
        open_ += [(lo, mid), (mid, hi)]
    return out


def _arcs(ring: Column, forks: Column) -> Column:
    """An open ring cut at the given indices, or at its smallest place: array<array<point>>, in order around it."""
    start = F.when(F.size(forks) > 0, F.get(forks, 0)).otherwise(F.array_position(ring, F.array_min(ring)).cast("int") - 1)

    def cut(s):
        turned = F.concat(F.slice(ring, s + 1, F.size(ring)), F.slice(ring, 1, s), F.slice(ring, s + 1, 1))
        cuts = F.concat(F.when(F.size(forks) > 0, F.transform(forks, lambda f: f - s)).otherwise(F.array(F.lit(0))), F.array(F.size(ring)))
        return shapes.bound(cuts, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.slice(turned, a + 1, b - a + 1)))

    return shapes.bound(start, cut)


def _turn(arc: Column) -> Column:
    """Whether an arc runs from its greater end, or (closed) by its greater second place first."""
    first, last, second, before = F.get(arc, 0), F.element_at(arc, -1), F.get(arc, 1), F.element_at(arc, -2)
    return (first > last) | ((first == last) & (second > before))


def thinned(places: DataFrame, key: str, tolerance: float, rings: str = "rings") -> DataFrame:
    """``places`` with their ``rings`` (array of closed rings ``array<struct<x, y>>``) thinned by ``tolerance``, neighbours alike.

    ``key`` names each place. Borders must be drawn with the same places on both sides and must not cross; a place that
    lies within another's edge without being one of its corners is no common corner. Rings begin where borders part. A place
    without rings, or with null, stays as it is; empty rings stay empty; a ring keeps three corners or what it has.
    """
    flat = places.select(key, F.posexplode(rings).alias("_r", "_closed"))
    steps = F.filter(shapes.edges(F.col("_closed")), lambda e: e["a"] != e["b"])
    flat = flat.select(key, "_r", F.when(F.size(steps) > 0, F.transform(steps, lambda e: e["a"])).otherwise(F.slice("_closed", 1, 1)).alias("_ring"))
    at = flat.select(key, "_r", F.posexplode("_ring").alias("_i", "_p"), F.size("_ring").alias("_n"), "_ring")
    around = F.array(F.get("_ring", F.pmod(F.col("_i") + 1, "_n")), F.get("_ring", F.pmod(F.col("_i") - 1, "_n")))
    ways = at.select("_p", F.explode(around).alias("_to")).distinct()
    forks = ways.groupBy("_p").agg(F.count(F.lit(1)).alias("_ways")).where("_ways <> 2").select("_p")
    met = at.select(key, "_r", "_i", "_p").join(forks, "_p").groupBy(key, "_r").agg(F.array_sort(F.collect_list("_i")).alias("_forks"))
    none = F.array().cast("array<int>")
    cut = flat.join(met, [key, "_r"], "left").where(F.size("_ring") > 0).select(key, "_r", F.posexplode(_arcs(F.col("_ring"), F.coalesce("_forks", none))).alias("_o", "_arc"))
    used = cut.withColumn("_turned", _turn(F.col("_arc"))).withColumn("_arc", F.when(F.col("_turned"), F.reverse("_arc")).otherwise(F.col("_arc")))
    used = used.withColumn("_a", F.get("_arc", 0)).withColumn("_b", F.get("_arc", 1))
    slim = _thin_arcs(used.groupBy("_a", "_b").agg(F.any_value("_arc").alias("_arc")), tolerance)
    sides = used.select(key, "_r", "_o", "_turned", "_a", "_b").join(slim, ["_a", "_b"])
    side = F.when(F.col("_turned"), F.reverse("_line")).otherwise(F.col("_line"))
    whole = sides.groupBy(key, "_r").agg(F.array_sort(F.collect_list(F.struct("_o", side.alias("_line")))).alias("_sides"))
    lines = F.flatten(F.transform("_sides", lambda s: F.slice(s["_line"], 1, F.size(s["_line"]) - 1)))
    closed = whole.select(key, "_r", shapes.bound(lines, lambda v: F.concat(v, F.slice(v, 1, 1))).alias("_ring"))
    every = flat.select(key, "_r").join(closed, [key, "_r"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "_ring"))).alias("_rings"))
    empty = F.filter(F.get(F.col(rings), 0), lambda p: F.lit(False))
    back = places.join(every, key, "left")
    return back.withColumn(rings, F.when(F.col("_rings").isNull(), F.col(rings)).otherwise(F.transform("_rings", lambda r: F.coalesce(r["_ring"], empty)))).drop("_rings")


def _thin_arcs(arcs: DataFrame, tolerance: float) -> DataFrame:
    """``_a, _b, _line`` of distinct arcs."""
    cell, margin = CELLS * tolerance, MARGIN * tolerance
    corners = arcs.select(F.explode("_arc").alias("_p")).distinct()
    corners = corners.select("_p", *(F.floor(F.col(f"_p.{c}") / cell).alias(f"_c{c}") for c in "xy"))
    pieces = arcs.where(F.size("_arc") > 2).select("_a", "_b", F.explode(shapes.edges(F.col("_arc"))).alias("_e"))
    dx, dy = F.col("_e.b.x") - F.col("_e.a.x"), F.col("_e.b.y") - F.col("_e.a.y")
    parts = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / cell), F.lit(1)).cast("int")
    pieces = pieces.select("_a", "_b", F.col("_e.a.x").alias("_x"), F.col("_e.a.y").alias("_y"), (dx / parts).alias("_dx"), (dy / parts).alias("_dy"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_k"))
    pieces = pieces.withColumn("_x", F.col("_x") + F.col("_dx") * F.col("_k")).withColumn("_y", F.col("_y") + F.col("_dy") * F.col("_k"))
    for c in "xy":
        lo, hi = F.least(F.col(f"_{c}"), F.col(f"_{c}") + F.col(f"_d{c}")) - margin, F.greatest(F.col(f"_{c}"), F.col(f"_{c}") + F.col(f"_d{c}")) + margin
        pieces = pieces.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    size = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    px, py = F.col("_p.x") - F.col("_x"), F.col("_p.y") - F.col("_y")
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(px * F.col("_dx") + py * F.col("_dy"), size), F.lit(0.0))))
    close = F.hypot(px - along * F.col("_dx"), py - along * F.col("_dy")) <= margin
    own = (F.col("_p") == F.col("_a")) | (F.col("_p") == F.col("_b"))
    near = pieces.join(corners, ["_cx", "_cy"]).where(close & ~own).groupBy("_a", "_b").agg(F.collect_set("_p").alias("_near"))
    given = arcs.join(near, ["_a", "_b"], "left")
    of = lambda line, c: F.transform(line, lambda p: p[c])
    chords = given.select("_a", "_b", "_arc", F.explode(_chords(of("_arc", "x"), of("_arc", "y"), of("_near", "x"), of("_near", "y"), F.lit(tolerance))).alias("_c"))
    chords = chords.select("_a", "_b", F.col("_c.lo").alias("_lo"), F.get("_arc", F.col("_c.lo")).alias("_from"), F.get("_arc", F.col("_c.hi")).alias("_to"), F.when(F.col("_c.mid") >= 0, F.get("_arc", F.col("_c.mid"))).alias("_mid"))
    ends = [F.least("_from", "_to").alias("_s"), F.greatest("_from", "_to").alias("_t")]
    twice = chords.groupBy(*ends).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_s", "_t", F.lit(True).alias("_twice"))
    chords = chords.withColumn("_s", ends[0]).withColumn("_t", ends[1]).join(twice, ["_s", "_t"], "left")
    kept = F.array_compact(F.array(F.col("_from"), F.when(F.col("_twice"), F.col("_mid"))))
    line = chords.groupBy("_a", "_b").agg(F.array_sort(F.collect_list(F.struct("_lo", kept.alias("_kept"), "_to"))).alias("_parts"))
    return line.select("_a", "_b", F.concat(F.flatten(F.transform("_parts", lambda p: p["_kept"])), F.array(F.element_at("_parts", -1)["_to"])).alias("_line"))
