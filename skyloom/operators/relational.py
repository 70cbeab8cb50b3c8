"""Join and window patterns that plain joins don't plan well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, shapes

#: Rows up to which places are sent to all tasks; beyond it they are looked up by cells.
BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> bool:
    """Whether ``df`` has so few rows: from the plan where it tells (a list, a range), else by counting up to the bound.

    Joins on keys need no such question: adaptive execution broadcasts a side by its real size, when that is known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):  # neither adds rows
        plan = plan.children().head()
    rows = plan.stats().rowCount()
    return int(rows.get()) <= BROADCAST_ROWS if rows.isDefined() else df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def trailing_join(probe: DataFrame, build: DataFrame, keys: list[str], at: str, then: str, width: int, how: str = "left") -> DataFrame:
    """Rows of ``build`` with ``at - width < then <= at`` for each probe row: an equi-join on buckets of the width, so
    that no nested loop is planned; each probe row has one bucket, each build row lies in two."""
    bucket = F.floor(F.col(then) / width)
    left = probe.withColumn("_b", F.floor(F.col(at) / width)).alias("p")
    right = build.withColumn("_b", F.explode(F.array(bucket, bucket + 1))).alias("q")
    on = F.expr(f"q.{then} <= p.{at} AND q.{then} > p.{at} - {width}")
    for k in (*keys, "_b"):
        on = on & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    out = left.join(right, on, how)
    return out.select(*(F.col(f"p.{c}") for c in probe.columns), *(F.col(f"q.{c}") for c in build.columns if c not in keys))


#: Kilometres in a degree of latitude, at least; degrees of a cell of places.
DEGREE_KM, PLACE_CELL = 110.5, 0.25


def trailing_totals(rows: DataFrame, keys: list[str], at: str, value: str, width: int, parts: int = 24) -> DataFrame:
    """``keys, at, n, total``: for each distinct time (a whole number) of a key, how many rows lie in the ``width`` up to it
    (later than ``at - width``) and the sum of their values (null if they have none).

    The same as a range window, without a key's rows in one task: rows are first added up by time, within tasks too. A range is
    then the rest of the bucket in which it begins, the whole buckets between, and the beginning of its last one, so the
    windows hold one bucket's times, or a key's buckets. Nothing is subtracted. ``parts`` must divide ``width``; rows without a
    time are left out; null keys are keys of their own.
    """
    if width % parts:
        raise ValueError("parts must divide width")
    # Null keys meet, too: a key travels as one struct.
    step, key = width // parts, F.struct(*keys)
    times = rows.where(F.col(at).isNotNull()).groupBy(key.alias("_key"), F.col(at).cast("long").alias("_at")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    times = times.withColumn("_b", F.floor(F.col("_at") / step))
    spans = times.groupBy("_key", "_b").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    between = Window.partitionBy("_key").orderBy("_b").rangeBetween(1 - parts, -1)
    spans = spans.select("_key", "_b", F.sum("_n").over(between).alias("_mn"), F.sum("_v").over(between).alias("_mv"))
    # Each time asks, as a row of no weight, for what is later than it in the bucket where its range begins.
    asked = times.select("_key", (F.col("_at") - width).alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(None).cast("double").alias("_v"), (F.col("_b") - parts).alias("_b"), F.lit(True).alias("_asks"))
    both = times.withColumn("_asks", F.lit(False)).unionByName(asked)
    w = Window.partitionBy("_key", "_b").orderBy("_at")
    upto, later = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(1, Window.unboundedFollowing)
    ends = both.select("_key", "_b", "_at", "_asks", *(F.when(F.col("_asks"), F.sum(c).over(later)).otherwise(F.sum(c).over(upto)).alias(c) for c in ("_n", "_v")))
    ends = ends.select("_key", F.when(F.col("_asks"), F.col("_at") + width).otherwise(F.col("_at")).alias("_at"), F.when(F.col("_asks"), F.col("_b") + parts).otherwise(F.col("_b")).alias("_b"), "_n", "_v")
    summed = ends.groupBy("_key", "_b", "_at").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v")).join(spans, ["_key", "_b"])
    total = F.when(F.col("_v").isNotNull() | F.col("_mv").isNotNull(), F.coalesce("_v", F.lit(0.0)) + F.coalesce("_mv", F.lit(0.0)))
    return summed.select("_key.*", F.col("_at").alias(at), (F.coalesce("_n", F.lit(0)) + F.coalesce("_mn", F.lit(0))).alias("n"), total.alias("total"))


def within_km(points: DataFrame, places: DataFrame, km: float, lat: str = "lat", lon: str = "lon", place_lat: str = "place_lat", place_lon: str = "place_lon") -> DataFrame:
    """Points with the places that may lie within ``km``: places are dealt to the cells of one degree that their reach
    touches, so points meet them in an equi-join; the caller's exact condition stands behind it. Columns of both must differ."""
    tall = km / DEGREE_KM
    width = F.least(F.lit(180.0), F.try_divide(F.lit(tall), F.cos(F.radians(F.least(F.lit(90.0), F.abs(place_lat) + tall)))))
    cell = lambda c: F.floor(c).cast("int")
    span = lambda c, by: F.sequence(cell(F.col(c) - by), cell(F.col(c) + by))
    round_ = F.array_distinct(F.transform(span(place_lon, F.coalesce(width, F.lit(180.0))), lambda x: F.pmod(x + 180, F.lit(360)) - 180))
    dealt = places.withColumn("_x", F.explode(round_)).withColumn("_y", F.explode(span(place_lat, F.lit(tall))))
    at = {"_x": F.pmod(cell(F.col(lon)) + 180, F.lit(360)) - 180, "_y": cell(F.col(lat))}
    return points.withColumns(at).join(dealt, ["_x", "_y"]).drop("_x", "_y")


def nearest(points: DataFrame, places: DataFrame, point_key: list[str], order: str, within: float | None = None) -> DataFrame:
    """Each point's nearest place (the first in order of equals), with ``km``; points without a place are left out.

    Few places are sent to all tasks, and the best is kept by an aggregate that combines within each task, so that no pairs
    are shuffled. Many are looked up by cells in rings that grow until each point has found one no farther than its ring."""
    p = points.select(*point_key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    km = geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    best = F.min(F.struct(F.col("km"), F.col(order).alias(order))).alias("m")
    if few(places):
        pairs = p.join(F.broadcast(places), F.lit(True)).withColumn("km", km)
        pairs = pairs if within is None else pairs.where(F.col("km") < within)
        found = pairs.groupBy(*point_key).agg(best)
    else:
        found = _nearest_by_cells(p, places, point_key, best, km, within)
    return found.select(*point_key, F.col("m")[order].alias(order), F.col("m.km").alias("km"))


def _nearest_by_cells(p: DataFrame, places: DataFrame, point_key: list[str], best: Column, km: Column, within: float | None) -> DataFrame:
    """By rings of square cells: a place in a ring of ``r`` cells is surely the nearest if it is within ``r`` cells' least width.
    Rings double until all points are settled or the whole globe has been looked at."""
    cell = lambda c: F.floor(c / PLACE_CELL).cast("int")
    q = places.withColumns({"_x": cell(F.col("lon")), "_y": cell(F.col("lat"))})
    around = int(360 / PLACE_CELL)
    open_, out, ring = p, None, 1
    while True:
        whole = ring * PLACE_CELL >= 180
        span = F.sequence(F.lit(-ring), F.lit(ring))
        if whole:
            pairs = open_.join(q.drop("_x", "_y"), F.lit(True))
        else:
            look = open_.withColumn("_y", F.explode(F.transform(span, lambda k: cell(F.col("_lat")) + k))).withColumn("_x", F.explode(F.transform(span, lambda k: F.pmod(cell(F.col("_lon")) + k + around // 2, F.lit(around)) - around // 2)))
            pairs = look.join(q, ["_x", "_y"])
        pairs = pairs.withColumn("km", km)
        pairs = pairs if within is None else pairs.where(F.col("km") < within)
        got = pairs.groupBy(*point_key, "_lat", "_lon").agg(best)
        # Cells are narrower towards the poles; the least width of the ring's rows counts.
        width = ring * PLACE_CELL * DEGREE_KM * F.cos(F.radians(F.least(F.lit(90.0), F.abs("_lat") + ring * PLACE_CELL)))
        sure = F.lit(True) if whole else (F.col("m.km") <= width)
        settled = got.where(sure).select(*point_key, "m")
        out = settled if out is None else out.unionByName(settled)
        if whole:
            return out
        rest = open_.join(got.where(sure).select(*point_key), point_key, "left_anti")
        if within is not None:
            rest = rest.where(width < within)  # those whose ring covers the bound have nothing nearer
        if rest.isEmpty():
            return out
        open_, ring = rest, ring * 4


def idw(pairs: DataFrame, keys: list[str], km: str, value: str, order: str, power: int = 2, same_km: float = 0.05) -> DataFrame:
    """Inverse-distance weighting of (key, source) pairs: a source within ``same_km`` gives its own value, the first of several."""
    here = F.min(F.when((F.col(km) < same_km) & F.col(value).isNotNull(), F.struct(order, value)))
    w = F.when(F.col(value).isNotNull(), 1 / F.pow(F.greatest(F.col(km), F.lit(1e-9)), F.lit(power)))
    return pairs.groupBy(*keys).agg(F.coalesce(here[value], F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def surroundings(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row with ``others``: the other keys of its time with distance and value, array<struct<o, km, v>>. ``rows``: key, at,
    value, lat, lon. A time's keys are gathered once, as many as there are stations, and each key's others are made within
    that one row, so that neither pairs nor copies of the list become rows."""
    gathered = rows.groupBy(at).agg(F.collect_list(F.struct(F.col(key).alias("o"), F.col(value).alias("v"), "lat", "lon", F.cos(F.radians("lat")).alias("c"))).alias("_rs"))

    def others(me):
        def apart(x):
            return F.struct(x["o"].alias("o"), geo.haversine_km(me["lat"], me["lon"], x["lat"], x["lon"], cosines=me["c"] * x["c"]).alias("km"), x["v"].alias("v"))

        return F.struct(me["o"].alias(key), me["v"].alias(value), F.transform(F.filter("_rs", lambda x: x["o"] != me["o"]), apart).alias("others"))

    return gathered.select(at, F.inline(F.transform("_rs", others))).select(key, at, value, "others")


def weighted_others(least_km: float, power: int = 2) -> Column:
    """Inverse-distance mean of ``others`` that have a value."""
    there = F.filter("others", lambda x: x["v"].isNotNull())
    w = lambda x: 1 / F.pow(F.greatest(x["km"], F.lit(least_km)), F.lit(power))
    sums = F.aggregate(there, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda t, x: F.struct((t["a"] + x["v"] * w(x)).alias("a"), (t["b"] + w(x)).alias("b")), lambda t: F.try_divide(t["a"], t["b"]))
    return F.when(F.size(there) > 0, sums)


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, key: str, missing: Column) -> DataFrame:
    """The first box (by key) that holds each point strictly inside, else ``missing``: an equi-join on grid buckets."""
    inside = lambda c: (F.col("lon") > c["x0"]) & (F.col("lon") < c["x0"] + size) & (F.col("lat") > c["y0"]) & (F.col("lat") < c["y0"] + size)
    box = F.struct(F.col("x0").alias("west"), F.col("y0").alias("south"), (F.col("x0") + size).alias("east"), (F.col("y0") + size).alias("north"))
    return _first_holding(points, boxes.select(key, box.alias("_box"), F.struct(key, "x0", "y0").alias("_c")), size, key, missing, inside)


def points_in_rings(points: DataFrame, places: DataFrame, size: float, key: str, missing: Column, ring: str = "ring") -> DataFrame:
    """The first place (by key) whose closed ring holds each point strictly inside, else ``missing``: an equi-join on grid
    cells of ``size`` degrees, which each place has as many of as its bounds cover, with the exact test behind it."""
    inside = lambda c: geo.inside_ring(F.col("lon"), F.col("lat"), c[ring])
    return _first_holding(points, places.select(key, shapes.bounds(F.col(ring)).alias("_box"), F.struct(key, ring).alias("_c")), size, key, missing, inside)


#: Cells into which a cell on an area's edge is divided each way, and degrees by which cells are taken to be larger than they are.
PARTS, SLACK = 4, 1e-9


def area_cover(places: DataFrame, size: float, key: str, rings: str = "rings") -> DataFrame:
    """Areas as cells: a row for each place and cell of ``size`` degrees that it meets, ``_x``, ``_y``, ``key`` and ``_subs``: the
    parts of the cell that are inside (``inner``) or on the edge, these with the edges that decide there. Parts outside are left
    out. ``rings``: closed rings of all outlines, holes and further parts."""
    q = size / PARTS
    reach = lambda c: F.transform(F.flatten(F.col(rings)), lambda p: p[c])
    cell = lambda v: F.floor(F.floor(v / q) / PARTS).cast("long")
    span = lambda c: F.explode(F.sequence(cell(F.array_min(reach(c)) - SLACK), cell(F.array_max(reach(c)) + SLACK)))
    rows = places.select(key, rings, F.flatten(F.transform(rings, shapes.edges)).alias("_edges")).withColumn("_x", span("x")).withColumn("_y", span("y"))
    low = lambda e, c: F.least(e["a"][c], e["b"][c])
    high = lambda e, c: F.greatest(e["a"][c], e["b"][c])

    def deciding(edges, x, y, width):
        """The edges that a ray to the east from the cell at ``x, y`` may meet."""
        return F.filter(edges, lambda e: (high(e, "y") >= y - SLACK) & (low(e, "y") <= y + width + SLACK) & (high(e, "x") >= x - SLACK))

    def part(edges, ix, iy, width):
        """struct<x, y, n, inner, edges> of the cell whose numbers are ``ix, iy`` in cells of ``q`` and that is ``width`` wide."""
        x, y = ix * q, iy * q
        return shapes.bound(deciding(edges, x, y, width), lambda own: F.struct(
            ix.alias("x"), iy.alias("y"), F.exists(own, lambda e: low(e, "x") <= x + width + SLACK).alias("mixed"), geo.inside_area(x + width / 2, y + width / 2, own).alias("inner"), own.alias("edges")))

    rows = rows.withColumn("_c", part(F.col("_edges"), F.col("_x") * PARTS, F.col("_y") * PARTS, size))
    steps = F.sequence(F.lit(0), F.lit(PARTS * PARTS - 1))
    subs = F.transform(steps, lambda k: part(F.col("_c.edges"), F.col("_x") * PARTS + k % PARTS, F.col("_y") * PARTS + F.floor(k / PARTS), q))
    kept = F.transform(F.filter(subs, lambda c: c["mixed"] | c["inner"]), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (~c["mixed"]).alias("inner"), F.when(c["mixed"], c["edges"]).alias("edges")))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(True).alias("inner"), F.lit(None).cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>").alias("edges")))
    return rows.select(key, "_x", "_y", F.when(F.col("_c.mixed"), kept).when(F.col("_c.inner"), whole).alias("_subs")).where(F.size("_subs") > 0)


def points_in_areas(points: DataFrame, places: DataFrame, size: float, key: str, missing: Column, rings: str = "rings") -> DataFrame:
    """The first place (by key) that holds each point strictly inside, else ``missing``. Places may have holes and several parts.
    Each cell has one list of what covers it: cells wholly inside decide without a test, those on an edge test few edges."""
    q = size / PARTS
    lists = area_cover(places, size, key, rings).groupBy("_x", "_y").agg(F.collect_list(F.struct(key, "_subs")).alias("_cs"))
    at = {"_ix": F.floor(F.col("lon") / q).cast("long"), "_iy": F.floor(F.col("lat") / q).cast("long")}
    met = points.withColumns(at).withColumns({"_x": F.floor(F.col("_ix") / PARTS).cast("long"), "_y": F.floor(F.col("_iy") / PARTS).cast("long")}).join(lists, ["_x", "_y"], "left")
    here = lambda s: s["x"].isNull() | ((s["x"] == F.col("_ix")) & (s["y"] == F.col("_iy")))
    holds = lambda c: F.exists(c["_subs"], lambda s: F.when(~here(s), False).when(s["inner"], True).otherwise(geo.inside_area(F.col("lon"), F.col("lat"), s["edges"])))
    first = F.array_min(F.transform(F.filter("_cs", holds), lambda c: c[key]))
    return met.withColumn(key, F.coalesce(first, missing)).drop("_x", "_y", "_ix", "_iy", "_cs")


def _first_holding(points: DataFrame, places: DataFrame, size: float, key: str, missing: Column, inside) -> DataFrame:
    """Each grid cell has the list of places over it, so that a point meets one row and is never multiplied or shuffled twice."""
    cell = lambda c: F.floor(c / size)
    cells = places.withColumn("_x", F.explode(F.sequence(cell(F.col("_box.west")), cell(F.col("_box.east"))))).withColumn("_y", F.explode(F.sequence(cell(F.col("_box.south")), cell(F.col("_box.north")))))
    lists = cells.groupBy("_x", "_y").agg(F.collect_list("_c").alias("_cs"))
    hits = points.withColumns({"_x": cell(F.col("lon")), "_y": cell(F.col("lat"))}).join(lists, ["_x", "_y"], "left")
    first = F.array_min(F.transform(F.filter("_cs", inside), lambda c: c[key]))
    return hits.withColumn(key, F.coalesce(first, missing)).drop("_x", "_y", "_cs")


#: Ranges of values that a key's ranks are looked for in.
RANGES = 4096


def at_ranks(df: DataFrame, key: str, value: str, ranks) -> DataFrame:
    """``key, n, rank, value``: each key's values at the ranks (from 0) that ``ranks`` gives for its number of values, an array
    column. First the range of values that holds a rank is found from counts, then the rank in this range from counts of
    its distinct values, so no key's values are ever sorted or held together."""
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    span = rows.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("n"))
    place = F.coalesce(F.least(F.lit(RANGES - 1), F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * RANGES, F.col("_hi") - F.col("_lo")))), F.lit(0)).cast("int")
    dealt = rows.join(span, key).select(key, "_v", place.alias("_b"))
    by = Window.partitionBy(key).orderBy("_b")  # RANGES rows a key at most
    counts = dealt.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_end", F.sum("_c").over(by))
    wanted = span.select(key, "n", F.explode(ranks(F.col("n"))).alias("rank"))
    hit = counts.join(wanted, key).where((F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("_c"))).select(key, "n", "rank", "_b", (F.col("_end") - F.col("_c")).alias("_before"))
    inside = dealt.join(hit, [key, "_b"]).groupBy(key, "n", "rank", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(key, "rank").orderBy("_v"))
    return inside.withColumn("_end", end).where("_end > rank and _end - _c <= rank").select(key, "n", "rank", F.col("_v").alias("value"))


def quantiles(df: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """``key, name``: each key's exact quantile, between the two nearest values in proportion."""
    at = lambda n: (n - 1) * F.lit(float(share))
    got = at_ranks(df, key, value, lambda n: F.array_distinct(F.array(F.floor(at(n)), F.ceil(at(n)))))
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    n = F.first("n")
    return got.groupBy(key).agg((low + (high - low) * (at(n) - F.floor(at(n)))).alias(name))


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def hourly_spine(obs: DataFrame, key: str, hour: str = "h") -> DataFrame:
    """All hours of each key between its first and last, with what was observed."""
    span = obs.groupBy(key).agg(F.min(hour).alias("_lo"), F.max(hour).alias("_hi"))
    return span.select(key, F.explode(F.sequence("_lo", "_hi")).alias(hour)).join(obs, [key, hour], "left")


def guarded_mean(value: str, rows: int, least: int, key: str, hour: str = "h") -> Column:
    """Mean of the last ``rows`` rows of a spine, null with fewer than ``least`` values."""
    w = Window.partitionBy(key).orderBy(hour).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))
