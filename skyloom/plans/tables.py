"""Air-quality tables laid over the generic test tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATIONS = 12
EVENT_POLLUTANT = {"view": "pm25", "click": "pm10", "purchase": "no2", "signup": "so2", "error": "o3"}
SOUTH, WEST = 28.40, 76.83


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_number(ts: Column) -> Column:
    """Hours since 1970, whatever the session's time zone."""
    return F.floor(second_number(ts) / 3600).cast("long")


def second_number(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.date_trunc("SECOND", ts).cast("timestamp_ntz")).cast("long")


def station_lat(s: Column) -> Column:
    return F.lit(SOUTH) + (s * 37 % 49) / 100.0 + 0.005


def station_lon(s: Column) -> Column:
    return F.lit(WEST) + (s * 53 % 52) / 100.0 + 0.005


def obs_long(spark, d, stations: int = STATIONS) -> DataFrame:
    e = read(spark, d, "events")
    name = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_POLLUTANT.items()))
    return e.select((F.col("user_id") % stations).alias("station"), hour_number(F.col("ts")).alias("h"), name.alias("parameter"), "value", "event_id", second_number(F.col("ts")).alias("s"))


def obs_hour(spark, d, stations: int = STATIONS) -> DataFrame:
    """Hourly mean per station over all events. Partial sums are formed before the one shuffle."""
    return obs_long(spark, d, stations).groupBy("station", "h").agg(F.avg("value").alias("pm25"))


def station(spark) -> DataFrame:
    return spark.range(STATIONS).select(F.col("id").alias("station"), station_lat(F.col("id")).alias("lat"), station_lon(F.col("id")).alias("lon"))


def with_meteo(obs: DataFrame) -> DataFrame:
    return obs.withColumns({"wind_dir": ((F.col("station") * 47 + F.col("h") * 13) % 360).cast("double"), "wind_speed": (1 + (F.col("station") + F.col("h")) % 5).cast("double")})


def with_weather(rows: DataFrame) -> DataFrame:
    """All seven weather columns: what the wind's are, and four more made alike from station and hour."""
    s, h = F.col("station"), F.col("h")
    more = {"temp": 12 + (h * 7 + s * 3) % 22, "rh": 30 + (h * 11 + s * 5) % 65, "precip": F.when((h + s) % 17 == 0, 2.5).otherwise(0.0), "blh": 200 + (h * 29 + s * 101) % 1500}
    return with_meteo(rows).withColumns({k: v.cast("double") for k, v in more.items()})


def fires(spark, d) -> DataFrame:
    e = read(spark, d, "events").where("event_type = 'error'")
    return e.select("event_id", (28.0 + (F.col("event_id") * 7 % 130) / 100.0).alias("lat"), (76.3 + (F.col("event_id") * 11 % 150) / 100.0).alias("lon"), F.col("value").alias("frp"), second_number(F.col("ts")).alias("s"))


def wards(spark, d) -> DataFrame:
    """25 boxes of 0.1 degree in rows of five, with the customers of a nation as population."""
    people = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.count(F.lit(1)) * 100).cast("double").alias("population"))
    k = F.col("k")
    return (read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")).join(people, "k", "left")
            .select(F.concat(F.lit("delhi_"), F.lpad(k.cast("string"), 3, "0")).alias("ward_id"), k, (SOUTH + F.floor(k / 5) * 0.1).alias("y0"), (WEST + (k % 5) * 0.1).alias("x0"), F.coalesce("population", F.lit(0.0)).alias("population")))


#: Corners of a ward's polygon from its south-western corner on; it has a notch in the east.
RING = ((0.0013, 0.0017), (0.0987, 0.0123), (0.0871, 0.0557), (0.0979, 0.0991), (0.0203, 0.0883))


def rings(spark, d) -> DataFrame:
    """Wards with their polygon as a closed ring."""
    corners = [F.struct((F.col("x0") + F.lit(x)).alias("x"), (F.col("y0") + F.lit(y)).alias("y")) for x, y in (*RING, RING[0])]
    return wards(spark, d).withColumn("ring", F.array(*corners))


#: Further rings of a ward, from its south-western corner on: a hole, an island in it, and a part by itself in the west.
MORE_RINGS = (((0.0413, 0.0407), (0.0611, 0.0403), (0.0607, 0.0617), (0.0403, 0.0613)), ((0.0457, 0.0451), (0.0553, 0.0457), (0.0551, 0.0557)), ((0.0023, 0.0901), (0.0171, 0.0907), (0.0027, 0.0993)))


def areas(spark, d) -> DataFrame:
    """Wards with all their rings, each closed."""
    closed = lambda ring: F.array(*(F.struct((F.col("x0") + F.lit(x)).alias("x"), (F.col("y0") + F.lit(y)).alias("y")) for x, y in (*ring, ring[0])))
    return wards(spark, d).withColumn("rings", F.array(*(closed(r) for r in (RING, *MORE_RINGS))))


def ward_points(spark, d) -> DataFrame:
    """Wards with a point inside them."""
    return wards(spark, d).select("ward_id", "k", (F.col("y0") + 0.0512).alias("lat"), (F.col("x0") + 0.0487).alias("lon"), "population")


SQL = {
    "area_edges": "SELECT ward_id, k, x0 + ax AS ax, y0 + ay AS ay, x0 + bx AS bx, y0 + bz AS bz FROM wards, (VALUES " + ", ".join(
        f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for ring in (RING, *MORE_RINGS) for a, b in zip(ring, (*ring[1:], ring[0]), strict=True)) + ") e(ax, ay, bx, bz)",
    "edges": "SELECT ward_id, k, i, x0 + ax AS ax, y0 + ay AS ay, x0 + bx AS bx, y0 + bz AS bz FROM wards, (VALUES " + ", ".join(
        f"({i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (a, b) in enumerate(zip(RING, (*RING[1:], RING[0]), strict=True))) + ") e(i, ax, ay, bx, bz)",
    "wardpt": "SELECT ward_id, k, y0 + 0.0512::DOUBLE AS lat, x0 + 0.0487::DOUBLE AS lon, population FROM wards",
    "obs_long": "SELECT user_id % 12 AS station, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'so2' WHEN 'error' THEN 'o3' END AS parameter, value, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events",
    "obs": "SELECT station, h, avg(value) AS pm25 FROM obs_long GROUP BY 1, 2",
    "station": "SELECT i AS station, 28.40::DOUBLE + (i * 37 % 49) / 100.0::DOUBLE + 0.005::DOUBLE AS lat, 76.83::DOUBLE + (i * 53 % 52) / 100.0::DOUBLE + 0.005::DOUBLE AS lon FROM range(12) t(i)",
    "met": "SELECT *, CAST((station * 47 + h * 13) % 360 AS DOUBLE) AS wind_dir, CAST(1 + (station + h) % 5 AS DOUBLE) AS wind_speed FROM obs",
    "fires": "SELECT event_id, 28.0::DOUBLE + (event_id * 7 % 130) / 100.0::DOUBLE AS lat, 76.3::DOUBLE + (event_id * 11 % 150) / 100.0::DOUBLE AS lon, value AS frp, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE event_type = 'error'",
    "wards": "SELECT 'delhi_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS ward_id, CAST(n_nationkey AS BIGINT) AS k, 28.40::DOUBLE + floor(n_nationkey / 5) * 0.1::DOUBLE AS y0, 76.83::DOUBLE + (n_nationkey % 5) * 0.1::DOUBLE AS x0, coalesce(p, 0.0)::DOUBLE AS population FROM nation LEFT JOIN (SELECT c_nationkey, CAST(count(*) * 100 AS DOUBLE) AS p FROM customer GROUP BY 1) ON c_nationkey = n_nationkey",
    "spine": "SELECT station, unnest(range(lo, hi + 1)) AS h FROM (SELECT station, min(h) AS lo, max(h) AS hi FROM obs GROUP BY 1)",
    "series": "SELECT sp.station, sp.h, o.pm25 FROM spine sp LEFT JOIN obs o ON o.station = sp.station AND o.h = sp.h",
}


def haversine_sql(a: str, b: str) -> str:
    return (f"(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))")


def bearing_sql(a: str, b: str) -> str:
    d = f"radians({b}.lon - {a}.lon)"
    return f"fmod(degrees(atan2(sin({d}) * cos(radians({b}.lat)), cos(radians({a}.lat)) * sin(radians({b}.lat)) - sin(radians({a}.lat)) * cos(radians({b}.lat)) * cos({d}))) + 360.0, 360.0)"


def sub_index_sql(pollutant: str, v: str) -> str:
    from ..functions.aqi import BREAKPOINTS

    cases = " ".join(f"WHEN {v} <= {float(hi)} THEN CAST(round_even(({ilo} + greatest(0.0, {v} - {float(lo)}) / {float(hi - lo)} * {float(ihi - ilo)})::DOUBLE, 0) AS INTEGER)" for lo, hi, ilo, ihi in BREAKPOINTS[pollutant])
    return f"(CASE WHEN {v} IS NULL OR {v} < 0 THEN NULL {cases} ELSE 500 END)"


def category_sql(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= 50 THEN 'Good' WHEN {v} <= 100 THEN 'Satisfactory' WHEN {v} <= 200 THEN 'Moderate' WHEN {v} <= 300 THEN 'Poor' WHEN {v} <= 400 THEN 'Very Poor' ELSE 'Severe' END)"


#: What each table of SQL is made of.
NEEDED: dict[str, list[str]] = {"obs": ["obs_long"], "met": ["obs"], "spine": ["obs"], "series": ["spine"], "edges": ["wards"], "area_edges": ["wards"], "wardpt": ["wards"]}


def with_ctes(names: str, query: str) -> str:
    """The query behind the named tables and all that these need, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDED.get(n, ()):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + query
