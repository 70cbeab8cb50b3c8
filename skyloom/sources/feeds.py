"""Readers of public feeds: long CSV archives, struct-of-arrays JSON, fire CSV, nested documents, polygons."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import nearest

ARCHIVE = "location_id long, sensors_id long, location string, datetime string, lat double, lon double, parameter string, units string, value string"
# Pollutants and the greatest values that are believed.
CAPS = {"pm25": 1500.0, "pm10": 3000.0, "no2": 1000.0, "so2": 1000.0, "o3": 1000.0, "co": 100.0}
METEO = {"wind_speed_10m": "wind_speed_10m", "wind_direction_10m": "wind_dir_10m", "temperature_2m": "temp_2m", "relative_humidity_2m": "rh_2m", "precipitation": "precip_mm", "boundary_layer_height": "blh_m"}
STAMPS = ("dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def believable(parameter: Column, value: Column) -> Column:
    """Null for negative values and those over the pollutant's cap."""
    cap = F.create_map(*[x for p, c in CAPS.items() for x in (F.lit(p), F.lit(c))])[parameter]
    return F.when((value >= 0) & (value <= cap), value)


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Hourly wide observations from an archive laid out as locationid=/year=/month=; partitions are pruned by filters on
    those columns. Floors to the hour after conversion to UTC."""
    return hourly_wide(spark.read.option("header", True).schema(ARCHIVE).csv(path))


def hourly_wide(raw: DataFrame) -> DataFrame:
    """A row a station and hour from long rows ``location_id, datetime, lat, lon, parameter, value``."""
    known = raw.where(F.col("parameter").isin(list(CAPS)))
    rows = known.select(F.col("location_id").cast("string").alias("station_id"), F.date_trunc("hour", F.try_to_timestamp("datetime")).alias("ts_utc"), "parameter",
                        believable(F.col("parameter"), F.col("value").try_cast("double")).alias("value"), "lat", "lon")
    where = rows.groupBy("station_id").agg(F.min_by("lat", "ts_utc").alias("lat"), F.min_by("lon", "ts_utc").alias("lon"))
    wide = rows.groupBy("station_id", "ts_utc").pivot("parameter", list(CAPS)).agg(F.avg("value"))
    return wide.join(where, "station_id")


def meteo(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an hourly struct of arrays; an absent variable is a null column."""
    fields = ", ".join(f"{k}: array<double>" for k in METEO)
    raw = spark.read.schema(f"latitude double, longitude double, hourly struct<time: array<string>, {fields}>").option("multiLine", True).json(path)
    return hourly_points(raw)


def hourly_points(raw: DataFrame) -> DataFrame:
    """A row a place and hour from places with a struct of arrays."""
    rows = raw.select("latitude", "longitude", F.explode(F.arrays_zip(F.col("hourly.time"), *(F.coalesce(F.col(f"hourly.{k}"), F.array().cast("array<double>")).alias(k) for k in METEO))).alias("r"))
    return rows.select("latitude", "longitude", F.try_to_timestamp("r.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts_utc"), *(F.col(f"r.{k}").alias(v) for k, v in METEO.items())).dropDuplicates(["latitude", "longitude", "ts_utc"])


def fires(spark: SparkSession, path: str) -> DataFrame:
    """Detections with a place and a time; other lines (a notice, say) are dropped."""
    raw = spark.read.option("header", True).csv(path)
    if not {"latitude", "longitude", "frp", "acq_date", "acq_time"} <= set(raw.columns):
        return spark.createDataFrame([], "lat double, lon double, frp double, acq_utc timestamp")
    return detections(raw)


def detections(raw: DataFrame) -> DataFrame:
    """Fires from text columns."""
    at = F.try_to_timestamp(F.concat("acq_date", F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-ddHHmm"))
    return raw.select(F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), F.col("frp").try_cast("double").alias("frp"), at.alias("acq_utc")).dropna(subset=["lat", "lon", "acq_utc"]).dropDuplicates()


def snapshot_time(text: Column) -> Column:
    """Three formats, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in STAMPS))


def ward_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Features of a collection with their properties as JSON, ``parts`` (each an outline and its holes) and ``rings``, all of them
    in one array, as the tests of areas take them."""
    raw = spark.read.option("multiLine", True).schema("features array<struct<properties: string, geometry: struct<type: string, coordinates: string>>>").json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.*").select("properties", "geometry.type", "geometry.coordinates")
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.transform(F.when(F.col("type") == "Polygon", one).otherwise(many), lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))))
    return f.select("properties", parts.alias("parts")).withColumn("rings", F.flatten("parts"))


def months(first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
    """All months from the first to the last, both included."""
    lo, hi = first[0] * 12 + first[1] - 1, last[0] * 12 + last[1] - 1
    return [(n // 12, n % 12 + 1) for n in range(lo, hi + 1)]


def discovered(sensors: DataFrame, station: str, parameter: str) -> DataFrame:
    """Stations with at least one known pollutant, and all that they measure, in order. A station has few sensors."""
    found = sensors.groupBy(station).agg(F.array_sort(F.collect_set(parameter)).alias("parameters"))
    return found.where(F.arrays_overlap("parameters", F.array(*map(F.lit, CAPS))))


def fetch_windows(span: DataFrame, days: int, cutoff: Column) -> DataFrame:
    """The requests that cover the days ``lo`` to ``hi``: archive products up to the cutoff, recent ones after it."""
    starts = span.select("hi", F.explode(F.sequence("lo", "hi", F.lit(days).cast("long"))).alias("first_day"))
    return starts.select("first_day", F.least(F.col("first_day") + days - 1, F.col("hi")).alias("last_day"), F.when(F.col("first_day") <= cutoff, "SP").otherwise("NRT").alias("source"))


def freshness(rows: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """Whether each key's last row is within some days of the last of all."""
    last = rows.groupBy(key).agg(F.max(at).alias("_l"))
    end = last.agg(F.max("_l").alias("_e"))
    return last.join(F.broadcast(end)).select(key, (F.col("_l") >= F.timestamp_add("DAY", F.lit(-days), F.col("_e"))).alias("fresh"))


def calendar(local: DataFrame) -> DataFrame:
    """``stage, start, end`` in local time as ``start_utc, end_utc``; an open end stays null."""
    utc = lambda c: F.timestamp_add("MINUTE", F.lit(-330), F.to_timestamp_ntz(F.col(c), F.lit("yyyy-MM-dd HH:mm")))
    return local.select("stage", utc("start").alias("start_utc"), utc("end").alias("end_utc"))


def cutoffs(products: DataFrame, lines: DataFrame, otherwise: str) -> DataFrame:
    """``product, cutoff``: the last day of each product's archive from lines ``id,first,last``, a constant where there is none."""
    parts = F.split("line", ",")
    known = lines.select(F.regexp_replace(parts[0], "_SP$", "").alias("product"), F.try_to_date(F.get(parts, 2)).alias("day")).where(F.col("line").rlike("^[A-Z0-9_]+_SP,") & F.col("day").isNotNull())
    best = known.groupBy("product").agg(F.max("day").alias("day"))
    return products.join(F.broadcast(best), "product", "left").select("product", F.coalesce("day", F.to_date(F.lit(otherwise))).alias("cutoff"))


SOURCES = ("openaq", "openmeteo", "firms", "cpcb", "osm", "wards")


def sources(spec: str) -> list[str]:
    """Names of a comma list, or all; an unknown name is an error."""
    if spec.strip() in ("", "all"):
        return list(SOURCES)
    names = list(dict.fromkeys(x.strip() for x in spec.split(",") if x.strip()))
    if unknown := [n for n in names if n not in SOURCES]:
        raise ValueError(f"unknown source {unknown[0]}")
    return names


def cached_months(spark: SparkSession, root: str, wanted: list[tuple[int, int]], current: tuple[int, int]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """What a store partitioned by year and month has of the wanted months, and those to fetch: the absent ones and always the
    current one, whose stored rows are left out."""
    stored = spark.read.parquet(root)
    have = {(r.year, r.month) for r in stored.select("year", "month").distinct().collect()}  # a row a month
    keep = [m for m in wanted if m in have and m != current]
    chosen = F.lit(False)
    for y, m in keep:
        chosen = chosen | ((F.col("year") == y) & (F.col("month") == m))
    return stored.where(chosen), [m for m in wanted if m not in keep]


def cities(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """Configurations (a JSON object a line) of a comma list of slugs, or of all."""
    every = spark.read.schema("slug string, tier string, bbox array<double>, languages struct<primary: array<string>, regional: string>").json(path)
    return every if wanted == "all" else every.where(F.col("slug").isin([x.strip() for x in wanted.split(",")]))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a seed file (one JSON array); an empty frame if there is none."""
    schema = "id long, name string, lat double, lon double, parameters array<string>"
    return spark.read.schema(schema).option("multiLine", True).option("ignoreMissingFiles", True).option("pathGlobFilter", "*.json").json(path)


def ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways of a map extract: ``id, tags, line, closed``; those named areas are closed by their first place, lines stay open."""
    raw = spark.read.option("multiLine", True).schema("elements array<struct<type: string, id: bigint, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>>>").json(path)
    e = raw.select(F.explode("elements").alias("e")).select("e.*").where("type = 'way' and size(geometry) >= 2")
    line = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    rows = e.select("id", "tags", line.alias("line"), (F.try_element_at("tags", F.lit("building")).isNotNull() | F.try_element_at("tags", F.lit("landuse")).isNotNull()).alias("closed"))
    is_ring = F.element_at("line", 1) == F.element_at("line", -1)
    return rows.withColumn("line", F.when(F.col("closed") & ~is_ring, F.concat("line", F.slice("line", 1, 1))).otherwise(F.col("line")))


def validated(texts: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """Adds ``data`` and ``error`` (``json`` or null): a body that is no JSON of the shape degrades to an error, not a failure."""
    parsed = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return texts.withColumn("data", parsed).withColumn("error", F.when(F.col(column).isNull() | F.col("data").isNull() | F.col("data._bad").isNotNull(), "json"))


def live(spark: SparkSession, path: str, sensors: DataFrame) -> DataFrame:
    """``station_id, ts_utc, parameter, value`` of the latest readings of a JSON answer; ``sensors``: sensor, parameter. The last
    reading of a sensor counts, values that nobody believes are null."""
    kind = "results array<struct<datetime: struct<utc: string>, value: double, sensorsId: bigint, locationsId: bigint>>"
    return latest(spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*"), sensors)


def latest(r: DataFrame, sensors: DataFrame) -> DataFrame:
    """The last believable reading of each sensor."""
    rows = r.select(F.col("sensorsId").alias("sensor"), F.col("locationsId").cast("string").alias("station_id"), F.date_trunc("hour", F.try_to_timestamp("datetime.utc")).alias("ts_utc"), "value").dropna(subset=["ts_utc"])
    last = rows.groupBy("sensor").agg(F.max_by(F.struct("station_id", "ts_utc", "value"), "ts_utc").alias("m")).select("sensor", "m.*")
    return last.join(sensors, "sensor").where(F.col("parameter").isin(list(CAPS))).select("station_id", "ts_utc", "parameter", believable(F.col("parameter"), F.col("value")).alias("value"))


#: Names of pollutants in the national snapshot.
SNAPSHOT_NAMES = {"PM2.5": "pm25", "PM10": "pm10", "NO2": "no2", "SO2": "so2", "OZONE": "o3", "CO": "co"}


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Wide rows ``station, ts_utc`` and pollutants of a national snapshot, whose times are local and whose values may say NA."""
    kind = "records array<struct<station: string, pollutant_id: string, avg_value: string, last_update: string>>"
    r = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")
    names = F.create_map(*[F.lit(x) for kv in SNAPSHOT_NAMES.items() for x in kv])
    name = F.try_element_at(names, F.upper(F.trim("pollutant_id")))
    rows = r.select("station", F.timestamp_add("MINUTE", F.lit(-330), snapshot_time(F.col("last_update"))).alias("ts_utc"), name.alias("parameter"), believable(name, F.col("avg_value").try_cast("double")).alias("value"))
    return rows.dropna(subset=["station", "ts_utc", "parameter"]).groupBy("station", "ts_utc").pivot("parameter", list(CAPS)).agg(F.avg("value"))


def matched_snapshot(records: DataFrame, stations: DataFrame, bbox: tuple[float, float, float, float], within: float = 1.0) -> DataFrame:
    """Wide rows ``station_id, ts_utc`` and pollutants of a snapshot's records (texts ``latitude, longitude, pollutant_id, avg_value,
    last_update``) in a box (west, south, east, north): each record counts for the nearest station within ``within`` km, others
    for none. ``stations``: station_id, lat, lon."""
    west, south, east, north = bbox
    r = records.select(F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), "pollutant_id", "avg_value", "last_update")
    r = r.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).withColumn("_place", F.concat_ws(" ", "lat", "lon"))
    near = nearest(r.select("_place", "lat", "lon").distinct(), stations, ["_place"], "station_id", within=within).select("_place", "station_id")
    names = F.create_map(*[F.lit(x) for kv in SNAPSHOT_NAMES.items() for x in kv])
    name = F.try_element_at(names, F.upper(F.trim("pollutant_id")))
    rows = r.join(near, "_place").select("station_id", F.timestamp_add("MINUTE", F.lit(-330), snapshot_time(F.col("last_update"))).alias("ts_utc"), name.alias("parameter"), believable(name, F.col("avg_value").try_cast("double")).alias("value"))
    return rows.dropna(subset=["ts_utc", "parameter"]).groupBy("station_id", "ts_utc").pivot("parameter", list(CAPS)).agg(F.avg("value"))


def backfilled(cached: DataFrame, daily: DataFrame, products: list[str], station: str = "station_id", day: str = "date") -> DataFrame:
    """A cache of satellite days by station (``products`` as columns) with the days of stations that it hasn't, pivoted from long
    rows ``station, day, product, value``; what is cached stays as it is."""
    new = daily.join(cached.select(station).distinct(), station, "left_anti")
    return cached.select(station, day, *products).unionByName(new.groupBy(station, day).pivot("product", products).agg(F.avg("value")))


def span(start: str, today: datetime.date) -> tuple[datetime.date, datetime.date]:
    """First and last day to fetch: from a given day to yesterday."""
    first, last = datetime.date.fromisoformat(start), today - datetime.timedelta(days=1)
    if first > last:
        raise ValueError(f"{start} is not before {today}")
    return first, last
