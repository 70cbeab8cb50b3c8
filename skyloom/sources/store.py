"""The hourly feature store: fixed columns, atomic replacement, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_query

# The columns of the store, in order.
COLUMNS = (
    ("ts_utc", "timestamp"), ("station_id", "string"), ("lat", "double"), ("lon", "double"), ("pm25", "double"), ("pm10", "double"), ("no2", "double"), ("so2", "double"), ("o3", "double"), ("co", "double"),
    ("wind_speed_10m", "double"), ("wind_dir_10m", "double"), ("temp_2m", "double"), ("rh_2m", "double"), ("precip_mm", "double"), ("blh_m", "double"),
    ("s5p_no2", "double"), ("s5p_so2", "double"), ("s5p_co", "double"), ("s5p_aai", "double"), ("aod550", "double"), ("frp_upwind", "double"), ("fire_count_upwind", "bigint"),
    ("road_density", "double"), ("builtup_frac", "double"), ("industrial_dist_km", "double"), ("ward_id", "string"),
)


def finalized(df: DataFrame) -> DataFrame:
    """All columns of the store, typed and in order: absent ones null, NaN null, the fire count 0."""
    out = []
    for name, kind in COLUMNS:
        c = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if kind == "double":
            c = F.when(~F.isnan(c), c)
        out.append((F.coalesce(c, F.lit(0)) if name == "fire_count_upwind" else c).alias(name))
    return df.select(*out)


def problems(df: DataFrame) -> list[str]:
    """What keeps a frame from being a store."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return [] if have == list(COLUMNS) else [f"column {a} should be {b}" for a, b in zip(have + [None] * len(COLUMNS), COLUMNS, strict=False) if a != b]


def live_over_archive(archive: DataFrame, live: DataFrame) -> DataFrame:
    """One row a station and hour; a live row replaces the archive's whole row."""
    both = archive.withColumn("_s", F.lit(0)).unionByName(live.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("station_id", "ts_utc").orderBy(F.desc("_s"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_s")


def write(df: DataFrame, path: str) -> None:
    """Writes a checked store partitioned by month, replacing only months that the frame has."""
    if bad := problems(df):
        raise ValueError("; ".join(bad[:3]))
    months = df.withColumn("month", F.date_format("ts_utc", "yyyy-MM")).repartition("month")
    months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def merged_lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last record of each source, its address without query."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    w = Window.partitionBy("source").orderBy(F.desc("_s"), F.desc("fetched_at"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_s").withColumn("base_url", strip_query(F.col("base_url")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store; filters on time and columns that are not asked for never leave the files."""
    return spark.read.parquet(path).select(*(n for n, _ in COLUMNS))


def enriched(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the columns of one source taken anew."""
    fresh = [c for c in new.columns if c not in keys]
    return base.drop(*fresh).join(new, keys, "left")


def patched(rows: DataFrame, values: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` (key, properties) with a value put into their JSON properties where there is one."""
    joined = rows.join(values.select(key, F.col(name).alias("_v")), key, "left")
    added = F.concat(F.substring("properties", F.lit(1), F.length("properties") - 1), F.when(F.col("properties") == "{}", "").otherwise(","), F.lit(f'"{name}":'), F.to_json(F.array("_v")).substr(F.lit(2), F.length(F.to_json(F.array("_v"))) - 2), F.lit("}"))
    return joined.withColumn("properties", F.when(F.col("_v").isNotNull(), added).otherwise(F.col("properties"))).drop("_v")


def manifest(files: DataFrame) -> DataFrame:
    """``city, files, fixture`` of listed files ``path, fixture`` (.../city/name): names by surface in order, and whether one is a stand-in."""
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("city"), F.element_at(parts, -1).alias("name"), "fixture")
    return named.groupBy("city").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.regexp_replace("name", r"\.[a-z]+$", "").alias("k"), F.col("name").alias("v"))))).alias("files"), F.bool_or("fixture").alias("fixture"))


def emit(rows: DataFrame, path: str) -> None:
    """Documents as compact JSON lines without nulls, in one file."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
