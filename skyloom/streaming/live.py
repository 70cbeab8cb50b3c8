"""A streaming face of the hourly tables: watermarked means and live rows merged into the store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import geo
from ..operators.relational import DEGREE_KM
from ..operators.staging import Steps


def hourly_means(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling hourly mean per station and pollutant; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "station", "parameter").agg(F.avg("value").alias("value")).select(F.col("window.start").alias("ts_utc"), "station", "parameter", "value")


def trailing_means(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Sliding 24-hour mean, each hour."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour"), "station").agg(F.avg("value").alias("value"), F.count("value").alias("n")).select(F.col("window.end").alias("ts_utc"), "station", "value", "n")


#: Hours of a mean and how many must have a value; hours by which a reading may be late; slots of a ring.
HOURS, LEAST, LATE = 24, 16, 24
SLOTS = HOURS + LATE


def advanced(hours: np.ndarray, values: np.ndarray, new: list[tuple[int, float]]) -> list[tuple[int, float | None, int]]:
    """Puts readings (hour, value or NaN) into a station's ring and gives the means that they change: ``(hour, mean, n)``.

    An hour has one slot, so a reading that comes again changes nothing, and a later one for the same hour replaces it. A
    reading may be up to ``LATE`` hours behind the newest; all hours whose window it lies in are worked out anew."""
    out: dict[int, tuple[float | None, int]] = {}
    latest = int(hours.max())
    for h, v in new:  # one after the other: a slot is only used anew when its hour can't matter any more
        if h <= latest - LATE:
            continue
        # An hour that is the newest closes those without a reading before it.
        for at in range(latest + 1, min(h, latest + HOURS)) if latest >= 0 else ():
            out[at] = _mean(hours, values, at)
        hours[h % SLOTS], values[h % SLOTS] = h, v
        latest = max(latest, h)
        for at in range(h, min(latest, h + HOURS - 1) + 1):
            out[at] = _mean(hours, values, at)
    return [(at, *out[at]) for at in sorted(out)]


def _mean(hours: np.ndarray, values: np.ndarray, at: int) -> tuple[float | None, int]:
    own = values[(hours > at - HOURS) & (hours <= at)]
    own = own[~np.isnan(own)]
    return (float(own.mean()) if len(own) >= LEAST else None), len(own)


class _Ring(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ring", "hours array<bigint>, vals array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.state.get()
        hours, values = (np.array(kept[0], np.int64), np.array(kept[1], float)) if kept else (np.full(SLOTS, -1), np.full(SLOTS, np.nan))
        new = [(int(h), np.nan if v is None else float(v)) for part in rows for h, v in zip(part["h"], part["value"], strict=True)]
        got = advanced(hours, values, new)
        self.state.update((hours.tolist(), values.tolist()))
        yield pd.DataFrame({"station": pd.Series([key[0]] * len(got), dtype=object), "h": [g[0] for g in got], "mean24": pd.Series([g[1] for g in got], dtype=float), "n": [g[2] for g in got]})

    def close(self) -> None:
        pass


def mean24(stream: DataFrame) -> DataFrame:
    """``station, h, mean24, n`` of the hours whose trailing 24-hour mean a batch changes; null with fewer than 16 values.

    ``stream``: ``station`` (string), ``h`` (hours since 1970), ``value``. A station's state is a ring of 48 hours, however long
    it reports. Needs the RocksDB state store. Write with :func:`replacing`, as an hour may come again."""
    rows = stream.select("station", F.col("h").cast("long").alias("h"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("station").transformWithStateInPandas(statefulProcessor=_Ring(), outputStructType="station string, h bigint, mean24 double, n bigint", outputMode="Update", timeMode="None")


def replacing(root: str, keys: list[str], partition: Column) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows replace those of the same keys under ``root``, and only partitions that a batch has are written
    anew. A batch that is tried again changes nothing. The last row of a key within a batch isn't told: give one."""
    def write(batch: DataFrame, number: int) -> None:
        spark, steps = batch.sparkSession, Steps(batch.sparkSession, "replacing")
        new = steps.staged(batch.withColumn("_part", partition.cast("string")))
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        whole = new
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            parts = [r[0] for r in new.select("_part").distinct().collect()]  # partitions of a batch
            old = spark.read.schema(new.schema).parquet(root).where(F.col("_part").isin(parts))
            whole = steps.staged(old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(root)
        if whole is not new:
            steps.dropped(whole)
        steps.dropped(new)

    return write


def upwind_fires(fires: DataFrame, weather: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each weather row with the fires of the last 24 hours upwind of its station, as an inner join of two streams on an interval.

    ``fires``: ``event_id, at, lat, lon, frp``; ``weather``: ``station, ts, lat, lon, wind_dir``. Both are kept only as long as the
    interval and the lateness ask. Fires meet stations by cells of one degree."""
    cell = lambda c: F.floor(c).cast("int")
    reach = geo.REACH_KM / DEGREE_KM
    f = fires.withWatermark("at", late).select("event_id", "at", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "frp", cell(F.col("lat")).alias("_y"), cell(F.col("lon")).alias("_x"))
    wide = F.lit(reach) / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + reach)))
    around = lambda c, by: F.explode(F.sequence(cell(F.col(c) - by), cell(F.col(c) + by)))
    w = weather.withWatermark("ts", late).withColumn("_wy", around("lat", F.lit(reach))).withColumn("_wx", around("lon", wide))
    when = (F.col("at") <= F.col("ts")) & (F.col("at") > F.col("ts") - F.expr("INTERVAL 24 HOURS"))
    met = w.join(f, (F.col("_wy") == F.col("_y")) & (F.col("_wx") == F.col("_x")) & when)
    here = (F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))
    return met.where(geo.is_upwind(geo.haversine_km(*here), geo.bearing(*here), F.col("wind_dir"))).select("station", "ts", "event_id", "frp")
