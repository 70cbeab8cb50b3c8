"""Registered queries of the air-quality operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aqi, domain, geo, text
from ..operators import events
from ..operators import relational as rel
from . import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = t.with_ctes(ctes, sql) if ctes else sql
        return f

    return add


def worst_hours(spark: SparkSession, sf_dir: str, stations: int = 2, k: int = 100) -> DataFrame:
    """The flagship query: the worst station-hours by the index of the trailing 24-hour mean, with their category."""
    return indexed(spark, sf_dir, stations).withColumn("category", aqi.category(F.col("idx"))).orderBy(F.desc("idx"), "station", "h").limit(k)


def r6(c):
    return F.round(c, 6)


# Scans, filters and projections.


@query("S_scan", "SELECT station, parameter, count(*) AS n FROM obs_long GROUP BY 1, 2", "obs_long")
def _(spark, d):
    return t.obs_long(spark, d).groupBy("station", "parameter").agg(F.count(F.lit(1)).alias("n"))


@query("P1_membership", "SELECT event_id, value FROM obs_long WHERE parameter IN ('pm25', 'pm10')", "obs_long")
def _(spark, d):
    return t.obs_long(spark, d).where(F.col("parameter").isin("pm25", "pm10")).select("event_id", "value")


@query("P2_clip", "SELECT event_id, CASE WHEN value >= 5 AND value <= CASE parameter WHEN 'pm25' THEN 400 WHEN 'pm10' THEN 450 ELSE 300 END THEN value END AS value FROM obs_long", "obs_long")
def _(spark, d):
    cap = F.coalesce(F.create_map(*map(F.lit, ("pm25", 400, "pm10", 450)))[F.col("parameter")], F.lit(300))
    return t.obs_long(spark, d).select("event_id", F.when(F.col("value").between(5, cap), F.col("value")).alias("value"))


@query("P4_coerce", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS v FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return t.read(spark, d, "events").select("event_id", raw.try_cast("double").alias("v"))


@query("P5_bbox", "SELECT event_id FROM fires WHERE lat BETWEEN 28.4 AND 28.9 AND lon BETWEEN 76.8 AND 77.3", "fires")
def _(spark, d):
    return t.fires(spark, d).where(F.col("lat").between(28.4, 28.9) & F.col("lon").between(76.8, 77.3)).select("event_id")


@query("P7_anti_range", "SELECT station, h, round(pm25, 6) AS pm25 FROM obs WHERE NOT (h >= 473600 AND h < 473700)", "obs")
def _(spark, d):
    return t.obs_hour(spark, d).where(~((F.col("h") >= 473600) & (F.col("h") < 473700))).select("station", "h", r6("pm25").alias("pm25"))


@query("P8_hour_sample", "SELECT station, o.h FROM obs o JOIN (SELECT h, row_number() OVER (ORDER BY h) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT h FROM obs)) k ON k.h = o.h WHERE (n - 1) % CAST(ceil(c / 100.0) AS BIGINT) = 0", "obs")
def _(spark, d):
    obs = t.obs_hour(spark, d)
    hours = obs.select("h").distinct()
    stride = F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / 100)
    kept = hours.withColumns({"n": F.row_number().over(Window.orderBy("h")), "stride": stride}).where("(n - 1) % stride = 0").select("h")
    return obs.join(kept, "h", "left_semi").select("station", "h")


@query("P14_missing", "SELECT station, h, CAST(pm25 IS NULL AS INTEGER) AS missing FROM series", "series")
def _(spark, d):
    return rel.hourly_spine(t.obs_hour(spark, d), "station").select("station", "h", F.col("pm25").isNull().cast("int").alias("missing"))


@query("P15_clip_quantiles", "SELECT event_id, greatest(value - 250, 0.0) AS p50, greatest(greatest(value - 250, 0.0), value / 4) AS p90 FROM events")
def _(spark, d):
    p50 = F.greatest(F.col("value") - 250, F.lit(0.0))
    return t.read(spark, d, "events").select("event_id", p50.alias("p50"), F.greatest(p50, F.col("value") / 4).alias("p90"))


# Aggregations.


@query("A1_hourly", "SELECT station, h, parameter, round(avg(value), 6) AS value FROM obs_long GROUP BY 1, 2, 3", "obs_long")
def _(spark, d):
    return t.obs_long(spark, d).groupBy("station", "h", "parameter").agg(r6(F.avg("value")).alias("value"))


@query("A2_pivot", "SELECT station, h, " + ", ".join(f"round(avg(value) FILTER (WHERE parameter = '{p}'), 6) AS {p}" for p in ("pm25", "pm10", "no2", "so2", "o3")) + ", CAST(NULL AS DOUBLE) AS co FROM obs_long GROUP BY 1, 2", "obs_long")
def _(spark, d):
    names = ["pm25", "pm10", "no2", "so2", "o3", "co"]
    wide = t.obs_long(spark, d).groupBy("station", "h").pivot("parameter", names).agg(F.avg("value"))
    return wide.select("station", "h", *(r6(n).alias(n) for n in names))


@query("A3_first", "SELECT station, arg_min(value, event_id) AS value FROM obs_long GROUP BY 1", "obs_long")
def _(spark, d):
    return t.obs_long(spark, d).groupBy("station").agg(F.min_by("value", "event_id").alias("value"))


@query("A4_median", "SELECT station, round(median(value), 6) AS value FROM obs_long GROUP BY 1", "obs_long")
def _(spark, d):
    return rel.quantiles(t.obs_long(spark, d), "station", "value", 0.5, "value").select("station", r6("value").alias("value"))


@query("A6_daily", "SELECT day, round(avg(v), 6) AS pm25 FROM (SELECT h, CAST(floor((h * 60 + 330) / 1440) AS BIGINT) AS day, avg(pm25) AS v FROM obs GROUP BY h) GROUP BY 1", "obs")
def _(spark, d):
    city = t.obs_hour(spark, d).groupBy("h").agg(F.avg("pm25").alias("v"))
    return city.groupBy(F.floor((F.col("h") * 60 + 330) / 1440).cast("long").alias("day")).agg(r6(F.avg("v")).alias("pm25"))


@query("A7_climatology", "SELECT CAST(floor((h * 60 + 330) / 60) % 24 AS BIGINT) AS hour, round(avg(pm25), 6) AS pm25 FROM obs GROUP BY 1", "obs")
def _(spark, d):
    return t.obs_hour(spark, d).groupBy((F.floor((F.col("h") * 60 + 330) / 60) % 24).cast("long").alias("hour")).agg(r6(F.avg("pm25")).alias("pm25"))


@query("A8_latest_covered", "SELECT coalesce((SELECT max(h) FROM (SELECT h FROM obs GROUP BY h HAVING count(DISTINCT station) >= 2)), (SELECT max(h) FROM obs)) AS h", "obs")
def _(spark, d):
    hours = t.obs_hour(spark, d).groupBy("h").agg(F.count_distinct("station").alias("n"))
    return hours.agg(F.coalesce(F.max(F.when(F.col("n") >= 2, F.col("h"))), F.max("h")).alias("h"))


@query("A9_trailing_mean", "SELECT station, round(avg(pm25), 6) AS pm25 FROM obs WHERE h > (SELECT max(h) - 24 FROM obs) GROUP BY 1", "obs")
def _(spark, d):
    obs = t.obs_hour(spark, d)
    last = obs.agg(F.max("h").alias("last"))
    return obs.join(F.broadcast(last), F.col("h") > F.col("last") - 24).groupBy("station").agg(r6(F.avg("pm25")).alias("pm25"))


_A10 = "SELECT station, h, CASE WHEN count(pm25) OVER w >= 16 THEN avg(pm25) OVER w END AS m FROM series WINDOW w AS (PARTITION BY station ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


def mean24(spark, d, stations: int = t.STATIONS):
    series = rel.hourly_spine(t.obs_hour(spark, d, stations), "station")
    return series.withColumn("m", rel.guarded_mean("pm25", 24, 16, "station"))


@query("A10_mean24h16", f"SELECT station, h, round(m, 6) AS mean24 FROM ({_A10})", "series")
def _(spark, d):
    return mean24(spark, d).select("station", "h", r6("m").alias("mean24"))


_CPF = """, thr AS (SELECT station, quantile_cont(pm25, 0.75) AS q FROM met GROUP BY 1), cpf AS (SELECT m.station, CAST(floor(wind_dir / 30) AS BIGINT) AS sector, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN pm25 > q THEN 1.0 ELSE 0.0 END) END AS p FROM met m JOIN thr USING (station) GROUP BY 1, 2)"""


def cpf(spark, d):
    # A station has as many rows here as there are hours, however many readings; the threshold is worked out where they lie.
    met = t.with_meteo(t.obs_hour(spark, d)).withColumn("q", F.percentile("pm25", 0.75).over(Window.partitionBy("station")))
    hot = F.avg((F.col("pm25") > F.col("q")).cast("double"))
    return met.groupBy("station", F.floor(F.col("wind_dir") / 30).cast("long").alias("sector")).agg(F.when(F.count(F.lit(1)) >= 10, hot).alias("p"))


@query("A11_cpf", t.with_ctes("met", "").rstrip() + _CPF + " SELECT station, sector, round(p, 6) AS p FROM cpf")
def _(spark, d):
    return cpf(spark, d).select("station", "sector", r6("p").alias("p"))


@query("A12_peak", t.with_ctes("met", "").rstrip() + _CPF + " SELECT station, CAST(sector * 30 + 15 AS DOUBLE) AS bearing FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY p DESC, sector) AS n FROM cpf WHERE p IS NOT NULL) WHERE n = 1")
def _(spark, d):
    return peaks(spark, d)


def peaks(spark, d):
    """Each station's direction of the strongest signal; stations without one are left out."""
    best = cpf(spark, d).where("p is not null").groupBy("station").agg(F.min(F.struct((-F.col("p")).alias("p"), "sector")).alias("m"))
    return best.select("station", (F.col("m.sector") * 30 + 15).cast("double").alias("bearing"))


@query("A13_fire_clusters", "SELECT CAST(round_even(lat / 0.05, 0) AS BIGINT) AS y, CAST(round_even(lon / 0.05, 0) AS BIGINT) AS x, count(*) AS n, round(sum(frp), 4) AS frp, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM fires WHERE s > (SELECT max(s) - 259200 FROM fires) GROUP BY 1, 2", "fires")
def _(spark, d):
    f = t.fires(spark, d)
    recent = f.join(F.broadcast(f.agg(F.max("s").alias("last"))), F.col("s") > F.col("last") - 72 * 3600)
    bin_ = lambda c: F.bround(F.col(c) / 0.05, 0).cast("long")
    return recent.groupBy(bin_("lat").alias("y"), bin_("lon").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("frp"), 4).alias("frp"), r6(F.avg("lat")).alias("lat"), r6(F.avg("lon")).alias("lon"))


@query("A14_errors", "SELECT round(sqrt(avg(pow(a - b, 2))), 6) AS rmse, round(avg(abs(a - b)), 6) AS mae, round(avg(greatest(0.9 * (a - b), -0.1 * (a - b))), 6) AS pinball FROM (SELECT pm25 AS a, lag(pm25) OVER (PARTITION BY station ORDER BY h) AS b FROM series) WHERE a IS NOT NULL AND b IS NOT NULL", "series")
def _(spark, d):
    s = rel.hourly_spine(t.obs_hour(spark, d), "station").select(F.col("pm25").alias("a"), F.lag("pm25").over(Window.partitionBy("station").orderBy("h")).alias("b")).dropna()
    e = F.col("a") - F.col("b")
    return s.agg(r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(F.abs(e))).alias("mae"), r6(F.avg(F.greatest(0.9 * e, -0.1 * e))).alias("pinball"))


def bucket(km):
    """The upper edge of a distance's bucket; null beyond the last one, which is labelled by the largest distance in it."""
    return F.when(km < 1.5, 1.5).when(km < 3, 3.0).when(km < 5, 5.0).when(km < 8, 8.0)


@query("A16_buckets", "SELECT coalesce(edge, round(far, 1)) AS upto, n, mean FROM (SELECT edge, max(v) AS far, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, v, CASE WHEN v < 1.5 THEN 1.5 WHEN v < 3 THEN 3.0 WHEN v < 5 THEN 5.0 WHEN v < 8 THEN 8.0 END::DOUBLE AS edge FROM (SELECT value, value / 40 AS v FROM events)) GROUP BY 1)")
def _(spark, d):
    v = F.col("value") / 40
    found = t.read(spark, d, "events").groupBy(bucket(v).alias("edge")).agg(F.max(v).alias("far"), F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))
    return found.select(F.coalesce("edge", F.round("far", 1)).alias("upto"), "n", "mean")


def numbered(spark, d):
    back = Window.partitionBy("station").orderBy(F.desc("h"))
    return t.obs_hour(spark, d).withColumns({"n": F.row_number().over(back), "c": F.count(F.lit(1)).over(Window.partitionBy("station"))})


_NUM = ", numbered AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY h DESC) AS n, count(*) OVER (PARTITION BY station) AS c FROM obs), daily AS (SELECT station, CAST(floor((n - 1) / 24) AS BIGINT) AS day, avg(pm25) AS m FROM numbered WHERE floor((n - 1) / 24) < floor(c / 24) GROUP BY 1, 2)"


@query("A17_exceedance", t.with_ctes("obs", "").rstrip() + _NUM + " SELECT station, round(avg(CASE WHEN pm25 > 60 THEN 100.0 ELSE 0.0 END), 4) AS exceedance_pct, coalesce(max(days), 0) AS persistence_days FROM numbered LEFT JOIN (SELECT station, count(*) AS days FROM daily WHERE m > 60 GROUP BY 1) USING (station) GROUP BY 1")
def _(spark, d):
    n = numbered(spark, d)
    blocks = n.where(F.floor((F.col("n") - 1) / 24) < F.floor(F.col("c") / 24)).groupBy("station", F.floor((F.col("n") - 1) / 24).alias("day")).agg(F.avg("pm25").alias("m"))
    days = blocks.groupBy("station").agg(F.count_if(F.col("m") > 60).alias("days"))
    share = n.groupBy("station").agg(F.round(F.avg(F.when(F.col("pm25") > 60, 100.0).otherwise(0.0)), 4).alias("exceedance_pct"))
    return share.join(days, "station", "left").select("station", "exceedance_pct", F.coalesce("days", F.lit(0)).alias("persistence_days"))


t.SQL["measures"] = "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'IV' WHEN '2-HIGH' THEN 'III' ELSE 'II' END AS stage, o_orderdate AS start, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(1 + o_orderkey % 9 AS INTEGER)) END AS stop FROM orders"


def measures(spark, d):
    """Orders as measures in force: a stage by priority, from the order's day on, without an end while it is pending."""
    o = t.read(spark, d, "orders")
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", "IV").when(F.col("o_orderpriority") == "2-HIGH", "III").otherwise("II")
    end = F.when(F.col("o_orderstatus") != "P", F.timestamp_add("DAY", (1 + F.col("o_orderkey") % 9).cast("int"), F.col("o_orderdate")))
    return o.select(F.col("o_orderkey").alias("id"), stage.alias("stage"), F.col("o_orderdate").alias("start"), end.alias("stop"))


@query("A21_active_hours", "SELECT greatest(sum(epoch(stop) - epoch(start)) / 3600, 24.0)::DOUBLE AS hours FROM measures WHERE stage IN ('III', 'IV') AND stop IS NOT NULL", "measures")
def _(spark, d):
    return events.active_hours(measures(spark, d).withColumnRenamed("stop", "end"))


def calendar(spark):
    return spark.createDataFrame([("III", 473400, 473500), ("IV", 473450, 473520), ("II", 473000, 473900), ("IV", 473600, None)], "stage string, lo long, hi long")


_IDX = "SELECT station, h, " + t.sub_index_sql("pm25", "m") + f" AS idx FROM ({_A10}) WHERE m IS NOT NULL"


def indexed(spark, d, stations: int = t.STATIONS):
    return mean24(spark, d, stations).where("m is not null").select("station", "h", aqi.sub_index("pm25", F.col("m")).alias("idx"))


@query("A23_summary", f"SELECT {t.category_sql('idx')} AS category, count(*) AS n, max(idx) AS worst FROM ({_IDX}) GROUP BY 1", "series")
def _(spark, d):
    return indexed(spark, d).groupBy(aqi.category(F.col("idx")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("worst"))


@query("A24_upper_median", "SELECT station, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS value FROM obs_long GROUP BY 1", "obs_long")
def _(spark, d):
    return rel.at_ranks(t.obs_long(spark, d), "station", "value", lambda n: F.array(F.floor(n / 2))).select("station", "value")


@query("A25_distinct", "SELECT h, count(DISTINCT station) AS stations FROM obs_long GROUP BY 1", "obs_long")
def _(spark, d):
    return t.obs_long(spark, d).groupBy("h").agg(F.count_distinct("station").alias("stations"))


# Windows and time series.


@query("W1_spine", "SELECT station, h, round(pm25, 6) AS pm25 FROM series", "series")
def _(spark, d):
    return rel.hourly_spine(t.obs_hour(spark, d), "station").select("station", "h", r6("pm25").alias("pm25"))


@query("W2_lags", "SELECT station, h, " + ", ".join(f"round(lag(pm25, {k}) OVER w, 6) AS lag{k}" for k in (1, 3, 6, 12, 24)) + ", round(lead(pm25, 24) OVER w, 6) AS lead24, round(pm25 - lag(pm25, 6) OVER w, 6) AS trend6 FROM series WINDOW w AS (PARTITION BY station ORDER BY h)", "series")
def _(spark, d):
    w = Window.partitionBy("station").orderBy("h")
    lags = {f"lag{k}": r6(F.lag("pm25", k).over(w)) for k in (1, 3, 6, 12, 24)}
    out = rel.hourly_spine(t.obs_hour(spark, d), "station").withColumns(lags | {"lead24": r6(F.lead("pm25", 24).over(w)), "trend6": r6(F.col("pm25") - F.lag("pm25", 6).over(w))})
    return out.drop("pm25")


@query("W4_roll24", "SELECT station, h, CASE WHEN count(pm25) OVER w >= 6 THEN round(avg(pm25) OVER w, 6) END AS roll24 FROM series WINDOW w AS (PARTITION BY station ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", "series")
def _(spark, d):
    return rel.hourly_spine(t.obs_hour(spark, d), "station").select("station", "h", r6(rel.guarded_mean("pm25", 24, 6, "station")).alias("roll24"))


@query("W6_keep_last", "SELECT user_id, h, event_id, value FROM (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, event_id, value, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) ORDER BY (event_type = 'view') DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    e = t.read(spark, d, "events").withColumn("h", t.hour_number(F.col("ts")))
    return rel.keep_last(e, ["user_id", "h"], (F.col("event_type") == "view").desc(), F.desc("event_id")).select("user_id", "h", "event_id", "value")


@query("W9_event_window", "SELECT day, round(avg(CASE WHEN h >= day * 24 AND h < day * 24 + 240 THEN pm25 END) - avg(CASE WHEN h >= day * 24 - 240 AND h < day * 24 THEN pm25 END), 6) AS effect FROM obs, (VALUES (19732), (19735), (19738)) v(day) WHERE h >= day * 24 - 240 AND h < day * 24 + 240 GROUP BY 1", "obs")
def _(spark, d):
    days = spark.createDataFrame([(19732,), (19735,), (19738,)], "day long")
    at, h = F.col("day") * 24, F.col("h")
    near = t.obs_hour(spark, d).join(F.broadcast(days), (h >= at - 240) & (h < at + 240))
    return near.groupBy("day").agg(r6(F.avg(F.when(h >= at, F.col("pm25"))) - F.avg(F.when(h < at, F.col("pm25")))).alias("effect"))


@query("W13_embargo_split", ", ".join(["WITH obs_long AS (" + t.SQL["obs_long"] + ")", "obs AS (" + t.SQL["obs"] + ")", "hs AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS n, count(*) OVER () AS c FROM (SELECT DISTINCT h FROM obs))", "cut AS (SELECT h AS cut_h FROM hs WHERE n = CAST(floor(c * 0.7::DOUBLE) AS BIGINT))"]) + " SELECT CASE WHEN h >= cut_h THEN 'test' WHEN h <= cut_h - 192 THEN 'train' ELSE 'embargo' END AS part, count(*) AS n FROM obs, cut GROUP BY 1")
def _(spark, d):
    obs = t.obs_hour(spark, d)
    hs = obs.select("h").distinct().withColumns({"n": F.row_number().over(Window.orderBy("h")) - 1, "c": F.count(F.lit(1)).over(Window.partitionBy())})
    cut = hs.where(F.col("n") == F.floor(F.col("c") * 0.7)).select(F.col("h").alias("at"))
    part = F.when(F.col("h") >= F.col("at"), "test").when(F.col("h") <= F.col("at") - 192, "train").otherwise("embargo")
    return obs.join(F.broadcast(cut)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


# Joins.


@query("J1_left_meteo", "SELECT o.station, o.h, round(o.pm25, 6) AS pm25, m.wind_dir FROM obs o LEFT JOIN (SELECT * FROM met WHERE wind_speed < 5) m ON m.station = o.station AND m.h = o.h", "obs met")
def _(spark, d):
    """Weather is missing where the instrument stopped in a storm."""
    obs = t.obs_hour(spark, d)
    met = t.with_meteo(obs).where("wind_speed < 5").select("station", "h", "wind_dir")
    return obs.join(met, ["station", "h"], "left").select("station", "h", r6("pm25").alias("pm25"), "wind_dir")


@query("J2_dimensions", "SELECT n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    n, r, s = (t.read(spark, d, x) for x in ("nation", "region", "supplier"))
    counts = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("suppliers"))
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).join(counts, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("J3_pip", "SELECT event_id, coalesce(min(ward_id), 'delhi_unassigned') AS ward_id FROM fires LEFT JOIN wards ON lon > x0 AND lon < x0 + 0.1 AND lat > y0 AND lat < y0 + 0.1 GROUP BY 1", "fires wards")
def _(spark, d):
    return rel.points_in_boxes(t.fires(spark, d).select("event_id", "lat", "lon"), t.wards(spark, d).select("ward_id", "x0", "y0"), 0.1, "ward_id", F.lit("delhi_unassigned")).select("event_id", "ward_id")


@query("J4_cells_in_wards", "SELECT ward_id, count(*) AS cells FROM (SELECT 28.40 + (i + 0.5) / 100.0 AS lat, 76.83 + (j + 0.5) / 100.0 AS lon FROM range(60) a(i), range(60) b(j)) c JOIN wards ON lon > x0 AND lon < x0 + 0.1 AND lat > y0 AND lat < y0 + 0.1 GROUP BY 1", "wards")
def _(spark, d):
    cells = spark.range(3600).select("id", (28.40 + (F.floor(F.col("id") / 60) + 0.5) / 100.0).alias("lat"), (76.83 + (F.col("id") % 60 + 0.5) / 100.0).alias("lon"))
    inside = rel.points_in_boxes(cells, t.wards(spark, d).select("ward_id", "x0", "y0"), 0.1, "ward_id", F.lit(None).cast("string")).where("ward_id is not null")
    return inside.groupBy("ward_id").agg(F.count(F.lit(1)).alias("cells"))


@query("J5_upwind", "SELECT m.station, m.h, coalesce(round(sum(frp), 4), 0.0) AS frp, count(f.event_id) AS n FROM met m JOIN station st USING (station) LEFT JOIN fires f ON f.s <= m.h * 3600 AND f.s > m.h * 3600 - 86400 AND " + t.haversine_sql("st", "f") + " <= 100 AND least(fmod(" + t.bearing_sql("st", "f") + " - wind_dir + 360, 360), 360 - fmod(" + t.bearing_sql("st", "f") + " - wind_dir + 360, 360)) <= 45 GROUP BY 1, 2", "met station fires")
def _(spark, d):
    st = t.station(spark)
    f = t.fires(spark, d)
    # Distance and bearing of each fire to the stations in reach are worked out once, before times meet.
    near = rel.within_km(f, st.select("station", F.col("lat").alias("sl"), F.col("lon").alias("so")), geo.REACH_KM, place_lat="sl", place_lon="so")
    near = near.select("station", "event_id", "frp", "s", geo.haversine_km(F.col("sl"), F.col("so"), F.col("lat"), F.col("lon")).alias("km"), geo.bearing(F.col("sl"), F.col("so"), F.col("lat"), F.col("lon")).alias("to")).where(F.col("km") <= geo.REACH_KM)
    met = t.with_meteo(t.obs_hour(spark, d)).select("station", "h", "wind_dir", (F.col("h") * 3600).alias("at"))
    hits = rel.trailing_join(met, near, ["station"], "at", "s", 86400, "inner").where(geo.is_upwind(F.col("km"), F.col("to"), F.col("wind_dir")))
    sums = hits.groupBy("station", "h").agg(F.round(F.sum("frp"), 4).alias("frp"), F.count(F.lit(1)).alias("n"))
    return met.join(sums, ["station", "h"], "left").select("station", "h", F.coalesce("frp", F.lit(0.0)).alias("frp"), F.coalesce("n", F.lit(0)).alias("n"))


@query("J8_nearest_1km", "SELECT event_id, arg_min(station, km * 100000 + station) AS station FROM (SELECT event_id, station, " + t.haversine_sql("f", "st") + " AS km FROM fires f, station st) WHERE km < 1 GROUP BY 1", "fires station")
def _(spark, d):
    return rel.nearest(t.fires(spark, d), t.station(spark), ["event_id"], "station", within=1.0).select("event_id", "station")


@query("J9_nearest", "SELECT event_id, station, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, station) AS n FROM (SELECT event_id, station, " + t.haversine_sql("f", "st") + " AS km FROM fires f, station st)) WHERE n = 1", "fires station")
def _(spark, d):
    return rel.nearest(t.fires(spark, d), t.station(spark), ["event_id"], "station").select("event_id", "station", r6("km").alias("km"))


@query("J12_pairwise", "SELECT a.station AS a, b.station AS b, round(" + t.haversine_sql("a", "b") + ", 6) AS km FROM (SELECT * FROM station SEMI JOIN obs USING (station)) a, (SELECT * FROM station SEMI JOIN obs USING (station)) b", "station obs")
def _(spark, d):
    """Distances between all stations that have readings: a dimension by itself."""
    a = t.station(spark).join(t.obs_long(spark, d), "station", "left_semi")
    b = a.select(F.col("station").alias("b"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    return a.join(F.broadcast(b)).select(F.col("station").alias("a"), "b", r6(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).alias("km"))


def station_rows(spark, obs: DataFrame) -> DataFrame:
    return obs.select("station", "h", "pm25").join(t.station(spark), "station")


_LOO = "SELECT a.station, a.h, round(sum(b.pm25 / pow(greatest(k.km, 0.05), 2)) / sum(1 / pow(greatest(k.km, 0.05), 2)), 6) AS idw, round(min(k.km), 6) AS nearest_km, count(*) AS n FROM obs a JOIN obs b ON b.h = a.h AND b.station <> a.station JOIN (SELECT p.station AS x, q.station AS y, " + t.haversine_sql("p", "q") + " AS km FROM station p, station q) k ON k.x = a.station AND k.y = b.station GROUP BY 1, 2"


@query("J13_idw_loo", _LOO, "obs station")
def _(spark, d):
    near = rel.surroundings(station_rows(spark, t.obs_hour(spark, d)), "station", "h", "pm25").where(F.size("others") > 0)
    return near.select("station", "h", r6(rel.weighted_others(0.05)).alias("idw"), r6(F.array_min(F.transform("others", lambda x: x["km"]))).alias("nearest_km"), F.size("others").cast("long").alias("n"))


@query("D7_idw_leave_one_out", "SELECT station, h, idw AS pm25 FROM (" + _LOO + ")", "obs station")
def _(spark, d):
    """A station within 50 m gives its own value, the first of several."""
    near = rel.surroundings(station_rows(spark, t.obs_hour(spark, d)), "station", "h", "pm25").where(F.size("others") > 0)
    here = F.array_min(F.transform(F.filter("others", lambda x: (x["km"] < 0.05) & x["v"].isNotNull()), lambda x: F.struct(x["o"].alias("o"), x["v"].alias("v"))))
    return near.select("station", "h", r6(F.coalesce(here["v"], rel.weighted_others(1e-9))).alias("pm25"))


@query("J14_anti", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON o_custkey = c_custkey")
def _(spark, d):
    """Customers without a large order."""
    return t.read(spark, d, "customer").join(t.read(spark, d, "orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("J15_semi", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON o_custkey = c_custkey")
def _(spark, d):
    big = t.read(spark, d, "orders").where("o_totalprice > 100000")
    return t.read(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("J19_interval", "SELECT stage, lo, count(*) AS n FROM obs JOIN (VALUES ('III', 473400, 473500), ('IV', 473450, 473520), ('II', 473000, 473900), ('IV', 473600, NULL)) v(stage, lo, hi) ON h >= lo AND h < coalesce(hi, (SELECT max(h) FROM obs)) GROUP BY 1, 2", "obs")
def _(spark, d):
    obs = t.obs_hour(spark, d)
    bands = calendar(spark).join(F.broadcast(obs.agg(F.max("h").alias("last")))).withColumn("hi", F.coalesce("hi", "last"))
    return obs.join(F.broadcast(bands), (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi"))).groupBy("stage", "lo").agg(F.count(F.lit(1)).alias("n"))


@query("J20_exact_or_last", "SELECT k.h, round(coalesce(o.v, (SELECT arg_max(v, h) FROM (SELECT h, avg(pm25) AS v FROM obs GROUP BY h))), 6) AS v FROM (SELECT unnest(range(max(h) - 5, max(h) + 20)) AS h FROM obs) k LEFT JOIN (SELECT h, avg(pm25) AS v FROM obs GROUP BY h) o ON o.h = k.h", "obs")
def _(spark, d):
    city = t.obs_hour(spark, d).groupBy("h").agg(F.avg("pm25").alias("v"))
    last = city.agg(F.max("h").alias("top"), F.max_by("v", "h").alias("last"))
    wanted = last.select("last", F.explode(F.sequence(F.col("top") - 5, F.col("top") + 19)).alias("h"))
    return wanted.join(city, "h", "left").select("h", r6(F.coalesce("v", "last")).alias("v"))


# Set operations, sorts and limits.


@query("U1_union", "SELECT s_nationkey AS k, s_acctbal AS v, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    s = t.read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    c = t.read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg"))
    return s.unionByName(c, allowMissingColumns=True)


@query("U2_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("user_id", "event_type").dropDuplicates()


@query("U3_distinct_key", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return t.read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("U4_except", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(spark, d):
    c, s = t.read(spark, d, "customer"), t.read(spark, d, "supplier").where("s_acctbal > 5000")
    return c.select(F.col("c_nationkey").alias("k")).subtract(s.select(F.col("s_nationkey").alias("k")))


@query("U5_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return t.read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t.read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("O3_topk", f"SELECT station, h, idx FROM ({_IDX}) ORDER BY idx DESC, station, h LIMIT 12", "series")
def _(spark, d):
    return indexed(spark, d).orderBy(F.desc("idx"), "station", "h").limit(12)


@query("O8_latest", "SELECT max(h) AS h FROM obs_long", "obs_long")
def _(spark, d):
    return t.obs_long(spark, d).agg(F.max("h").alias("h"))


# Geospatial and domain functions.


@query("G1_distance", "SELECT event_id, station, round(" + t.haversine_sql("st", "f") + ", 6) AS km, round(" + t.bearing_sql("st", "f") + ", 6) AS bearing FROM fires f, station st", "fires station")
def _(spark, d):
    st = t.station(spark).select("station", F.col("lat").alias("y"), F.col("lon").alias("x"))
    a = (F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))
    return t.fires(spark, d).join(F.broadcast(st)).select("event_id", "station", r6(geo.haversine_km(*a)).alias("km"), r6(geo.bearing(*a)).alias("bearing"))


@query("G6_cells", "SELECT event_id, 'delhi_' || CAST(floor(round_even(lat / 0.01, 6)) - 2840 AS BIGINT) || '_' || CAST(floor(round_even(lon / 0.01, 6)) - 7683 AS BIGINT) AS cell FROM fires", "fires")
def _(spark, d):
    return t.fires(spark, d).select("event_id", geo.cell_id("delhi", F.col("lat"), F.col("lon"), t.SOUTH, t.WEST).alias("cell"))


@query("G7_enumerate", "SELECT 'delhi_' || i || '_' || j AS cell FROM (SELECT CAST(round((max(y0) + 0.1 - 28.4) / 0.01) AS BIGINT) AS rows_, CAST(round((max(x0) + 0.1 - 76.83) / 0.01) AS BIGINT) AS cols FROM wards) b, LATERAL (SELECT unnest(range(b.rows_)) AS i), LATERAL (SELECT unnest(range(b.cols)) AS j)", "wards")
def _(spark, d):
    """All cells over the wards' bounds."""
    n = lambda c, least: F.sequence(F.lit(0), F.round((F.max(c) + 0.1 - least) / 0.01).cast("int") - 1)
    bounds = t.wards(spark, d).agg(n("y0", t.SOUTH).alias("i"), n("x0", t.WEST).alias("j"))
    return bounds.select(F.explode("i").alias("i"), "j").select("i", F.explode("j").alias("j")).select(F.concat_ws("_", F.lit("delhi"), "i", "j").alias("cell"))


@query("Q1_sub_index", "SELECT event_id, " + ", ".join(f"{t.sub_index_sql(p, 'value')} AS {p}" for p in aqi.BREAKPOINTS) + " FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("event_id", *(aqi.sub_index(p, F.col("value")).alias(p) for p in aqi.BREAKPOINTS))


@query("Q2_category", f"SELECT station, h, idx, {t.category_sql('idx')} AS category FROM ({_IDX})", "series")
def _(spark, d):
    return indexed(spark, d).withColumn("category", aqi.category(F.col("idx")))


_Q4 = [("pm25", "p1"), ("pm10", "p2"), ("no2", "p3")]


@query("Q4_full", "SELECT event_id, aqi, CASE WHEN aqi IS NULL THEN NULL WHEN i1 = aqi THEN 'pm25' WHEN i2 = aqi THEN 'pm10' ELSE 'no2' END AS dominant, " + t.category_sql("aqi") + " AS category FROM (SELECT *, CASE WHEN i1 IS NOT NULL AND i2 IS NOT NULL AND i3 IS NOT NULL THEN greatest(i1, i2, i3) END AS aqi FROM (SELECT event_id, " + t.sub_index_sql("pm25", "a") + " AS i1, " + t.sub_index_sql("pm10", "b") + " AS i2, " + t.sub_index_sql("no2", "c") + " AS i3 FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS a, value * 1.5 AS b, 500 - value AS c FROM events)))")
def _(spark, d):
    v = F.col("value")
    full = aqi.full_index({"pm25": F.when(F.col("event_id") % 9 != 0, v), "pm10": v * 1.5, "no2": 500 - v})
    return t.read(spark, d, "events").select("event_id", full.alias("q")).select("event_id", "q.aqi", "q.dominant", "q.category")


@query("Q5_breakpoints", "SELECT v.*, (SELECT count(*) FROM obs_long WHERE parameter = v.pollutant AND value > v.conc_lo AND value <= v.conc_hi) AS readings FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}::DOUBLE, {r[3]}::DOUBLE, {r[4]}, {r[5]}, {str(r[6]).lower()})" for r in aqi.breakpoint_rows()) + ") v(pollutant, category, conc_lo, conc_hi, index_lo, index_hi, extrapolated)", "obs_long")
def _(spark, d):
    """The rows of the index, with how many readings lie in each."""
    rows = spark.createDataFrame(aqi.breakpoint_rows(), "pollutant string, category string, conc_lo double, conc_hi double, index_lo int, index_hi int, extrapolated boolean")
    inside = (F.col("parameter") == F.col("pollutant")) & (F.col("value") > F.col("conc_lo")) & (F.col("value") <= F.col("conc_hi"))
    hits = t.obs_long(spark, d).join(F.broadcast(rows.select("pollutant", "category", "conc_lo", "conc_hi")), inside).groupBy("pollutant", "category").agg(F.count(F.lit(1)).alias("readings"))
    return rows.join(hits, ["pollutant", "category"], "left").select(*rows.columns, F.coalesce("readings", F.lit(0)).alias("readings"))


@query("D1_wind", "SELECT station, h, round(-wind_speed * sin(radians(wind_dir)), 6) AS u, round(-wind_speed * cos(radians(wind_dir)), 6) AS v FROM met", "met")
def _(spark, d):
    u, v = domain.wind_vector(F.col("wind_speed"), F.col("wind_dir"))
    return t.with_meteo(t.obs_hour(spark, d)).select("station", "h", r6(u).alias("u"), r6(v).alias("v"))


@query("D2_calendar", "SELECT event_id, CAST(hour(x) AS INTEGER) AS hour, CAST(dayofyear(x) AS INTEGER) AS doy, CAST(isodow(x) - 1 AS INTEGER) AS dow, CAST(isodow(x) >= 6 AS INTEGER) AS weekend, round(sin(2 * pi() * hour(x) / 24), 6) AS sin24, round(cos(2 * pi() * dayofyear(x) / 365), 6) AS cos365 FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS x FROM events)")
def _(spark, d):
    x = F.expr("ts + INTERVAL 330 MINUTE")
    return t.read(spark, d, "events").select("event_id", F.hour(x).alias("hour"), F.dayofyear(x).alias("doy"), F.weekday(x).alias("dow"), (F.weekday(x) >= 5).cast("int").alias("weekend"),
                                             r6(F.sin(2 * F.pi() * F.hour(x) / 24)).alias("sin24"), r6(F.cos(2 * F.pi() * F.dayofyear(x) / 365)).alias("cos365"))


@query("D3_iso", "SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("event_id", F.date_format(F.expr("ts - INTERVAL 330 MINUTE"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query("D8_confidence", "SELECT event_id, CASE WHEN km <= 3 THEN 'high' WHEN km <= 9 THEN 'med' ELSE 'low' END AS confidence FROM (SELECT event_id, min(" + t.haversine_sql("f", "st") + ") AS km FROM fires f, station st GROUP BY 1)", "fires station")
def _(spark, d):
    return rel.nearest(t.fires(spark, d), t.station(spark), ["event_id"], "station").select("event_id", domain.distance_confidence(F.col("km")).alias("confidence"))


@query("D15_risk", f"SELECT station, h, CASE WHEN idx <= 100 THEN 'low' WHEN idx <= 200 THEN 'moderate' WHEN idx <= 300 THEN 'high' ELSE 'severe' END AS risk FROM ({_IDX})", "series")
def _(spark, d):
    return indexed(spark, d).select("station", "h", domain.risk_level(F.col("idx")).alias("risk"))


_HR = "exp(0.1430 * ln(1 + greatest(0.0, {0} - 2.4) / 1.6) / (1 + exp(-(greatest(0.0, {0} - 2.4) - 15.5) / 36.8)))"


@query("D17_gemm", f"SELECT event_id, round({_HR.format('value')}, 6) AS hr, round(100000 * 0.66 * 0.009 * (({_HR.format('value * 1.2')} - 1) / {_HR.format('value * 1.2')} - ({_HR.format('value')} - 1) / {_HR.format('value')}), 6) AS avoided FROM events")
def _(spark, d):
    v = F.col("value")
    return t.read(spark, d, "events").select("event_id", r6(domain.hazard_ratio(v)).alias("hr"), r6(domain.avoided_deaths(v, v * 1.2, F.lit(100000))).alias("avoided"))


_U9 = "least(1.0, greatest(0.0, {}))"
_RAW9 = ("SELECT s_suppkey, [0.20 + 0.9 * " + _U9.format("abs(s_acctbal) / 10000") + ", 0.12 + 1.4 * near / (near + 0.5) + 0.6 * 0.3, 0.08 + 1.2 * " + _U9.format("s_nationkey / 25.0") + " + 0.5 * " + _U9.format("s_acctbal / 200.0")
         + ", 0.18 + 0.5 * (1.0 - " + _U9.format("s_suppkey % 10 / 10.0") + "), 0.12 + 0.8 * " + _U9.format("s_suppkey % 10 / 10.0") + "]::DOUBLE[] AS raw FROM (SELECT *, 1.0::DOUBLE / greatest(0.5::DOUBLE, s_suppkey % 7 + 0.2::DOUBLE) AS near FROM supplier)")
_SHARES9 = f"SELECT s_suppkey, list_transform(s, lambda x, i: CASE WHEN i = list_position(s, list_max(s)) THEN round(x + round(1.0 - list_sum(s), 3), 3) ELSE x END) AS s FROM (SELECT s_suppkey, list_transform(raw, lambda x: round(x / list_sum(raw), 3)) AS s FROM ({_RAW9}))"


@query("D9_shares", "SELECT s_suppkey, " + ", ".join(f"s[{i + 1}] AS {n}" for i, n in enumerate(domain.SHARES)) + f", CASE WHEN list_max(s) > 0.38 THEN 'high' WHEN list_max(s) > 0.30 THEN 'med' ELSE 'low' END AS confidence FROM ({_SHARES9})")
def _(spark, d):
    s = t.read(spark, d, "supplier")
    bal = F.col("s_acctbal")
    parts = domain.source_shares(F.abs(bal) / 10000, F.col("s_suppkey") % 10 / 10.0, F.col("s_suppkey") % 7 + 0.2, bal, F.col("s_nationkey") / 25.0, F.lit(0.3))
    out = s.select("s_suppkey", parts.alias("p")).select("s_suppkey", "p.*")
    return out.withColumn("confidence", domain.share_confidence(F.greatest(*domain.SHARES)))


@query("D13_priority", "SELECT ward_id, round(least(100.0, greatest(0.0, 0.10 * (k * 17 % 500) + 3.0 * (k % 8) + 0.25 * (k * 7 % 100) + 25.0 * population / m)), 1) AS score FROM wards, (SELECT max(population) AS m FROM wards)", "wards")
def _(spark, d):
    k = F.col("k")
    w = t.wards(spark, d).withColumn("m", F.max("population").over(Window.partitionBy()))
    return w.select("ward_id", domain.priority((k * 17 % 500).cast("double"), k % 8, (k * 7 % 100).cast("double"), F.col("population"), F.col("m")).alias("score"))


@query("D24_noise", "SELECT event_id, ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS noise FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("event_id", (F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)).alias("noise"))


@query("D25_trend_days", "SELECT event_id, (CAST(floor(epoch(ts)) AS BIGINT) - (SELECT min(CAST(floor(epoch(ts)) AS BIGINT)) FROM events)) / 86400.0::DOUBLE AS days FROM events")
def _(spark, d):
    e = t.read(spark, d, "events").select("event_id", t.second_number(F.col("ts")).alias("s"))
    return e.join(F.broadcast(e.agg(F.min("s").alias("s0")))).select("event_id", ((F.col("s") - F.col("s0")) / 86400.0).alias("days"))


# Strings.


_SAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[<>]', ' ', 'g'), '&(?:#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});', ' ', 'g'), '[\x00-\x1F\x7F]', ' ', 'g'), '[\s\x0B\x{85}\pZ]+', ' ', 'g'))"


@query("X1_sanitize", f"SELECT page_id, md5({_SAN}) AS digest FROM pages")
def _(spark, d):
    return t.read(spark, d, "pages").select("page_id", F.md5(text.sanitize(F.col("html"))).alias("digest"))


@query("X2_violations", r"SELECT page_id, regexp_matches(html, '[<>]') AS angle, regexp_matches(html, '[\x00-\x1F\x7F]') AS control, regexp_matches(html, '&(?:#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});') AS entity, regexp_matches(html, '(?i)javascript:|vbscript:|data:text/html') AS scheme FROM pages")
def _(spark, d):
    found = text.violations(F.col("html"))
    return t.read(spark, d, "pages").select("page_id", *(F.array_contains(found, n).alias(n) for n in ("angle", "control", "entity", "scheme")))


@query("X4_strip_query", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def _(spark, d):
    return t.read(spark, d, "pages").select("page_id", text.strip_query(F.col("url")).alias("url"))


@query("X7_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("event_id", text.resolve_path(F.col("props"), "props.k").alias("k"))


@query("C_gate", f"SELECT station, h, (m BETWEEN 0 AND 2000 AND idx BETWEEN 0 AND 500 AND m * 1.2 >= m) AS ok FROM (SELECT station, h, m, {t.sub_index_sql('pm25', 'm')} AS idx FROM ({_A10})) WHERE m IS NOT NULL", "series")
def _(spark, d):
    rows = mean24(spark, d).where("m is not null").withColumn("idx", aqi.sub_index("pm25", F.col("m")))
    return rows.select("station", "h", (F.col("m").between(0, 2000) & F.col("idx").between(0, 500) & (F.col("m") * 1.2 >= F.col("m"))).alias("ok"))
