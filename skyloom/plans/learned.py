"""Registered queries that rest on trained models: present levels, forecasts, weather normalisation, and what they are worth.

Their rows are checked by tests, not by SQL; what SQL can say of them (baselines, folds, splits) has queries of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aqi, domain, geo, text
from ..operators import boosting
from ..operators import relational as rel
from ..operators.staging import Steps
from . import documents as docs
from . import tables as t
from .governance import cells
from .products import bearing_hits
from .registry import ORACLES, QUERIES, bucket, query, r6

#: Inputs of the present-level model, of a forecast and of weather normalisation (weather first, which is drawn, then times).
WEATHER = ["wind_u", "wind_v", "wind_speed", "temp", "rh", "precip", "blh"]
TIMES = ["hour_sin", "hour_cos", "doy_sin", "doy_cos", "is_weekend"]
SPATIAL = ["idw", "nearest_km", "station_count"]
NOWCAST = WEATHER + TIMES + SPATIAL
LAGS = (1, 3, 6, 12, 24)
FORECAST = ["lag0", *(f"lag{k}" for k in LAGS), "roll24", "trend6", *(f"{m}_tgt" for m in ("wind_speed", "blh", "rh", "precip", "temp")), "frp_upwind", *TIMES[:4]]
DEWEATHER = [*WEATHER, *TIMES, "trend_days"]
#: Hours ahead; longest look back of an input; least rows to learn from and to test on; share of origins that is held out.
HORIZONS, LOOK_BACK, LEAST_LEARNED, LEAST_TESTED, HELD = (24, 48, 72), 168, 100, 20, 0.3
#: Least values of a station for a normalised series of its own.
LEAST_VALUES = 200
SETTINGS = boosting.Settings(rounds=16, depth=4, rate=0.2)


def with_times(rows: DataFrame, hour: str = "h", minutes: int = 330) -> DataFrame:
    """Calendar inputs from local time; ``hour``: hours since 1970."""
    turn = lambda v, n: (2 * F.pi() * v / n)
    hod = F.floor((F.col(hour) * 60 + minutes) / 60) % 24
    doy = F.dayofyear(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col(hour) * 60 + minutes) / 1440).cast("int")))
    weekend = (F.pmod(F.floor((F.col(hour) * 60 + minutes) / 1440) + 3, F.lit(7)) >= 5).cast("double")
    return rows.withColumns({"hour_sin": F.sin(turn(hod, 24)), "hour_cos": F.cos(turn(hod, 24)), "doy_sin": F.sin(turn(doy, 365)), "doy_cos": F.cos(turn(doy, 365)), "is_weekend": weekend})


def with_wind(rows: DataFrame) -> DataFrame:
    u, v = domain.wind_vector(F.col("wind_speed"), F.col("wind_dir"))
    return rows.withColumns({"wind_u": u, "wind_v": v})


def station_frame(spark, d, obs: DataFrame | None = None) -> DataFrame:
    """``station``, ``h``, ``pm25`` and the present-level model's inputs; of the surroundings the other stations of the hour."""
    obs = (t.obs_hour(spark, d) if obs is None else obs).join(t.station(spark), "station")
    around = rel.surroundings(obs, "station", "h", "pm25")
    km = F.array_min(F.transform("others", lambda x: x["km"]))
    near = around.select("station", "h", "pm25", rel.weighted_others(0.05).alias("idw"), km.alias("nearest_km"), (F.size("others") + 1).alias("station_count"))
    return with_times(with_wind(t.with_weather(near))).where("pm25 is not null")


def bounded(rows: DataFrame, low: str = "p50", high: str = "p90") -> DataFrame:
    """Quantiles as they are published: not negative, the higher at least the lower."""
    return rows.withColumn(low, F.greatest(F.col(low), F.lit(0.0))).withColumn(high, F.greatest(F.col(high), F.col(low)))


@query("M2_quantiles")
def _(spark, d):
    """Both quantiles of the station-hours of each second day, from those of the others."""
    frame = station_frame(spark, d)
    odd = F.floor((F.col("h") * 60 + 330) / 1440) % 2 == 1
    model = boosting.train(frame.where(~odd), NOWCAST, "pm25", [0.5, 0.9], ["station", "h"], SETTINGS)
    return bounded(model.predict(frame.where(odd), ["station", "h", "pm25"], ["p50", "p90"]))


def left_out(spark, d) -> DataFrame:
    """Each station's hours from a model of the others, beside the inverse-distance estimate; all folds grow in one pass."""
    frame = station_frame(spark, d)
    folds = boosting.train(frame, NOWCAST, "pm25", [0.5], ["station", "h"], SETTINGS, group="station", mode="out")
    return folds.predict_own(frame, ["station", "h", "pm25", "idw"], "station", "p50").withColumn("p50", F.greatest("p50", F.lit(0.0)))


@query("M4_leave_one_out")
def _(spark, d):
    return left_out(spark, d)


@query("M4_distance_curve")
def _(spark, d):
    return distance_curve(spark, left_out(spark, d))


def distance_curve(spark, found: DataFrame) -> DataFrame:
    """Errors of the left-out stations by the distance to their nearest other station, for the model and for inverse distances."""
    a, b = (t.station(spark).select(F.col("station").alias(f"{p}s"), F.col("lat").alias(f"{p}y"), F.col("lon").alias(f"{p}x")) for p in "ab")
    pairs = a.join(F.broadcast(b), F.col("as") != F.col("bs"))  # stations by stations
    near = pairs.groupBy(F.col("as").alias("station")).agg(F.min(geo.haversine_km(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"))).alias("km"))
    rmse = lambda c: F.round(F.sqrt(F.avg(F.pow(F.col("pm25") - F.col(c), 2))), 2)
    by = found.where("idw is not null").join(near, "station").groupBy(bucket(F.col("km")).alias("edge")).agg(F.max("km").alias("far"), rmse("p50").alias("model_rmse"), rmse("idw").alias("idw_rmse"), F.count(F.lit(1)).alias("n"))
    return by.select(F.coalesce("edge", F.round("far", 1)).alias("dist_km"), "model_rmse", "idw_rmse", "n")


def supervised(spark, d, horizon: int, obs: DataFrame | None = None) -> DataFrame:
    """Rows by station and origin: what is known at the origin, the weather forecast for the hour aimed at, and that hour's value."""
    by = Window.partitionBy("station").orderBy("h")
    obs = t.obs_hour(spark, d) if obs is None else obs
    s = t.with_weather(rel.hourly_spine(obs, "station")).withColumns({"lag0": F.col("pm25"), **{f"lag{k}": F.lag("pm25", k).over(by) for k in LAGS}, "roll24": rel.guarded_mean("pm25", 24, 6, "station"), "trend6": F.col("pm25") - F.lag("pm25", 6).over(by), "y": F.lead("pm25", horizon).over(by)})
    s = s.withColumns({f"{m}_tgt": F.lead(m, horizon).over(by) for m in ("wind_speed", "blh", "rh", "precip", "temp")}).withColumn("target_h", F.col("h") + horizon)
    fires = QUERIES["J5_upwind"](spark, d).select("station", "h", F.col("frp").alias("frp_upwind"))
    usual = obs.groupBy((F.floor((F.col("h") * 60 + 330) / 60) % 24).alias("hod")).agg(F.avg("pm25").alias("seasonal"))
    rows = with_times(s.join(fires, ["station", "h"], "left"), "target_h").withColumn("hod", F.floor((F.col("target_h") * 60 + 330) / 60) % 24)
    return rows.join(F.broadcast(usual), "hod", "left").dropna(subset=["y", "lag0", "lag24"])  # 24 hours


def split(rows: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows held out: the last origins, and those that end before an embargo of the horizon and the longest look back."""
    hours = rows.agg(F.sort_array(F.collect_set("h")).alias("_o"))  # origins: hours, whatever the number of stations
    edge = hours.select(F.get("_o", F.floor(F.size("_o") * F.lit(1 - HELD)).cast("int")).alias("_split"))
    placed = rows.join(F.broadcast(edge))
    return placed.where(F.col("h") <= F.col("_split") - (horizon + LOOK_BACK)).drop("_split"), placed.where(F.col("h") >= F.col("_split")).drop("_split")


@query("M5_forecast_model")
def _(spark, d):
    """Both quantiles a day ahead for the held-out origins."""
    learned, held = split(supervised(spark, d, 24), 24)
    model = boosting.train(learned, FORECAST, "y", [0.5, 0.9], ["station", "h"], SETTINGS)
    return bounded(model.predict(held, ["station", "h", "y"], ["p50", "p90"]))


def backtest(spark, d, horizon: int, features: list[str] = FORECAST) -> DataFrame:
    """One row of errors and skill over the held-out origins; zeros where there is too little to learn from or to test on."""
    learned, held = split(supervised(spark, d, horizon), horizon)
    names = ["rmse", "mae", "persistence_rmse", "seasonal_naive_rmse", "skill_pct"]
    tested = held.count()
    if learned.limit(LEAST_LEARNED).count() < LEAST_LEARNED or tested < LEAST_TESTED:
        row = spark.range(1).select(*(F.lit(0.0).alias(n) for n in names), F.lit(tested).cast("long").alias("n"))
    else:
        model = boosting.train(learned, features, "y", [0.5], ["station", "h"], SETTINGS)
        e = model.predict(held, ["y", "lag0", "seasonal"], ["p50"]).withColumn("p50", F.greatest("p50", F.lit(0.0)))
        rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("y") - F.col(c), 2)))
        sums = e.agg(rmse("p50").alias("_m"), F.avg(F.abs(F.col("y") - F.col("p50"))).alias("_a"), rmse("lag0").alias("_p"), rmse("seasonal").alias("_s"), F.count(F.lit(1)).alias("n"))
        skill = F.when(F.col("_p") > 0, F.round(100 * (1 - F.col("_m") / F.col("_p")), 1)).otherwise(0.0)
        row = sums.select(*(F.round(c, 2).alias(n) for c, n in zip(("_m", "_a", "_p", "_s"), names, strict=False)), skill.alias("skill_pct"), "n")
    return row.select(F.lit(horizon).alias("horizon"), *names, "n", F.lit(horizon + LOOK_BACK).alias("embargo_h"))


@query("M6_backtest")
def _(spark, d):
    return backtests(spark, d)


def backtests(spark, d) -> DataFrame:
    """The trained forecast against persistence and the hour's usual level, by horizon."""
    one, two, three = (backtest(spark, d, h) for h in HORIZONS)
    return one.unionByName(two).unionByName(three)


@query("M15_model_ablation")
def _(spark, d):
    """Error over left-out stations with and without the surroundings, and by how much it differs."""
    frame = station_frame(spark, d)
    both = frame.select("station", "h", "pm25")
    for name, features in (("with_", NOWCAST), ("without_", WEATHER + TIMES)):
        folds = boosting.train(frame, features, "pm25", [0.5], ["station", "h"], SETTINGS, group="station", mode="out")
        both = both.join(folds.predict_own(frame, ["station", "h"], "station", name), ["station", "h"])
    e = both.agg(*(F.sqrt(F.avg(F.pow(F.col("pm25") - F.greatest(F.col(n), F.lit(0.0)), 2))).alias(n) for n in ("with_", "without_")))
    return e.select(F.round("with_", 2).alias("with_rmse"), F.round("without_", 2).alias("without_rmse"), F.round(100 * (F.col("without_") - F.col("with_")) / F.col("without_"), 2).alias("delta_pct"))


def _with_trend(rows: DataFrame) -> DataFrame:
    first = rows.agg(F.min("h").alias("_first"))
    return rows.join(F.broadcast(first)).withColumn("trend_days", (F.col("h") - F.col("_first")) / 24.0).drop("_first")


def normalised_city(spark, d) -> DataFrame:
    """``h``, ``pm25`` and ``normal`` of the city's hourly mean: the exact mean estimate under all weathers of the series."""
    met = t.with_weather(t.obs_hour(spark, d))
    hourly = met.groupBy("h").agg(*(F.avg(c).alias(c) for c in ("pm25", "wind_speed", "wind_dir", "temp", "rh", "precip", "blh")))
    rows = _with_trend(with_times(with_wind(hourly)))
    model = boosting.train(rows, DEWEATHER, "pm25", [None], ["h"], SETTINGS)
    return model.mean_over(rows, rows, ["h", "pm25"], WEATHER, "normal").withColumn("normal", F.greatest("normal", F.lit(0.0)))


@query("M9_normalised")
def _(spark, d):
    return normalised_city(spark, d)


@query("M10_city_daily")
def _(spark, d):
    """Daily means, raw and normalised; days without either are left out."""
    day = F.floor((F.col("h") * 60 + 330) / 1440).cast("long").alias("day")
    return normalised_city(spark, d).groupBy(day).agg(r6(F.avg("pm25")).alias("raw"), r6(F.avg("normal")).alias("normalised")).dropna()


@query("M10_station_normalised")
def _(spark, d):
    """Each station's series by a model of its own, all trained in one pass; stations with too few values are left out."""
    rows = _with_trend(with_times(with_wind(t.with_weather(t.obs_hour(spark, d)))))
    enough = rows.groupBy("station").agg(F.count("pm25").alias("_n")).where(F.col("_n") >= LEAST_VALUES).select("station")
    rows = rows.join(enough, "station")
    models = boosting.train(rows, DEWEATHER, "pm25", [None], ["station", "h"], SETTINGS, group="station", mode="own")
    return models.mean_over(rows, rows, ["station", "h", "pm25"], WEATHER, "normal", "station").withColumn("normal", F.greatest("normal", F.lit(0.0)))


# The present-level document: cells first, wards from them.


def last_covered(obs: DataFrame) -> DataFrame:
    """One row, ``last``: the last hour at which at least two stations have a value."""
    return obs.groupBy("h").agg(F.count("pm25").alias("n")).where("n >= 2").agg(F.max("h").alias("last"))


def with_history(obs: DataFrame, hours: DataFrame, back: int) -> DataFrame:
    """The values of the ``back`` hours up to each of some hours (``last``), with ``ahead``: by how much they precede it."""
    wanted = hours.where("last is not null").select("last", F.explode(F.sequence(F.lit(0), F.lit(back - 1))).alias("ahead")).withColumn("h", F.col("last") - F.col("ahead"))
    return obs.select("station", "h", "pm25").join(F.broadcast(wanted), "h").drop("h")  # few hours are asked for


def cell_estimates(spark, d, model: boosting.Boosted, hours: DataFrame) -> DataFrame:
    """``h``, ``i``, ``j``, ``pm25_p50``, ``pm25_p90``, ``subindex24h``, ``category``, ``confidence`` of the grid's cells at each of some hours.

    The model is asked at the cells, with the weather of the nearest station and the surroundings as seen from the cell. The
    index rests on the cell's inverse-distance mean of the 24 hours. Cells whose estimate is not finite are left out."""
    recent = with_history(t.obs_hour(spark, d), hours, 24)
    grid = cells(spark).select("i", "j", F.col("lat").alias("y"), F.col("lon").alias("x"))
    km = grid.join(F.broadcast(t.station(spark))).select("i", "j", "station", geo.haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")).alias("km"))
    day = recent.groupBy("station", F.col("last").alias("h")).agg(F.avg("pm25").alias("mean24"), F.max(F.when(F.col("ahead") == 0, F.col("pm25"))).alias("now"))
    w = 1 / F.pow(F.greatest(F.col("km"), F.lit(0.05)), F.lit(2))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w)))
    there = F.when(F.col("now").isNotNull(), F.col("km"))
    near = km.join(day, "station").groupBy("h", "i", "j").agg(mean("now").alias("idw"), mean("mean24").alias("m24"), F.min(there).alias("nearest_km"), F.count("now").alias("station_count"), F.min_by("station", "km").alias("station"))
    asked = with_times(with_wind(t.with_weather(near)))
    got = bounded(model.predict(asked, ["h", "i", "j", "m24", "nearest_km"], ["pm25_p50", "pm25_p90"]), "pm25_p50", "pm25_p90").where("pm25_p50 is not null and not isnan(pm25_p50)")
    index = aqi.sub_index("pm25", F.col("m24"))
    return got.select("h", "i", "j", r6("pm25_p50").alias("pm25_p50"), r6("pm25_p90").alias("pm25_p90"), index.alias("subindex24h"), aqi.category(index).alias("category"), domain.distance_confidence(F.col("nearest_km")).alias("confidence"))


def cell_model(spark, d, obs: DataFrame | None = None) -> boosting.Boosted:
    return boosting.train(station_frame(spark, d, obs), NOWCAST, "pm25", [0.5, 0.9], ["station", "h"], SETTINGS)


def cell_nowcast(spark, d) -> DataFrame:
    """Each grid cell at the last covered hour, by a model that learned from the station-hours."""
    return cell_estimates(spark, d, cell_model(spark, d), last_covered(t.obs_hour(spark, d))).drop("h")


@query("B4_cells")
def _(spark, d):
    return docs.republished(cell_nowcast(spark, d), "grid")


@query("B4_ward_rollup")
def _(spark, d):
    """Wards from the cells within them: means of the estimates, the median index, the worst confidence; wards without a cell are left out."""
    points = cells(spark).select("i", "j", "lat", "lon")
    placed = rel.points_in_boxes(points, t.wards(spark, d).select("ward_id", "x0", "y0"), 0.1, "ward_id", F.lit(None).cast("string")).where("ward_id is not null").select("i", "j", "ward_id")
    rank = F.element_at(F.create_map(*map(F.lit, ("low", 0, "med", 1, "high", 2))), F.col("confidence"))
    rolled = cell_nowcast(spark, d).join(placed, ["i", "j"]).groupBy("ward_id").agg(r6(F.avg("pm25_p50")).alias("pm25_p50"), r6(F.avg("pm25_p90")).alias("pm25_p90"), F.round(F.median("subindex24h")).cast("int").alias("subindex24h"), F.min_by("confidence", rank).alias("confidence"), F.count(F.lit(1)).alias("cells"))
    return rolled.withColumn("category", aqi.category(F.col("subindex24h")))


# The forecast document and replays.


def ward_inputs(spark, d, hours: DataFrame) -> DataFrame:
    """``ward_id``, ``h`` (origin), ``horizon`` and a forecast's inputs: each ward's last 25 hours are inverse-distance means of the
    stations, so wards without a station have a history, too. Weather and fires are the city's means. Wards without any value
    in that time are left out."""
    seen = with_history(t.obs_hour(spark, d), hours, 25).join(docs.ward_km(spark, d), "station")
    hourly = seen.groupBy("ward_id", F.col("last").alias("h"), "ahead").agg(docs.weighted("pm25").alias("v"))
    at = lambda k: F.max(F.when(F.col("ahead") == k, F.col("v")))
    known = hourly.groupBy("ward_id", "h").agg(at(0).alias("lag0"), *(at(k).alias(f"lag{k}") for k in LAGS), F.avg(F.when(F.col("ahead") < 24, F.col("v"))).alias("roll24"))
    fires = QUERIES["J5_upwind"](spark, d).join(F.broadcast(hours.select(F.col("last").alias("h"))), "h").groupBy("h").agg(F.avg("frp").alias("frp_upwind"))
    aims = hours.select(F.col("last").alias("h"), F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon")).withColumn("target_h", F.col("h") + F.col("horizon"))
    then = t.with_weather(aims.select("horizon", F.col("h").alias("_from"), F.col("target_h").alias("h")).join(F.broadcast(t.station(spark))))
    sky = then.groupBy(F.col("_from").alias("h"), "horizon").agg(*(F.avg(m).alias(f"{m}_tgt") for m in ("wind_speed", "blh", "rh", "precip", "temp")))
    rows = known.join(aims, "h").join(sky, ["h", "horizon"]).join(fires, "h", "left").withColumns({"trend6": F.col("lag0") - F.col("lag6"), "frp_upwind": F.coalesce("frp_upwind", F.lit(0.0))})
    return with_times(rows, "target_h")


_ENDS = "(SELECT max(h) AS last FROM (SELECT h FROM obs GROUP BY h HAVING count(pm25) >= 2))"
_HISTORY = f"SELECT ward_id, last, last - h AS ahead, {docs._WEIGHTED.format('pm25')} AS v FROM ward_km JOIN obs USING (station), {_ENDS} WHERE h > last - 25 AND h <= last GROUP BY ward_id, last, h"


@query("B5_ward_inputs", "SELECT ward_id, last AS h, horizon, round(lag0, 5) AS lag0, round(lag3, 5) AS lag3, round(lag24, 5) AS lag24, round(roll24, 5) AS roll24, round(lag0 - lag6, 5) AS trend6, round(coalesce(frp, 0.0), 5) AS frp_upwind, "
       "round((SELECT avg(1 + (station + last + horizon) % 5) FROM station), 5) AS wind_speed_tgt, round((SELECT avg(200 + ((last + horizon) * 29 + station * 101) % 1500) FROM station), 5) AS blh_tgt, round((SELECT avg(CASE WHEN (last + horizon + station) % 17 = 0 THEN 2.5 ELSE 0 END) FROM station), 5) AS precip_tgt, "
       "round(sin(2 * pi() * (floor(((last + horizon) * 60 + 330) / 60) % 24) / 24), 5) AS hour_sin FROM (SELECT ward_id, last, " + ", ".join(f"max(v) FILTER (WHERE ahead = {k}) AS lag{k}" for k in (0, 3, 6, 24))
       + f", avg(v) FILTER (WHERE ahead < 24) AS roll24 FROM ({_HISTORY}) GROUP BY 1, 2) LEFT JOIN (SELECT h, avg(frp) AS frp FROM ({ORACLES['J5_upwind']}) GROUP BY 1) f ON f.h = last, (VALUES (24), (48), (72)) z(horizon)", "obs ward_km station")
def _(spark, d):
    rows = ward_inputs(spark, d, last_covered(t.obs_hour(spark, d)))
    return rows.select("ward_id", "h", "horizon", *(F.round(c, 5).alias(c) for c in ("lag0", "lag3", "lag24", "roll24", "trend6", "frp_upwind", "wind_speed_tgt", "blh_tgt", "precip_tgt", "hour_sin")))


def forecast_models(spark, d, obs: DataFrame | None = None) -> dict[int, boosting.Boosted]:
    """Both quantiles by horizon."""
    return {h: boosting.train(supervised(spark, d, h, obs), FORECAST, "y", [0.5, 0.9], ["station", "h"], SETTINGS) for h in HORIZONS}


def ward_forecast(spark, d, models: dict[int, boosting.Boosted], hours: DataFrame) -> DataFrame:
    """``h`` (origin), ``ward_id``, ``series`` by horizon, from each of some hours; a ward with an estimate that is not finite is left out."""
    rows = Steps(spark, "forecast").staged(ward_inputs(spark, d, hours))
    parts = [bounded(models[k].predict(rows.where(F.col("horizon") == k), ["h", "ward_id", "horizon"], ["pm25_p50", "pm25_p90"]), "pm25_p50", "pm25_p90") for k in HORIZONS]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sure = F.element_at(F.create_map(*(F.lit(x) for k in HORIZONS for x in (k, docs.HORIZONS[k][0]))), F.col("horizon"))
    told = docs.indexed(every.select(F.col("h").alias("origin"), "ward_id", F.col("horizon").alias("h"), sure.alias("confidence"), F.round("pm25_p50", 4).alias("pm25_p50"), F.round("pm25_p90", 4).alias("pm25_p90")))
    return docs.forecast_wards(told, "origin", "ward_id")


@query("B5_ward_forecast")
def _(spark, d):
    """The forecast document by the trained models: each ward from its own history, one, two and three days ahead."""
    got = ward_forecast(spark, d, forecast_models(spark, d), last_covered(t.obs_hour(spark, d)))
    return docs.republished(got.drop("origin")).select("ward_id", F.explode("series").alias("s")).select("ward_id", "s.*")


#: A replay's days, as hours since 1970 from the first (inclusive) to the last (exclusive), and the hour of a day at which it is told.
REPLAYED, TOLD_AT = (473_640, 473_760), 12


def unseen(spark, d, first: int, end: int) -> DataFrame:
    """The hourly values without those of a time: what a replay's models may learn from. Lags that reach into it are missing, too."""
    return t.obs_hour(spark, d).where((F.col("h") < first) | (F.col("h") >= end))


def replay_hours(spark, first: int, end: int) -> DataFrame:
    return spark.range(first + TOLD_AT, end, 24).select(F.col("id").alias("last"))


@query("M16_replay_cells")
def _(spark, d):
    """The cells as they would have been told on each replayed day, by a model that never saw those days, beside what the stations of that hour meant."""
    return replayed_cells(spark, d, *REPLAYED)


def replayed_cells(spark, d, first: int, end: int) -> DataFrame:
    return cell_estimates(spark, d, cell_model(spark, d, unseen(spark, d, first, end)), replay_hours(spark, first, end))


@query("B12_replay_forecast")
def _(spark, d):
    """The wards' forecasts from each replayed day by models that never saw those days, with the value that came (null if none did)."""
    return replayed_forecast(spark, d, *REPLAYED)


def replayed_forecast(spark, d, first: int, end: int) -> DataFrame:
    got = ward_forecast(spark, d, forecast_models(spark, d, unseen(spark, d, first, end)), replay_hours(spark, first, end))
    rows = got.select("origin", "ward_id", F.explode("series").alias("s")).select("origin", "ward_id", "s.*").withColumn("last", F.col("origin") + F.col("h"))
    came = with_history(t.obs_hour(spark, d), rows.select("last").distinct(), 1).join(docs.ward_km(spark, d), "station").groupBy("last", "ward_id").agg(r6(docs.weighted("pm25")).alias("actual"))
    return rows.join(came, ["last", "ward_id"], "left").drop("last")


def replay_index(told: DataFrame, ahead: DataFrame) -> DataFrame:
    """One row: the document that lists the replayed days, with how many cells (``told``) and wards (``ahead``) each tells of."""
    wards = ahead.groupBy(F.col("origin").alias("h")).agg(F.count_distinct("ward_id").alias("wards"))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("h") / 24).cast("int")).cast("string")
    days = told.groupBy("h").agg(F.count(F.lit(1)).alias("cells")).join(wards, "h", "full").select(date.alias("date"), F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("wards", F.lit(0)).alias("wards"))
    window = F.struct(F.get("dates", F.lit(0))["date"].alias("start"), F.try_element_at("dates", F.lit(-1))["date"].alias("end"))
    return docs.document(days, "dates", window=window, note=F.lit("Out of fold: the models learned from all hours but those of the replayed days."))


# What published numbers rest on.


def metrics_document(spark, d) -> DataFrame:
    """One row: the left-out stations' errors by distance and over all, and the backtest by horizon, as JSON text."""
    steps = Steps(spark, "metrics")
    found = steps.staged(left_out(spark, d))
    rmse = lambda c: F.round(F.sqrt(F.avg(F.pow(F.col("pm25") - F.col(c), 2))), 2)
    overall = found.where("idw is not null").agg(F.struct(rmse("p50").alias("model_rmse"), rmse("idw").alias("idw_rmse"), F.count(F.lit(1)).alias("n"), F.count_distinct("station").alias("stations")).alias("overall"))
    buckets = distance_curve(spark, found).agg(F.sort_array(F.collect_list(F.struct("dist_km", "model_rmse", "idw_rmse", "n"))).alias("buckets"))
    tests = backtests(spark, d)
    ahead = tests.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("horizon").cast("string"), F.struct(*(c for c in tests.columns if c != "horizon")))))).alias("forecast"))
    whole = buckets.join(overall).join(ahead)  # one row each
    return whole.select(F.to_json(F.struct(F.struct(F.lit("IDW").alias("baseline"), "buckets", "overall").alias("nowcast_cv"), "forecast")).alias("document"))


@query("K13_metrics")
def _(spark, d):
    return metrics_document(spark, d)


def receipts_document(spark, d, metrics: DataFrame) -> DataFrame:
    """One row: the metrics, how many stations point where sources are known, the index's rows, and where the data came from."""
    hits = bearing_hits(spark, d)
    checks = hits.select(F.array(*(F.struct(F.lit(n).alias("check_name"), F.concat_ws(" of ", F.col(n).cast("string"), F.concat(F.col("stations").cast("string"), F.lit(" stations"))).alias("observed"), (F.col(n) > 0).alias("pass")) for n in hits.columns if n != "stations")).alias("checks"))
    lineage = None
    for name in ("events", "customer", "orders"):
        one = t.read(spark, d, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), F.lit(f"https://data.example/{name}").alias("base_url"), "rows")
        lineage = one if lineage is None else lineage.unionByName(one)
    sources = lineage.agg(F.sort_array(F.collect_list(F.struct("source", "base_url", "rows"))).alias("lineage"))
    bands = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("pollutant", "category", "conc_lo", "conc_hi", "index_lo", "index_hi", "extrapolated"), row, strict=True))) for row in aqi.breakpoint_rows()))
    parts = metrics.select(F.col("document").alias("_m")).join(checks).join(sources)
    body = F.concat(F.lit('{"cities":{"' + docs.CITY + '":{"metrics":'), "_m", F.lit(',"attribution_directional_checks":'), F.to_json("checks"), F.lit('}},"methodology":{"aqi_breakpoints":'), F.to_json(bands), F.lit('},"lineage":'), F.to_json("lineage"), F.lit("}"))
    return parts.select(body.alias("document"))


@query("B10_receipts_document")
def _(spark, d):
    """The receipts, with the values that briefs cite looked up by their paths."""
    doc = receipts_document(spark, d, metrics_document(spark, d))
    paths = ["receipts.cities.delhi.metrics.forecast.24.skill_pct", "receipts.cities.delhi.metrics.nowcast_cv.overall.model_rmse", "receipts.cities.delhi.attribution_directional_checks[check_name=north].observed", "receipts.methodology.aqi_breakpoints[0].index_hi", "receipts.lineage[source=events].rows"]
    return doc.select("document", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), text.resolve_path(F.col("document"), p).alias("value")) for p in paths))).alias("r")).select("r.path", "r.value")
