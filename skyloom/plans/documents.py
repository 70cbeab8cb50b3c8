"""Published documents of a city: each built as a plan, nested, written as JSON text and read back by its lookups.

A document holds a city's wards, so its size is that of a list of wards, whatever the number of readings behind it.
The estimates that a document is built from are arguments; the registered queries use inverse-distance means, and
for forecasts a blend of the present with the hour's usual level, which SQL can follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import aqi, domain, geo
from ..operators import events
from ..operators import relational as rel
from . import tables as t
from .registry import cpf, query, r6

CITY = "delhi"
#: Hours ahead with their confidence, and how much of the present a forecast keeps.
HORIZONS = {24: ("high", 0.6), 48: ("med", 0.4), 72: ("low", 0.2)}
#: Of a normal distribution, the 90th percentile in standard deviations.
Q90 = 1.2816
RISKS = ("low", "moderate", "high", "severe")
#: Messages by risk and language; a city may bring its own.
MESSAGES = {
    "low": {"en": "Air is fine for all.", "hi": "Hava sabke liye theek hai.", "mr": "Hava sarvansathi changli aahe."},
    "moderate": {"en": "Sensitive people should take it easy.", "hi": "Samvedansheel log aaram karein.", "mr": "Samvedanshil lokanni aaram karava."},
    "high": {"en": "Stay in when you can; wear a mask.", "hi": "Ho sake to ghar mein rahein; mask lagayein.", "mr": "Shakya asel tar gharat raha; mask vapara."},
    "severe": {"en": "Stay in; help children and the old.", "hi": "Ghar mein rahein; bachchon aur budhon ka dhyan rakhein.", "mr": "Gharat raha; mule ani vruddhanchi kalji ghya."},
}
ACTIONS = {"traffic": "traffic_management", "industry": "inspect_industry", "biomass": "stop_burning", "dust": "suppress_dust", "residential_other": "outreach"}
#: Earlier starts that are asked about, in hours.
SHIFTS = (-72, -48, -24)
#: Rank of the category from which a ward is at risk, and how many candidates a digest has.
RISK_FLOOR, CANDIDATES = 3, 8


def document(rows: DataFrame, name: str, city: str = CITY, **head: Column) -> DataFrame:
    """One row: the rows as an array sorted by their first columns, in a JSON text without nulls."""
    packed = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))
    return packed.select(F.to_json(F.struct(F.lit(city).alias("city"), *(c.alias(k) for k, c in head.items()), name)).alias("document"))


def entries(doc: DataFrame, name: str, kind: str) -> DataFrame:
    """The rows of a document's array; what the type doesn't name is left out."""
    schema = f"city string, {name} array<struct<{kind}>>"
    return doc.select(F.from_json("document", schema).alias("d")).select(F.explode(f"d.{name}").alias("r")).select("r.*")


def kind_of(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema)


def republished(rows: DataFrame, name: str = "wards") -> DataFrame:
    """The rows as they are read back from their document."""
    return entries(document(rows, name), name, kind_of(rows))


# Estimates.


def recent(spark, d, hours: int) -> DataFrame:
    obs = t.obs_hour(spark, d)
    return obs.join(F.broadcast(obs.agg(F.max("h").alias("last"))), F.col("h") > F.col("last") - hours)


def ward_km(spark, d) -> DataFrame:
    """Distance of each ward to each station: a dimension by a dimension."""
    w = t.ward_points(spark, d).select("ward_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    return w.join(F.broadcast(t.station(spark))).select("ward_id", "station", geo.haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")).alias("km"))


def weighted(value: str) -> Column:
    w = 1 / F.pow(F.greatest(F.col("km"), F.lit(1e-9)), F.lit(2))
    return F.sum(F.col(value) * w) / F.sum(w)


def indexed(rows: DataFrame) -> DataFrame:
    """Adds the sub-index of ``pm25_p50`` and its category."""
    return rows.withColumn("subindex24h", aqi.sub_index("pm25", F.col("pm25_p50"))).withColumn("category", aqi.category(F.col("subindex24h")))


_KM = "SELECT w.ward_id, s.station, " + t.haversine_sql("w", "s") + " AS km FROM wardpt w, station s"
_WEIGHTED = "sum({0} / pow(greatest(km, 1e-9), 2)) / sum(1 / pow(greatest(km, 1e-9), 2))"
t.NEEDED |= {"ward_km": ["wardpt", "station"], "nowcast": ["obs", "ward_km"], "forecast": ["nowcast"], "cpf": ["met"], "shares": ["wardpt", "station", "cpf"], "hours168": ["obs", "ward_km"],
             "enforcement": ["hours168", "shares", "nowcast", "wardpt"], "ledger": ["nowcast", "wardpt", "season"]}
t.SQL["ward_km"] = _KM
t.SQL["nowcast"] = ("SELECT *, " + t.category_sql("subindex24h") + " AS category FROM (SELECT *, " + t.sub_index_sql("pm25", "pm25_p50") + f" AS subindex24h FROM (SELECT ward_id, round({_WEIGHTED.format('m')}, 4) AS pm25_p50, "
                    f"round({_WEIGHTED.format('m')} + {Q90} * {_WEIGHTED.format('sd')}, 4) AS pm25_p90, CASE WHEN min(km) <= 3 THEN 'high' WHEN min(km) <= 9 THEN 'med' ELSE 'low' END AS confidence "
                    "FROM ward_km JOIN (SELECT station, avg(pm25) AS m, coalesce(stddev_samp(pm25), 0) AS sd FROM obs WHERE h > (SELECT max(h) - 24 FROM obs) GROUP BY 1) USING (station) GROUP BY 1))")


def nowcast(spark, d) -> DataFrame:
    """Wards with the inverse-distance mean of the stations' last 24 hours, its 90th percentile, index, category and confidence."""
    means = recent(spark, d, 24).groupBy("station").agg(F.avg("pm25").alias("m"), F.coalesce(F.stddev_samp("pm25"), F.lit(0.0)).alias("sd"))
    est = ward_km(spark, d).join(means, "station").groupBy("ward_id").agg(weighted("m").alias("m"), weighted("sd").alias("sd"), F.min("km").alias("km"))
    return indexed(est.select("ward_id", F.round("m", 4).alias("pm25_p50"), F.round(F.col("m") + Q90 * F.col("sd"), 4).alias("pm25_p90"), domain.distance_confidence(F.col("km")).alias("confidence")))


@query("B4_nowcast", "SELECT ward_id, pm25_p50, pm25_p90, confidence, subindex24h, category FROM nowcast", "nowcast")
def _(spark, d):
    return republished(nowcast(spark, d))


_HOUR = "CAST(floor(({} * 60 + 330) / 60) % 24 AS BIGINT)"
t.SQL["forecast"] = ("SELECT *, " + t.category_sql("subindex24h") + " AS category FROM (SELECT *, " + t.sub_index_sql("pm25", "pm25_p50") + " AS subindex24h FROM (SELECT ward_id, hz AS h, conf AS confidence, "
                     f"round(keep * any_value(n.pm25_p50) + (1 - keep) * {_WEIGHTED.format('m')}, 4) AS pm25_p50, round(keep * any_value(n.pm25_p50) + (1 - keep) * {_WEIGHTED.format('m')} + {Q90} * {_WEIGHTED.format('sd')}, 4) AS pm25_p90 "
                     "FROM ward_km JOIN (SELECT station, " + _HOUR.format("h") + " AS hod, avg(pm25) AS m, coalesce(stddev_samp(pm25), 0) AS sd FROM obs GROUP BY 1, 2) c USING (station) "
                     "JOIN (VALUES " + ", ".join(f"({h}, '{c}', {k}::DOUBLE)" for h, (c, k) in HORIZONS.items()) + ") z(hz, conf, keep) ON hod = " + _HOUR.format("((SELECT max(h) FROM obs) + hz)") + " JOIN nowcast n USING (ward_id) GROUP BY ward_id, hz, conf, keep))")


def _hour(h: Column) -> Column:
    return (F.floor((h * 60 + 330) / 60) % 24).cast("long")


def forecast(spark, d) -> DataFrame:
    """A row a ward and horizon: the present blended with the level that is usual at that hour of the day."""
    obs = t.obs_hour(spark, d)
    usual = obs.groupBy("station", _hour(F.col("h")).alias("hod")).agg(F.avg("pm25").alias("m"), F.coalesce(F.stddev_samp("pm25"), F.lit(0.0)).alias("sd"))
    ahead = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(c).alias("confidence"), F.lit(k).alias("keep")) for h, (c, k) in HORIZONS.items())))
    wanted = obs.agg(F.max("h").alias("last")).select("last", ahead.alias("z")).select("z.*", _hour(F.col("last") + F.col("z.h")).alias("hod"))
    means = usual.join(F.broadcast(wanted), "hod")  # stations by horizons
    est = ward_km(spark, d).join(means, "station").groupBy("ward_id", "h", "confidence", "keep").agg(weighted("m").alias("m"), weighted("sd").alias("sd"))
    now = nowcast(spark, d).select("ward_id", F.col("pm25_p50").alias("now"))
    p50 = F.col("keep") * F.col("now") + (1 - F.col("keep")) * F.col("m")
    return indexed(est.join(now, "ward_id").select("ward_id", "h", "confidence", F.round(p50, 4).alias("pm25_p50"), F.round(p50 + Q90 * F.col("sd"), 4).alias("pm25_p90")))


def forecast_wards(rows: DataFrame, *keys: str) -> DataFrame:
    """A row a ward (or other keys) with its series by horizon; wards without all horizons are left out."""
    keys = keys or ("ward_id",)
    parts = [c for c in rows.columns if c not in keys]
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", *(c for c in parts if c != "h")))).alias("series"))
    return whole.where((F.size("series") == len(HORIZONS)) & F.forall("series", lambda s: s["pm25_p50"].isNotNull() & ~F.isnan(s["pm25_p50"])))


@query("B5_forecast", "SELECT ward_id, h, confidence, pm25_p50, pm25_p90, subindex24h, category FROM forecast", "forecast")
def _(spark, d):
    return republished(forecast_wards(forecast(spark, d))).select("ward_id", F.explode("series").alias("s")).select("ward_id", "s.*")


def sector_mean(low: float, high: float) -> Column:
    """Mean of ``p`` over sectors of 30 degrees whose centre lies between two bearings, over north if the first is larger; 0 if there is none."""
    centre = F.col("sector") * 30 + 15
    return F.coalesce(F.avg(F.when(geo.in_range(centre, low, high), F.col("p"))), F.lit(0.0))


_CENTRE = "(sector * 30 + 15)"
t.SQL["cpf"] = "SELECT m.station, CAST(floor(wind_dir / 30) AS BIGINT) AS sector, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN pm25 > q THEN 1.0 ELSE 0.0 END) END AS p FROM met m JOIN (SELECT station, quantile_cont(pm25, 0.75) AS q FROM met GROUP BY 1) USING (station) GROUP BY 1, 2"
_SECTORS = f"SELECT station, coalesce(avg(p) FILTER (WHERE {_CENTRE} BETWEEN 285 AND 345), 0) AS nw, coalesce(avg(p) FILTER (WHERE {_CENTRE} >= 300 OR {_CENTRE} <= 60), 0) AS north FROM cpf GROUP BY 1"


@query("D10_sector_mean", f"SELECT station, round(nw, 6) AS nw, round(north, 6) AS north FROM ({_SECTORS})", "cpf")
def _(spark, d):
    return cpf(spark, d).groupBy("station").agg(r6(sector_mean(285, 345)).alias("nw"), r6(sector_mean(300, 60)).alias("north"))


_UNIT = "least(1.0, greatest(0.0, {}))"
t.SQL["shares"] = ("SELECT ward_id, list_transform(s, lambda x, i: CASE WHEN i = list_position(s, list_max(s)) THEN round(x + round(1.0 - list_sum(s), 3), 3) ELSE x END) AS s FROM (SELECT ward_id, list_transform(raw, lambda x: round(x / list_sum(raw), 3)) AS s FROM ("
                   f"SELECT ward_id, [0.20 + 0.9 * {_UNIT.format('road')}, 0.12 + 1.4 * near / (near + 0.5) + 0.6 * {_UNIT.format('north')}, 0.08 + 1.2 * {_UNIT.format('nw')} + 0.5 * {_UNIT.format('frp / 200.0')}, 0.18 + 0.5 * (1.0 - {_UNIT.format('built')}), 0.12 + 0.8 * {_UNIT.format('built')}] AS raw FROM ("
                   "SELECT ward_id, (k * 7 % 10) / 10.0::DOUBLE AS road, (k * 3 % 10) / 10.0::DOUBLE AS built, 1.0::DOUBLE / greatest(0.5::DOUBLE, k % 6 + 0.3::DOUBLE) AS near, (k * 11 % 200)::DOUBLE AS frp, nw, north FROM ("
                   "SELECT ward_id, k, arg_min(station, km * 100000 + station) AS station FROM (SELECT w.ward_id, w.k, s.station, " + t.haversine_sql("w", "s") + f" AS km FROM wardpt w, station s) GROUP BY 1, 2) JOIN ({_SECTORS}) USING (station))))")


def attribution(spark, d) -> DataFrame:
    """``ward_id, shares, confidence``: sources of each ward from its land use and the signals of its nearest station."""
    signals = cpf(spark, d).groupBy("station").agg(sector_mean(285, 345).alias("nw"), sector_mean(300, 60).alias("north"))
    points = t.ward_points(spark, d)
    w = points.join(rel.nearest(points, t.station(spark), ["ward_id"], "station").select("ward_id", "station"), "ward_id").join(signals, "station")
    k = F.col("k")
    parts = domain.source_shares((k * 7 % 10) / F.lit(10.0), (k * 3 % 10) / F.lit(10.0), k % 6 + F.lit(0.3), (k * 11 % 200).cast("double"), F.col("nw"), F.col("north"))
    rows = w.select("ward_id", parts.alias("shares"))
    return rows.withColumn("confidence", domain.share_confidence(F.greatest(*(F.col("shares")[s] for s in domain.SHARES))))


@query("B6_attribution", "SELECT ward_id, " + ", ".join(f"s[{i + 1}] AS {n}" for i, n in enumerate(domain.SHARES)) + ", CASE WHEN list_max(s) > 0.38 THEN 'high' WHEN list_max(s) > 0.30 THEN 'med' ELSE 'low' END AS confidence FROM shares", "shares")
def _(spark, d):
    return republished(attribution(spark, d)).select("ward_id", "shares.*", "confidence")


def dominant(shares: Column) -> Column:
    """struct<share, name> of the largest share, the first of equals."""
    best = F.array_max(F.array(*(F.struct(shares[n].alias("share"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(domain.SHARES))))
    return F.get(F.transform(F.array(best), lambda b: F.struct(b["share"].alias("share"), b["name"].alias("name"))), 0)


def source_label(shares: Column) -> Column:
    """The dominant source if it has more than 0.3, else ``mixed``."""
    return F.get(F.transform(F.array(dominant(shares)), lambda b: F.when(b["share"] > 0.3, b["name"]).otherwise("mixed")), 0)


_LABEL = "CASE WHEN list_max(s) > 0.3 THEN ['" + "', '".join(domain.SHARES) + "'][list_position(s, list_max(s))] ELSE 'mixed' END"


@query("D12_source_labels", f"SELECT ward_id, {_LABEL} AS label FROM shares", "shares")
def _(spark, d):
    return attribution(spark, d).select("ward_id", source_label(F.col("shares")).alias("label"))


t.SQL["hours168"] = f"SELECT ward_id, h, {_WEIGHTED.format('pm25')} AS pm25 FROM ward_km JOIN (SELECT * FROM obs WHERE h > (SELECT max(h) - 168 FROM obs)) USING (station) GROUP BY 1, 2"
_ACTION = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " ELSE 'monitor_no_action' END"
t.SQL["enforcement"] = (
    "SELECT *, row_number() OVER (ORDER BY priority_score DESC, ward_id) AS place FROM (SELECT ward_id, exceedance_pct, persistence_days, label AS source_label, " + _ACTION + " AS action, "
    "round(least(100.0, greatest(0.0, 0.10 * subindex24h + 3.0 * persistence_days + 0.25 * exceedance_pct + 25.0 * population / largest)), 1) AS priority_score FROM ("
    "SELECT ward_id, round(avg(CASE WHEN pm25 > 60 THEN 100.0 ELSE 0.0 END), 4) AS exceedance_pct FROM hours168 GROUP BY 1 HAVING count(*) >= 24) JOIN ("
    "SELECT ward_id, count(*) FILTER (WHERE m > 60) AS persistence_days FROM (SELECT ward_id, CAST(floor((n - 1) / 24) AS BIGINT) AS b, avg(pm25) AS m FROM (SELECT *, row_number() OVER (PARTITION BY ward_id ORDER BY h DESC) AS n, count(*) OVER (PARTITION BY ward_id) AS c FROM hours168) WHERE floor((n - 1) / 24) < floor(c / 24) GROUP BY 1, 2) GROUP BY 1) USING (ward_id) "
    f"JOIN (SELECT ward_id, {_LABEL} AS label FROM shares) USING (ward_id) JOIN nowcast USING (ward_id) JOIN (SELECT ward_id, population, max(population) OVER () AS largest FROM wardpt) USING (ward_id))")


def ward_hours(spark, d, hours: int) -> DataFrame:
    """Inverse-distance estimate of each ward for each of the last hours."""
    return recent(spark, d, hours).select("station", "h", "pm25").join(ward_km(spark, d), "station").groupBy("ward_id", "h").agg(weighted("pm25").alias("pm25"))


def enforcement(spark, d) -> DataFrame:
    """Wards ranked by priority, with the evidence, source and action; wards with fewer than 24 hours are left out."""
    by = Window.partitionBy("ward_id")
    n = ward_hours(spark, d, 168).withColumns({"n": F.row_number().over(by.orderBy(F.desc("h"))), "c": F.count(F.lit(1)).over(by)}).where("c >= 24")
    share = n.groupBy("ward_id").agg(F.round(F.avg(F.when(F.col("pm25") > aqi_norm(), 100.0).otherwise(0.0)), 4).alias("exceedance_pct"))
    blocks = n.where(F.floor((F.col("n") - 1) / 24) < F.floor(F.col("c") / 24)).groupBy("ward_id", F.floor((F.col("n") - 1) / 24).alias("b")).agg(F.avg("pm25").alias("m"))
    days = blocks.groupBy("ward_id").agg(F.count_if(F.col("m") > aqi_norm()).alias("persistence_days"))
    labels = attribution(spark, d).select("ward_id", source_label(F.col("shares")).alias("source_label"))
    people = t.ward_points(spark, d).select("ward_id", "population", F.max("population").over(Window.partitionBy()).alias("largest"))
    rows = reduce(lambda a, b: a.join(b, "ward_id"), (days, labels, nowcast(spark, d).select("ward_id", "subindex24h"), people), share)
    score = domain.priority(F.col("subindex24h"), F.col("persistence_days"), F.col("exceedance_pct"), F.col("population"), F.col("largest"))
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    rows = rows.select("ward_id", "exceedance_pct", "persistence_days", "source_label", F.coalesce(action[F.col("source_label")], F.lit("monitor_no_action")).alias("action"), score.alias("priority_score"))
    return rows.select(F.row_number().over(Window.orderBy(F.desc("priority_score"), "ward_id")).alias("place"), "*")  # a row a ward


def aqi_norm() -> Column:
    return F.lit(domain.NORM)


@query("B7_enforcement", "SELECT place, ward_id, exceedance_pct, persistence_days, source_label, action, priority_score FROM enforcement", "enforcement")
def _(spark, d):
    return republished(enforcement(spark, d), "ranked")


_RISK = "CASE WHEN subindex24h <= 100 THEN 'low' WHEN subindex24h <= 200 THEN 'moderate' WHEN subindex24h <= 300 THEN 'high' ELSE 'severe' END"


def advisories(wards: DataFrame, regional: Column) -> DataFrame:
    """``ward_id, risk_level, langs``: the messages in English, Hindi and, where one is declared, the regional language.
    ``regional``: its code or null."""
    risk = domain.risk_level(F.col("subindex24h"))
    texts = F.create_map(*[F.lit(x) for r, by in MESSAGES.items() for lang, text in by.items() for x in (f"{r}:{lang}", text)])
    wanted = F.array_distinct(F.array_compact(F.array(F.lit("en"), F.lit("hi"), regional)))
    rows = wards.select("ward_id", risk.alias("risk_level"), wanted.alias("_l"))
    langs = F.transform("_l", lambda x: F.struct(x.alias("lang"), F.try_element_at(texts, F.concat_ws(":", "risk_level", x)).alias("text")))
    return rows.select("ward_id", "risk_level", F.filter(langs, lambda x: x["text"].isNotNull()).alias("langs"))


@query("B8_advisories", f"SELECT ward_id, risk_level, lang, text FROM (SELECT ward_id, {_RISK} AS risk_level FROM nowcast) JOIN (VALUES " + ", ".join(f"('{r}', '{lang}', '{text}')" for r, by in MESSAGES.items() for lang, text in by.items()) + ") m(risk, lang, text) ON risk = risk_level WHERE lang <> 'mr' OR CAST(right(ward_id, 3) AS INT) % 3 = 0", "nowcast")
def _(spark, d):
    regional = F.when(F.substring("ward_id", -3, 3).cast("int") % 3 == 0, "mr")
    return republished(advisories(nowcast(spark, d), regional)).select("ward_id", "risk_level", F.explode("langs").alias("l")).select("ward_id", "risk_level", "l.*")


def ledger_rows(wards: DataFrame, season: DataFrame) -> DataFrame:
    """Of wards ``ward_id, pm, population``: effect and avoided exposure and deaths with bounds, scaled by the ward's level
    against the city's, rounded as they are published. ``season``: one row eff, e_lo, e_hi and hours in force."""
    scale = F.greatest(F.lit(0.2), F.col("pm") / F.col("city"))
    rows = wards.withColumn("city", F.avg("pm").over(Window.partitionBy())).withColumn("s", scale)  # a row a ward
    rows = rows.join(F.broadcast(season)).withColumns({n: F.round(F.col(n) * F.col("s"), 1) for n in ("eff", "e_lo", "e_hi")})
    deaths = {n: F.round(domain.avoided_deaths(F.col("pm"), F.col("pm") - F.col(e), F.col("population")), 3) for n, e in (("deaths", "eff"), ("_a", "e_lo"), ("_b", "e_hi"))}
    rows = rows.withColumns(deaths)
    return rows.select("ward_id", F.round(F.col("population") * F.abs("eff") * F.col("hours"), 1).alias("exposure"), "deaths", F.least("_a", "_b", "deaths").alias("ci_low"), F.greatest("_a", "_b", "deaths").alias("ci_high"), F.col("eff").alias("effect"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: sums of the published, rounded values."""
    return rows.agg(F.round(F.sum("exposure"), 1).alias("exposure"), *(F.round(F.sum(c), 1).alias(c) for c in ("deaths", "ci_low", "ci_high")))


def counterfactuals(total: DataFrame, season: DataFrame) -> DataFrame:
    """What starting earlier would have added, by shift."""
    shifts = total.join(F.broadcast(season.select("hours"))).withColumn("shift", F.explode(F.array(*map(F.lit, SHIFTS)))).withColumn("f", F.abs("shift") / F.col("hours"))
    return shifts.select("shift", F.round(F.col("exposure") * F.col("f"), 1).alias("exposure"), *(F.round(F.col(c) * F.col("f"), 2).alias(c) for c in ("deaths", "ci_low", "ci_high")))


# The event study: a daily series of orders stands for the city's, as it is the only one of some years.

#: A measure's stage with the days (since 1970) on which it began and ended, and the transition it is scored by.
MEASURES = (("III", 9921, 9928, "III invoked"), ("IV", 10392, 10395, "IV invoked"), ("IV", 10915, None, "IV invoked again"), ("II", 9900, 9990, None))


def daily_series(spark, d) -> DataFrame:
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return t.read(spark, d, "orders").groupBy(day.alias("x")).agg((F.avg("o_totalprice") / 1000).alias("v"))


def scored_events(spark) -> DataFrame:
    return spark.createDataFrame([(label, day) for _, day, _, label in MEASURES if label], "label string, day long")


def event_effects(spark, d) -> DataFrame:
    return events.effects(daily_series(spark, d), scored_events(spark))


def season(spark, d) -> DataFrame:
    """One row: the season's effect from its events, and the hours its measures were in force."""
    rows = spark.createDataFrame([(stage, a * 86400, None if b is None else b * 86400) for stage, a, b, _ in MEASURES], "stage string, a long, b long")
    calendar = rows.select("stage", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    return events.season(event_effects(spark, d)).join(F.broadcast(events.active_hours(calendar)))


_DRAW = "('0x' || substr(md5('0:' || {}), 1, 8))::BIGINT"
_MEAN = "list_aggregate(list_transform(range(len({0})), lambda j: {0}[CAST(" + _DRAW.format("day || ':{0}:' || k || ':' || CAST(floor(j / 3) AS INTEGER)") + " % greatest(1, len({0}) - 2) + j % 3 + 1 AS INTEGER)]), 'avg')"
t.SQL["daily"] = "SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS x, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY 1"
t.SQL["scored"] = "SELECT * FROM (VALUES " + ", ".join(f"('{label}', {day}::BIGINT)" for _, day, _, label in MEASURES if label) + ") e(label, day)"
t.SQL["sides"] = "SELECT label, day, list(v ORDER BY x) FILTER (WHERE x < day) AS pre, list(v ORDER BY x) FILTER (WHERE x >= day) AS post, count(*) AS n_days FROM scored JOIN daily ON x >= day - 10 AND x < day + 10 GROUP BY 1, 2"
t.SQL["boot"] = "SELECT day, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi FROM (SELECT day, " + _MEAN.format("post") + " - " + _MEAN.format("pre") + " AS e FROM sides, range(600) r(k) WHERE len(pre) >= 3 AND len(post) >= 3) GROUP BY 1"
t.SQL["placebo"] = ("SELECT p.day, avg(v) FILTER (WHERE x >= p.day) - avg(v) FILTER (WHERE x < p.day) AS e FROM (SELECT c.day FROM (SELECT unnest(range(lo, hi + 1)) AS day FROM (SELECT min(x) + 10 AS lo, max(x) - 10 AS hi FROM daily)) c "
                    "WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE abs(s.day - c.day) <= 21) ORDER BY " + _DRAW.format("c.day") + ", c.day LIMIT 300) p LEFT JOIN daily ON x >= p.day - 10 AND x < p.day + 10 GROUP BY 1")
t.SQL["effects"] = ("SELECT label, day, round(real, 1) AS effect, least(round(lo, 1), round(real, 1)) AS ci_low, greatest(round(hi, 1), round(real, 1)) AS ci_high, coalesce(real < 0 AND share <= 0.2, false) AS placebo_pass, round(share, 6) AS percentile, n_days FROM ("
                    "SELECT label, day, n_days, list_aggregate(post, 'avg') - list_aggregate(pre, 'avg') AS real, lo, hi, (SELECT avg(CASE WHEN e < list_aggregate(post, 'avg') - list_aggregate(pre, 'avg') THEN 1.0 ELSE 0.0 END) FROM placebo) AS share FROM sides JOIN boot USING (day)) WHERE n_days >= 10")
_HOURS = sum((b - a) * 24 for stage, a, b, _ in MEASURES if stage in ("III", "IV") and b is not None)
t.SQL["season"] = "SELECT " + ", ".join(f"coalesce(avg({c}) FILTER (WHERE placebo_pass), avg({c})) AS {n}" for c, n in (("effect", "eff"), ("ci_low", "e_lo"), ("ci_high", "e_hi"))) + f", {max(_HOURS, 24)}::DOUBLE AS hours FROM effects"
t.NEEDED |= {"sides": ["daily", "scored"], "boot": ["sides"], "placebo": ["daily", "scored"], "effects": ["sides", "boot", "placebo"], "season": ["effects"]}


@query("M12_placebo", "SELECT label, effect, percentile, placebo_pass, (SELECT count(*) FROM placebo) AS pool FROM effects", "effects")
def _(spark, d):
    """How each event's effect stands among those of days that lie far from all events."""
    pool = events.placebos(daily_series(spark, d), scored_events(spark)).agg(F.count(F.lit(1)).alias("pool"))
    return event_effects(spark, d).join(F.broadcast(pool)).select("label", "effect", "percentile", "placebo_pass", "pool")


@query("M13_bootstrap", "SELECT day, round(lo, 5) AS lo, round(hi, 5) AS hi FROM boot", "boot")
def _(spark, d):
    """The interval of each event's difference, from blocks of days drawn on both sides."""
    found = events.intervals(events.windows(daily_series(spark, d), scored_events(spark).select("day")))
    return found.select("day", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


@query("M14_effects", "SELECT * FROM effects", "effects")
def _(spark, d):
    return event_effects(spark, d)


_HRS = "exp(0.1430 * ln(1 + greatest(0.0, ({0}) - 2.4) / 1.6) / (1 + exp(-(greatest(0.0, ({0}) - 2.4) - 15.5) / 36.8)))"
_AF = f"(({_HRS} - 1) / {_HRS})"
_DEATHS = "round(population * 0.66 * 0.009 * (" + _AF.format("pm - {0}") + " - " + _AF.format("pm") + "), 3)"
t.SQL["ledger"] = ("SELECT ward_id, round(population * abs(eff) * hours, 1) AS exposure, deaths, least(a, b, deaths) AS ci_low, greatest(a, b, deaths) AS ci_high, eff AS effect FROM (SELECT *, " + ", ".join(f"{_DEATHS.format(e)} AS {n}" for n, e in (("deaths", "eff"), ("a", "e_lo"), ("b", "e_hi")))
                   + " FROM (SELECT ward_id, population, pm, hours, round((season.eff * s)::DECIMAL(18, 6), 1)::DOUBLE AS eff, round((season.e_lo * s)::DECIMAL(18, 6), 1)::DOUBLE AS e_lo, round((season.e_hi * s)::DECIMAL(18, 6), 1)::DOUBLE AS e_hi FROM season, (SELECT ward_id, population, pm25_p50 AS pm, greatest(0.2, pm25_p50 / avg(pm25_p50) OVER ()) AS s FROM nowcast JOIN wardpt USING (ward_id))))")


def ledger(spark, d) -> DataFrame:
    people = t.ward_points(spark, d).select("ward_id", "population")
    return ledger_rows(nowcast(spark, d).select("ward_id", F.col("pm25_p50").alias("pm")).join(people, "ward_id"), season(spark, d))


@query("B9_ledger", "SELECT ward_id, exposure, deaths, ci_low, ci_high, effect FROM ledger", "ledger")
def _(spark, d):
    return republished(ledger(spark, d))


_TOTALS = "SELECT round(sum(exposure), 1) AS exposure, round(sum(deaths), 1) AS deaths, round(sum(ci_low), 1) AS ci_low, round(sum(ci_high), 1) AS ci_high FROM ledger"


@query("A20_ledger_totals", _TOTALS, "ledger")
def _(spark, d):
    return totals(ledger(spark, d))


@query("B9_counterfactuals", f"SELECT shift, round(exposure * abs(shift) / hours, 1) AS exposure, round(deaths * (abs(shift) / hours), 2) AS deaths, round(ci_low * (abs(shift) / hours), 2) AS ci_low, round(ci_high * (abs(shift) / hours), 2) AS ci_high FROM ({_TOTALS}), season, (VALUES (-72), (-48), (-24)) s(shift)", "ledger")
def _(spark, d):
    return counterfactuals(totals(ledger(spark, d)), season(spark, d))


# The digest, and lookups over documents.


def category_rank(category: Column) -> Column:
    names = [n for n, _ in aqi.CATEGORIES]
    return F.coalesce(*(F.when(category == n, F.lit(i)) for i, n in enumerate(names)), F.lit(-1))


def digest(now: DataFrame, ahead: DataFrame, ranked: DataFrame, sources: DataFrame, books: DataFrame, floor: int = RISK_FLOOR, most: int = CANDIDATES) -> DataFrame:
    """The wards at risk now or ahead by compound score, with what the other documents say about them."""
    worst = ahead.groupBy("ward_id").agg(F.max(category_rank(F.col("category"))).alias("f"))
    joined = (worst.join(now.select("ward_id", F.col("category").alias("now"), F.col("pm25_p90").alias("now_p90")), "ward_id", "left")
              .join(ranked.select("ward_id", "priority_score", "action"), "ward_id", "left")
              .join(sources.select("ward_id", dominant(F.col("shares")).alias("d")), "ward_id", "left")
              .join(books.select("ward_id", "effect"), "ward_id", "left"))
    rows = joined.withColumn("worst_rank", F.greatest("f", category_rank(F.col("now")))).where(F.col("worst_rank") >= floor)
    score = F.round(10.0 * F.greatest(F.col("worst_rank") - floor + 1, F.lit(0)) + F.coalesce("priority_score", F.lit(0.0)), 3)
    return (rows.withColumn("compound_score", score).orderBy(F.desc("compound_score"), "ward_id").limit(most)
            .select("ward_id", "worst_rank", "now", "now_p90", "priority_score", "action", F.col("d.name").alias("dominant"), F.col("d.share").alias("share"), "effect", "compound_score"))


def _rank_sql(c: str) -> str:
    return f"coalesce(list_position({[n for n, _ in aqi.CATEGORIES]}, {c}) - 1, -1)"


@query("B13_digest", "SELECT ward_id, worst_rank, n.category AS now, n.pm25_p90 AS now_p90, priority_score, action, ['" + "', '".join(domain.SHARES) + "'][list_position(s, list_max(s))] AS dominant, list_max(s) AS share, effect, round(10.0 * worst_rank + priority_score, 3) AS compound_score FROM ("
       "SELECT ward_id, CAST(greatest(f, " + _rank_sql("x.category") + ") AS INTEGER) AS worst_rank FROM (SELECT ward_id, max(" + _rank_sql("category") + ") AS f FROM forecast GROUP BY 1) JOIN nowcast x USING (ward_id)) JOIN nowcast n USING (ward_id) JOIN enforcement USING (ward_id) JOIN shares USING (ward_id) JOIN ledger USING (ward_id) WHERE worst_rank >= 1 ORDER BY compound_score DESC, ward_id LIMIT 8", "forecast enforcement shares ledger")
def _(spark, d):
    return digest(nowcast(spark, d), forecast(spark, d), enforcement(spark, d), attribution(spark, d), ledger(spark, d), floor=1)


@query("J17_ward_views", "SELECT n.ward_id, hz AS h, coalesce(f.subindex24h, n.subindex24h) AS subindex, coalesce(f.pm25_p50, n.pm25_p50) AS pm25_p50, coalesce(f.confidence, n.confidence) AS confidence FROM nowcast n CROSS JOIN (VALUES (0), (24), (48), (72)) z(hz) "
       "LEFT JOIN forecast f ON f.ward_id = n.ward_id AND f.h = hz", "forecast")
def _(spark, d):
    """Each ward's view at each horizon: the forecast, or the nowcast where there is none, as for the present."""
    return ward_views(nowcast(spark, d), forecast(spark, d))


def ward_views(now: DataFrame, ahead: DataFrame) -> DataFrame:
    hours = now.withColumn("h", F.explode(F.array(F.lit(0), *map(F.lit, HORIZONS))))
    f = ahead.select("ward_id", "h", *(F.col(c).alias(f"f_{c}") for c in ("subindex24h", "pm25_p50", "confidence")))
    both = hours.join(f, ["ward_id", "h"], "left")
    return both.select("ward_id", "h", *(F.coalesce(f"f_{c}", c).alias(n) for c, n in (("subindex24h", "subindex"), ("pm25_p50", "pm25_p50"), ("confidence", "confidence"))))


@query("A29_trajectory", "SELECT h, list_sort(list(subindex24h))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS subindex, list_sort(list(pm25_p50))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS p50 FROM (SELECT 0 AS h, subindex24h, pm25_p50 FROM nowcast UNION ALL SELECT h, subindex24h, pm25_p50 FROM forecast) GROUP BY 1", "forecast")
def _(spark, d):
    views = ward_views(nowcast(spark, d), forecast(spark, d))
    # A row a ward and horizon: the upper median of a list of wards.
    upper = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(F.lit(1)) / 2).cast("int"))
    return views.groupBy("h").agg(upper("subindex").alias("subindex"), upper("pm25_p50").alias("p50"))


def lookup(doc: DataFrame, name: str, kind: str, ward_id: str | None = None, order: list[Column] | None = None, top: int = 12) -> DataFrame:
    """The entry of a ward, or without one the first ``top`` in order."""
    rows = entries(doc, name, kind)
    if ward_id is not None:
        return rows.where(F.col("ward_id") == ward_id)
    return rows.orderBy(*(order or [F.col("ward_id")])).limit(top)


@query("T2_get_forecast", "SELECT ward_id, h, pm25_p50 FROM forecast WHERE ward_id = 'delhi_007' AND h = 48", "forecast")
def _(spark, d):
    rows = forecast_wards(forecast(spark, d))
    one = lookup(document(rows, "wards"), "wards", kind_of(rows), "delhi_007")
    return one.select("ward_id", F.explode(F.filter("series", lambda s: s["h"] == 48)).alias("s")).select("ward_id", "s.h", "s.pm25_p50")


@query("T3_get_attribution", "SELECT ward_id, s[1] AS traffic, s[5] AS residential_other FROM shares WHERE ward_id = 'delhi_003'", "shares")
def _(spark, d):
    rows = attribution(spark, d)
    return lookup(document(rows, "wards"), "wards", kind_of(rows), "delhi_003").select("ward_id", "shares.traffic", "shares.residential_other")


@query("T4_get_enforcement", "SELECT place, ward_id, priority_score FROM enforcement WHERE place <= 5", "enforcement")
def _(spark, d):
    rows = enforcement(spark, d)
    return lookup(document(rows, "ranked"), "ranked", kind_of(rows), order=[F.col("place")], top=5).select("place", "ward_id", "priority_score")


@query("T5_get_ledger", "SELECT ward_id, exposure, deaths FROM ledger WHERE ward_id = 'delhi_011'", "ledger")
def _(spark, d):
    rows = ledger(spark, d)
    return lookup(document(rows, "wards"), "wards", kind_of(rows), "delhi_011").select("ward_id", "exposure", "deaths")


def ledger_document(spark, d) -> DataFrame:
    """The ledger as it is published: totals of the rounded values, wards, and what acting earlier would have added."""
    rows = ledger(spark, d)
    sums = totals(rows)
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  wards; shifts
    whole = listed(rows, "wards").join(listed(counterfactuals(sums, season(spark, d)), "counterfactuals")).join(sums.select(F.struct(*sums.columns).alias("totals")))
    return whole.select(F.to_json(F.struct(F.lit(CITY).alias("city"), "totals", "wards", "counterfactuals")).alias("document"))


_SHIFTED = "SELECT shift, round(exposure * abs(shift) / hours, 1) AS exposure, round(deaths * (abs(shift) / hours), 2) AS deaths FROM (" + _TOTALS + "), season, (VALUES (-72), (-48), (-24)) s(shift)"


@query("T5_ledger_totals", f"SELECT 0 AS shift, exposure, deaths FROM ({_TOTALS}) UNION ALL {_SHIFTED}", "ledger")
def _(spark, d):
    """What the ledger says without a ward: its totals (shift 0) and counterfactuals."""
    kind = "city string, totals struct<exposure: double, deaths: double>, counterfactuals array<struct<shift: int, exposure: double, deaths: double>>"
    doc = ledger_document(spark, d).select(F.from_json("document", kind).alias("d")).select("d.*")
    rows = F.concat(F.array(F.struct(F.lit(0).alias("shift"), F.col("totals.exposure").alias("exposure"), F.col("totals.deaths").alias("deaths"))), "counterfactuals")
    return doc.select(F.inline(rows))


@query("T8_get_fires", "SELECT y, x, n, frp FROM (SELECT CAST(round_even(lat / 0.05, 0) AS BIGINT) AS y, CAST(round_even(lon / 0.05, 0) AS BIGINT) AS x, count(*) AS n, round(sum(frp), 4) AS frp FROM fires WHERE s > (SELECT max(s) - 259200 FROM fires) GROUP BY 1, 2) ORDER BY frp DESC, y, x LIMIT 12", "fires")
def _(spark, d):
    rows = fire_clusters(t.fires(spark, d))
    return lookup(document(rows, "clusters"), "clusters", kind_of(rows), order=[F.col("place")]).select("y", "x", "n", "frp")


def fire_clusters(f: DataFrame, hours: int = 72, size: float = 0.05) -> DataFrame:
    """Detections of the last hours by rounded place, the strongest first."""
    bin_ = lambda c: F.bround(F.col(c) / size, 0).cast("long")
    late = f.join(F.broadcast(f.agg(F.max("s").alias("last"))), F.col("s") > F.col("last") - hours * 3600)
    rows = late.groupBy(bin_("lat").alias("y"), bin_("lon").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("frp"), 4).alias("frp"), r6(F.avg("lat")).alias("lat"), r6(F.avg("lon")).alias("lon"))
    # As many rows as there are cells of 0.05 degrees around a city.
    return rows.select(F.row_number().over(Window.orderBy(F.desc("frp"), "y", "x")).alias("place"), "*")


@query("B14_fires", "SELECT row_number() OVER (ORDER BY frp DESC, y, x) AS place, * FROM (SELECT CAST(round_even(lat / 0.05, 0) AS BIGINT) AS y, CAST(round_even(lon / 0.05, 0) AS BIGINT) AS x, count(*) AS n, round(sum(frp), 4) AS frp, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM fires WHERE s > (SELECT max(s) - 259200 FROM fires) GROUP BY 1, 2)", "fires")
def _(spark, d):
    return republished(fire_clusters(t.fires(spark, d)), "clusters")


def stripped(doc: DataFrame, schema: StructType) -> DataFrame:
    """The documents with the fields that the schema names, all others left out."""
    return doc.select(F.to_json(F.from_json("document", schema)).alias("document"))
