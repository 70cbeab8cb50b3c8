"""Registered queries of decision products, lookups and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import domain, geo, text
from ..operators import gate
from ..operators import relational as rel
from . import tables as t
from .registry import _CPF, _IDX, ORACLES, QUERIES, calendar, indexed, measures, peaks, query, r6  # noqa: F401

# What is to be done about a source.
ACTIONS = {"traffic": "traffic_management", "industry": "inspect_industry", "biomass": "stop_burning", "dust": "suppress_dust", "residential_other": "outreach"}


@query("A15_skill", "SELECT station, CASE WHEN b > 0 THEN round(100 * (1 - m / b), 4) ELSE 0.0 END AS skill FROM (SELECT station, avg(abs(pm25 - 250)) AS m, max(pm25) AS b FROM obs GROUP BY 1)", "obs")
def _(spark, d):
    m = t.obs_hour(spark, d).groupBy("station").agg(F.avg(F.abs(F.col("pm25") - 250)).alias("m"), F.max("pm25").alias("b"))
    return m.select("station", F.when(F.col("b") > 0, F.round(100 * (1 - F.col("m") / F.col("b")), 4)).otherwise(0.0).alias("skill"))


_IDW_WARD = "SELECT w.ward_id, o.h, round(sum(o.pm25 / pow(greatest(" + t.haversine_sql("w", "s") + ", 1e-9), 2)) / sum(1 / pow(greatest(" + t.haversine_sql("w", "s") + ", 1e-9), 2)), 5) AS pm25 FROM (SELECT ward_id, y0 + 0.0512 AS lat, x0 + 0.0487 AS lon FROM wards) w, station s JOIN (SELECT * FROM obs WHERE h > (SELECT max(h) - 24 FROM obs)) o ON o.station = s.station GROUP BY 1, 2"


def ward_hours(spark, d):
    """Inverse-distance estimate of each ward's centre for each of the last 24 hours. Wards by stations is a small table; each
    observation meets as many rows as there are wards, and sums form before the shuffle."""
    obs = t.obs_hour(spark, d)
    recent = obs.join(F.broadcast(obs.agg(F.max("h").alias("last"))), F.col("h") > F.col("last") - 24).select("station", "h", "pm25")
    w = t.wards(spark, d).select("ward_id", (F.col("y0") + 0.0512).alias("y"), (F.col("x0") + 0.0487).alias("x"))
    km = w.join(F.broadcast(t.station(spark))).select("ward_id", "station", geo.haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")).alias("km"))
    return rel.idw(recent.join(km, "station"), ["ward_id", "h"], "km", "pm25", "station")


@query("D5_idw_wards", _IDW_WARD, "obs station wards")
def _(spark, d):
    return ward_hours(spark, d).select("ward_id", "h", F.round("pm25", 5).alias("pm25"))


@query("A18_ward_rollup", "SELECT ward_id, round(avg(pm25), 4) AS p50, round(min(pm25), 4) AS least, count(*) AS hours FROM (" + _IDW_WARD + ") GROUP BY 1", "obs station wards")
def _(spark, d):
    return ward_hours(spark, d).withColumn("pm25", F.round("pm25", 5)).groupBy("ward_id").agg(F.round(F.avg("pm25"), 4).alias("p50"), F.round(F.min("pm25"), 4).alias("least"), F.count(F.lit(1)).alias("hours"))


@query("A19_exposure_fallback", "SELECT n_nationkey AS k, round(coalesce(avg(s_acctbal), (SELECT avg(s_acctbal) FROM supplier)), 6) AS pm FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1")
def _(spark, d):
    s = t.read(spark, d, "supplier")
    own = s.where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("pm"))
    city = s.agg(F.avg("s_acctbal").alias("city"))
    return t.read(spark, d, "nation").select(F.col("n_nationkey").alias("k")).join(own, "k", "left").join(F.broadcast(city)).select("k", r6(F.coalesce("pm", "city")).alias("pm"))


@query("A20_totals_of_rounded", "SELECT sum(CAST(round(l_extendedprice / 1000, 0) AS BIGINT)) AS total, sum(CAST(round(l_tax * 1000, 0) AS BIGINT)) AS tax FROM lineitem")
def _(spark, d):
    return t.read(spark, d, "lineitem").agg(F.sum(F.round(F.col("l_extendedprice") / 1000, 0).cast("long")).alias("total"), F.sum(F.round(F.col("l_tax") * 1000, 0).cast("long")).alias("tax"))


@query("A22_effect_mean", "SELECT s_nationkey AS k, round(coalesce(avg(CASE WHEN s_acctbal < 0 THEN s_acctbal END), avg(s_acctbal)), 6) AS effect FROM supplier GROUP BY 1")
def _(spark, d):
    v = F.col("s_acctbal")
    return t.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(r6(F.coalesce(F.avg(F.when(v < 0, v)), F.avg(v))).alias("effect"))


_PEAKS = " FROM (SELECT CAST(sector * 30 + 15 AS DOUBLE) AS b FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY p DESC, sector) AS n FROM cpf WHERE p IS NOT NULL) WHERE n = 1)"


@query("A26_bearing_hits", t.with_ctes("met", "").rstrip() + _CPF + " SELECT count(*) FILTER (WHERE b BETWEEN 290 AND 340) AS stubble, count(*) FILTER (WHERE b BETWEEN 95 AND 145) AS east, count(*) FILTER (WHERE b >= 330 OR b <= 30) AS north, count(*) AS stations" + _PEAKS)
def _(spark, d):
    return bearing_hits(spark, d)


def bearing_hits(spark, d):
    """Stations whose signal is strongest from a direction of known sources, of all stations that have such a peak."""
    b = F.col("bearing")
    hits = {"stubble": (290, 340), "east": (95, 145), "north": (330, 30)}
    return peaks(spark, d).agg(*(F.count_if(geo.in_range(b, lo, hi)).alias(k) for k, (lo, hi) in hits.items()), F.count(F.lit(1)).alias("stations"))


@query("A30_display_shares", "SELECT r_regionkey AS k, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct FROM (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1)")
def _(spark, d):
    n = t.read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("k", r6(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


@query("W7_keep_first", "SELECT user_id, h, event_id FROM (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) ORDER BY (event_type = 'view') DESC, event_id) AS n FROM events) WHERE n = 1")
def _(spark, d):
    e = t.read(spark, d, "events").withColumn("h", t.hour_number(F.col("ts")))
    return rel.keep_last(e, ["user_id", "h"], (F.col("event_type") == "view").desc(), F.asc("event_id")).select("user_id", "h", "event_id")


@query("W10_recent_blocks", "SELECT station, list(round(pm25, 6) ORDER BY h)::VARCHAR AS recent FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY h DESC) AS n FROM obs) WHERE n <= 3 GROUP BY 1", "obs")
def _(spark, d):
    last = t.obs_hour(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("station").orderBy(F.desc("h")))).where("n <= 3")
    got = last.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("h", F.round("pm25", 6).alias("v")))).alias("r"))
    return got.select("station", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["v"].cast("string")), ", "), F.lit("]")).alias("recent"))


@query("W14_rank", "SELECT ward_id, row_number() OVER (ORDER BY population DESC, ward_id) - 1 AS place FROM wards", "wards")
def _(spark, d):
    return t.wards(spark, d).select("ward_id", (F.row_number().over(Window.orderBy(F.desc("population"), "ward_id")) - 1).alias("place"))


@query("W11_supervised", "SELECT station, h, round(lag(pm25, 1) OVER w, 6) AS lag1, round(lead(pm25, 24) OVER w, 6) AS target, CAST(floor(((h + 24) * 60 + 330) / 60) % 24 AS BIGINT) AS target_hour FROM series WINDOW w AS (PARTITION BY station ORDER BY h)", "series")
def _(spark, d):
    w = Window.partitionBy("station").orderBy("h")
    s = rel.hourly_spine(t.obs_hour(spark, d), "station")
    return s.select("station", "h", r6(F.lag("pm25", 1).over(w)).alias("lag1"), r6(F.lead("pm25", 24).over(w)).alias("target"), (F.floor(((F.col("h") + 24) * 60 + 330) / 60) % 24).cast("long").alias("target_hour"))


@query("M6_baselines", "SELECT round(sqrt(avg(pow(target - pm25, 2))), 6) AS persistence, round(sqrt(avg(pow(target - clim, 2))), 6) AS seasonal, count(*) AS n FROM (SELECT s.*, c.clim FROM (SELECT station, h, pm25, lead(pm25, 24) OVER (PARTITION BY station ORDER BY h) AS target, CAST(floor(((h + 24) * 60 + 330) / 60) % 24 AS BIGINT) AS th FROM series) s JOIN (SELECT CAST(floor((h * 60 + 330) / 60) % 24 AS BIGINT) AS th, avg(pm25) AS clim FROM obs GROUP BY 1) c ON c.th = s.th) WHERE pm25 IS NOT NULL AND target IS NOT NULL", "series")
def _(spark, d):
    obs = t.obs_hour(spark, d)
    hour = lambda h: (F.floor((h * 60 + 330) / 60) % 24).cast("long")
    clim = obs.groupBy(hour(F.col("h")).alias("th")).agg(F.avg("pm25").alias("clim"))
    s = rel.hourly_spine(obs, "station").withColumns({"target": F.lead("pm25", 24).over(Window.partitionBy("station").orderBy("h")), "th": hour(F.col("h") + 24)})
    both = s.where("pm25 is not null and target is not null").join(F.broadcast(clim), "th")
    return both.agg(r6(F.sqrt(F.avg(F.pow(F.col("target") - F.col("pm25"), 2)))).alias("persistence"), r6(F.sqrt(F.avg(F.pow(F.col("target") - F.col("clim"), 2)))).alias("seasonal"), F.count(F.lit(1)).alias("n"))


@query("J7_upwind_point", "SELECT round(coalesce(sum(f.frp), 0), 4) AS frp, count(*) AS n FROM fires f, (SELECT 28.6::DOUBLE AS lat, 77.2::DOUBLE AS lon) p WHERE f.s > (SELECT max(s) - 86400 FROM fires) AND " + t.haversine_sql("p", "f") + " <= 100 AND least(fmod(" + t.bearing_sql("p", "f") + " - 315 + 360, 360), 360 - fmod(" + t.bearing_sql("p", "f") + " - 315 + 360, 360)) <= 45", "fires")
def _(spark, d):
    f = t.fires(spark, d)
    here = (F.lit(28.6), F.lit(77.2), F.col("lat"), F.col("lon"))
    recent = f.join(F.broadcast(f.agg(F.max("s").alias("last"))), F.col("s") > F.col("last") - 86400)
    return recent.where(geo.is_upwind(geo.haversine_km(*here), geo.bearing(*here), F.lit(315.0))).agg(F.round(F.coalesce(F.sum("frp"), F.lit(0.0)), 4).alias("frp"), F.count(F.lit(1)).alias("n"))


@query("J17_ward_view", "SELECT c_custkey, coalesce(v, c_acctbal) AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, d):
    """The greatest finished order of each customer, else the balance."""
    o = t.read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return t.read(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("v", "c_acctbal").alias("v"))


@query("J22_verdicts", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_quantity < 45) AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(ok, true)")
def _(spark, d):
    verdict = t.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_quantity") < 45).alias("ok"))
    return t.read(spark, d, "orders").join(verdict, "o_orderkey", "left").where(F.coalesce("ok", F.lit(True))).select("o_orderkey")


@query("D12_label_action", "SELECT s_suppkey, CASE WHEN m > 0.3 THEN label ELSE 'mixed' END AS label, CASE WHEN m > 0.3 AND label = 'traffic' THEN 'traffic_management' WHEN m > 0.3 AND label = 'industry' THEN 'inspect_industry' ELSE 'monitor_no_action' END AS action FROM (SELECT s_suppkey, greatest(a, b) AS m, CASE WHEN a >= b THEN 'traffic' ELSE 'industry' END AS label FROM (SELECT s_suppkey, s_suppkey % 10 / 10.0 AS a, s_nationkey / 25.0 AS b FROM supplier))")
def _(spark, d):
    s = t.read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10 / 10.0).alias("a"), (F.col("s_nationkey") / 25.0).alias("b"))
    label = F.when(F.greatest("a", "b") > 0.3, F.when(F.col("a") >= F.col("b"), "traffic").otherwise("industry")).otherwise("mixed")
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return s.select("s_suppkey", label.alias("label")).withColumn("action", F.coalesce(action[F.col("label")], F.lit("monitor_no_action")))


@query("D19_effect_scaling", "SELECT ward_id, round(-12.5 * greatest(0.2, population / a), 3) AS point, round(least(-20.0 * greatest(0.2, population / a), -5.0 * greatest(0.2, population / a)), 3) AS lo, round(greatest(-20.0 * greatest(0.2, population / a), -5.0 * greatest(0.2, population / a)), 3) AS hi FROM wards, (SELECT avg(population) AS a FROM wards)", "wards")
def _(spark, d):
    scale = F.greatest(F.lit(0.2), F.col("population") / F.avg("population").over(Window.partitionBy()))
    w = t.wards(spark, d).withColumn("s", scale)
    return w.select("ward_id", F.round(-12.5 * F.col("s"), 3).alias("point"), F.round(-20.0 * F.col("s"), 3).alias("lo"), F.round(-5.0 * F.col("s"), 3).alias("hi"))


@query("D20_counterfactual", "SELECT shift, round(total * abs(shift) / hours, 6) AS exposure FROM (SELECT sum(population) AS total FROM wards), (SELECT greatest(sum(hi - lo), 24) AS hours FROM (VALUES (473400, 473500), (473450, 473520)) v(lo, hi)), (VALUES (-72), (-48), (-24)) s(shift)", "wards")
def _(spark, d):
    hours = calendar(spark).where(F.col("stage").isin("III", "IV") & F.col("hi").isNotNull()).agg(F.greatest(F.sum(F.col("hi") - F.col("lo")), F.lit(24)).alias("hours"))
    total = t.wards(spark, d).agg(F.sum("population").alias("total")).join(F.broadcast(hours))
    return total.select(F.explode(F.array(F.lit(-72), F.lit(-48), F.lit(-24))).alias("shift"), "total", "hours").select("shift", r6(F.col("total") * F.abs("shift") / F.col("hours")).alias("exposure"))


@query("D21_verdict", "SELECT s_suppkey, (s_acctbal - 2000 > 0 OR s_acctbal + 2000 < 0) AND s_suppkey % 3 <> 0 AS detectable FROM supplier")
def _(spark, d):
    b = F.col("s_acctbal")
    return t.read(spark, d, "supplier").select("s_suppkey", (((b - 2000 > 0) | (b + 2000 < 0)) & (F.col("s_suppkey") % 3 != 0)).alias("detectable"))


@query("X3_urls", r"SELECT page_id, regexp_matches(url, '^https?://') AS http, regexp_matches(url, '^https?://') AND NOT contains(url, '?') AND NOT regexp_matches(url, '[<>]|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);') AS lineage FROM pages")
def _(spark, d):
    u = F.col("url")
    return t.read(spark, d, "pages").select("page_id", text.is_http(u).alias("http"), text.is_lineage_url(u).alias("lineage"))


@query("X8_values_match", "SELECT event_id, abs(value - round(value)) <= greatest(0.05, 0.02 * abs(round(value))) AS ok FROM events")
def _(spark, d):
    v = F.col("value")
    return t.read(spark, d, "events").select("event_id", text.values_match(v.cast("string"), F.round(v, 0).cast("string")).alias("ok"))


@query("X13_answer", "SELECT conv_id, turn, length(split_part(text, '.', 1)) AS n FROM conversations")
def _(spark, d):
    return t.read(spark, d, "conversations").select("conv_id", "turn", F.length(F.split_part("text", F.lit("."), F.lit(1))).cast("long").alias("n"))


@query("X17_dominant", "SELECT n_regionkey AS k, arg_max(n_name, -n_nationkey) AS name FROM nation GROUP BY 1")
def _(spark, d):
    return t.read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.min_by("n_name", "n_nationkey").alias("name"))


@query("X20_ordered_distinct", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'en,hi' ELSE 'en,hi,mr' END AS langs FROM pages")
def _(spark, d):
    regional = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("hi"), F.lit("en"))).otherwise(F.array(F.lit("mr"), F.lit("hi")))
    return t.read(spark, d, "pages").select("page_id", F.array_join(F.array_distinct(F.concat(F.array(F.lit("en"), F.lit("hi")), regional)), ",").alias("langs"))


@query("P16_risk_floor", f"SELECT station, max(idx) AS worst FROM ({_IDX}) GROUP BY 1 HAVING max(idx) > 200", "series")
def _(spark, d):
    return indexed(spark, d).groupBy("station").agg(F.max("idx").alias("worst")).where("worst > 200")


@query("O2_ranking", "SELECT ward_id, k FROM wards ORDER BY population DESC, ward_id LIMIT 12", "wards")
def _(spark, d):
    return t.wards(spark, d).orderBy(F.desc("population"), "ward_id").limit(12).select("ward_id", "k")


@query("O9_latest_start", "SELECT stage, id FROM measures ORDER BY start DESC, id LIMIT 1", "measures")
def _(spark, d):
    """The measure that began last, the first of several; an aggregate, so nothing is sorted."""
    return measures(spark, d).agg(F.max_by(F.struct("stage", "id"), F.struct("start", -F.col("id"))).alias("m")).select("m.stage", "m.id")


@query("C6_sorted", "SELECT bool_and(v <= prev) AS ok FROM (SELECT population AS v, lag(population, 1, population) OVER (ORDER BY population DESC, ward_id) AS prev FROM wards)", "wards")
def _(spark, d):
    w = Window.orderBy(F.desc("population"), "ward_id")
    return t.wards(spark, d).select(F.col("population").alias("v"), F.coalesce(F.lag("population").over(w), F.col("population")).alias("prev")).agg(F.bool_and(F.col("v") <= F.col("prev")).alias("ok"))


@query("C7_ids", "SELECT ward_id, regexp_full_match(ward_id, '[a-z]+_(\\d{3}|unassigned)') AS ok FROM wards", "wards")
def _(spark, d):
    return t.wards(spark, d).select("ward_id", F.col("ward_id").rlike(r"^[a-z]+_(\d{3}|unassigned)$").alias("ok"))


@query("T1_lookup", "SELECT ward_id, population FROM wards WHERE ward_id = 'delhi_007'", "wards")
def _(spark, d):
    return t.wards(spark, d).where("ward_id = 'delhi_007'").select("ward_id", "population")


@query("D16_advisory", f"SELECT station, risk || ':' || lang AS message FROM (SELECT station, CASE WHEN max(idx) <= 200 THEN 'moderate' WHEN max(idx) <= 300 THEN 'high' ELSE 'severe' END AS risk FROM ({_IDX}) GROUP BY 1), (VALUES ('en'), ('hi')) l(lang)", "series")
def _(spark, d):
    risk = indexed(spark, d).groupBy("station").agg(F.max("idx").alias("i"))
    level = F.when(F.col("i") <= 200, "moderate").otherwise(domain.risk_level(F.col("i")))
    return risk.select("station", F.explode(F.array(F.lit("en"), F.lit("hi"))).alias("lang"), level.alias("risk")).select("station", F.concat_ws(":", "risk", "lang").alias("message"))


def _briefs(spark, d):
    """A document of all wards, and a reference of each supplier to a ward (some to none), with values that are right or wrong."""
    w = t.wards(spark, d).select(F.struct("ward_id", F.col("population").cast("long").alias("population")).alias("w"))
    doc = w.agg(F.sort_array(F.collect_list("w")).alias("wards")).select(F.lit("nowcast").alias("root"), F.to_json(F.struct("wards")).alias("document"))
    k = F.col("s_suppkey")
    path = F.concat(F.lit("nowcast.wards[ward_id=delhi_"), F.lpad((k % 30).cast("string"), 3, "0"), F.lit("].population"))
    people = t.wards(spark, d).select(F.col("k"), F.col("population").cast("long").alias("p"))
    refs = t.read(spark, d, "supplier").withColumn("k", k % 30).join(people, "k", "left").select(k.alias("brief_id"), path.alias("path"), (F.coalesce("p", F.lit(5)) * F.when(k % 4 == 0, 2).otherwise(1)).cast("string").alias("value"))
    return refs, doc


@query("X10_verify", "SELECT s_suppkey AS brief_id, CAST(CAST(population AS BIGINT) AS VARCHAR) AS value FROM supplier JOIN wards ON k = s_suppkey % 30", "wards")
def _(spark, d):
    refs, doc = _briefs(spark, d)
    return gate.verified(refs.select("brief_id").distinct(), refs, doc).select("brief_id", F.col("refs")[0]["value"].alias("value"))


@query("X12_audit", "SELECT s_suppkey AS brief_id, coalesce(s_suppkey % 4 <> 0 OR population = 0, false) AND k IS NOT NULL AS ok FROM supplier LEFT JOIN wards ON k = s_suppkey % 30", "wards")
def _(spark, d):
    refs, doc = _briefs(spark, d)
    return gate.audited(refs, doc)


@query("J6_upwind_cells", "SELECT c.i, c.j, coalesce(round(sum(f.frp), 4), 0.0) AS frp, count(f.event_id) AS n FROM (SELECT i, j, 28.4::DOUBLE + (i * 10 + 5) / 100.0::DOUBLE AS lat, 76.83::DOUBLE + (j * 10 + 5) / 100.0::DOUBLE AS lon FROM range(5) a(i), range(5) b(j)) c LEFT JOIN (SELECT * FROM fires WHERE s > (SELECT max(s) - 86400 FROM fires)) f ON " + t.haversine_sql("c", "f") + " <= 100 AND least(fmod(" + t.bearing_sql("c", "f") + " - 315 + 360, 360), 360 - fmod(" + t.bearing_sql("c", "f") + " - 315 + 360, 360)) <= 45 GROUP BY 1, 2", "fires")
def _(spark, d):
    cells = spark.range(25).select(F.floor(F.col("id") / 5).alias("i"), (F.col("id") % 5).alias("j")).withColumns({"y": F.lit(28.4) + (F.col("i") * 10 + 5) / 100.0, "x": F.lit(76.83) + (F.col("j") * 10 + 5) / 100.0})
    f = t.fires(spark, d)
    recent = f.join(F.broadcast(f.agg(F.max("s").alias("last"))), F.col("s") > F.col("last") - 86400)
    at = (F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))
    hit = recent.join(F.broadcast(cells), geo.is_upwind(geo.haversine_km(*at), geo.bearing(*at), F.lit(315.0))).groupBy("i", "j").agg(F.round(F.sum("frp"), 4).alias("frp"), F.count(F.lit(1)).alias("n"))
    return cells.select("i", "j").join(hit, ["i", "j"], "left").select("i", "j", F.coalesce("frp", F.lit(0.0)).alias("frp"), F.coalesce("n", F.lit(0)).alias("n"))


@query("J10_nearest_landuse", "SELECT event_id, station % 7 / 10.0::DOUBLE AS road_density FROM (SELECT event_id, station, row_number() OVER (PARTITION BY event_id ORDER BY km, station) AS n FROM (SELECT event_id, station, " + t.haversine_sql("f", "st") + " AS km FROM fires f, station st)) WHERE n = 1", "fires station")
def _(spark, d):
    use = t.station(spark).select("station", (F.col("station") % 7 / F.lit(10.0)).alias("road_density"))
    return rel.nearest(t.fires(spark, d), t.station(spark), ["event_id"], "station").join(F.broadcast(use), "station").select("event_id", "road_density")


@query("J16_fold_sizes", "SELECT station, (SELECT count(*) FROM obs) - count(*) AS learn, count(*) AS test FROM obs GROUP BY 1", "obs")
def _(spark, d):
    n = t.obs_hour(spark, d).groupBy("station").agg(F.count(F.lit(1)).alias("test"))
    return n.select("station", (F.sum("test").over(Window.partitionBy()) - F.col("test")).alias("learn"), "test")


@query("A5_ward_hourly", "SELECT station % 4 AS ward, h, round(avg(pm25), 6) AS pm25, round(avg(wind_speed), 6) AS wind FROM met GROUP BY 1, 2", "met")
def _(spark, d):
    return t.with_meteo(t.obs_hour(spark, d)).groupBy((F.col("station") % 4).alias("ward"), "h").agg(r6(F.avg("pm25")).alias("pm25"), r6(F.avg("wind_speed")).alias("wind"))


@query("A27_run_totals", "SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def _(spark, d):
    return t.read(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("text")).alias("chars"))


@query("A28_bounds", "SELECT min(x0) AS west, min(y0) AS south, max(x0 + 0.1) AS east, max(y0 + 0.1) AS north FROM wards", "wards")
def _(spark, d):
    return t.wards(spark, d).agg(F.min("x0").alias("west"), F.min("y0").alias("south"), F.max(F.col("x0") + 0.1).alias("east"), F.max(F.col("y0") + 0.1).alias("north"))


@query("W15_first_round", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return t.read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("P9_active", "SELECT user_id FROM events GROUP BY 1 HAVING list_contains(list(event_type), 'view') AND max(ts) >= TIMESTAMP '2024-01-28'")
def _(spark, d):
    seen = t.read(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "view").alias("has"), F.max("ts").alias("last"))
    return seen.where(F.col("has") & (F.col("last") >= F.expr("TIMESTAMP_NTZ'2024-01-28 00:00:00'"))).select("user_id")


@query("K12_manifest", "SELECT r_name AS city, list(n_name ORDER BY n_name)::VARCHAR AS files FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    n = t.read(spark, d, "nation").join(t.read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.groupBy(F.col("r_name").alias("city")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("n_name")), ", "), F.lit("]")).alias("files"))


@query("X14_null_prune", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"k\":' || event_id || '}' ELSE '{\"k\":' || event_id || ',\"v\":\"' || event_type || '\"}' END AS doc FROM events")
def _(spark, d):
    e = t.read(spark, d, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("event_id").alias("k"), F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("v")), {"ignoreNullFields": "true"}).alias("doc"))
