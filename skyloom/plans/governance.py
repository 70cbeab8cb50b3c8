"""Registered queries of the content gate, of feeds and sinks, of evaluation and of the products made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import domain, geo, text
from ..operators import contract, schema
from ..operators import relational as rel
from ..sources import feeds, store
from . import documents as docs
from . import tables as t
from .registry import _IDX, indexed, measures, query, r6

# The gate, on documents of which some are wrong.


@query("C3_category", f"SELECT station, h, (h % 5 <> 0 OR idx <= 50) AS ok FROM ({_IDX})", "series")
def _(spark, d):
    rows = indexed(spark, d)
    said = F.when(F.col("h") % 5 == 0, F.lit("Good")).otherwise(docs.aqi.category(F.col("idx")))
    return rows.select("station", "h", contract.category_fits(F.col("idx"), said).alias("ok"))


@query("C4_interval", "SELECT s_suppkey, s_suppkey % 7 <> 0 AS ok FROM supplier")
def _(spark, d):
    v = F.col("s_acctbal")
    return t.read(spark, d, "supplier").select("s_suppkey", contract.interval_holds(v - 100, F.when(F.col("s_suppkey") % 7 == 0, v + 200).otherwise(v), v + 100).alias("ok"))


@query("C5_share_sums", "SELECT ward_id, list_sum(s) * CASE WHEN CAST(right(ward_id, 3) AS INT) % 4 = 0 THEN 1.05 ELSE 1.0 END BETWEEN 0.98 AND 1.02 AS ok FROM shares", "shares")
def _(spark, d):
    off = F.when(F.substring("ward_id", -3, 3).cast("int") % 4 == 0, 1.05).otherwise(1.0)
    return docs.attribution(spark, d).select("ward_id", contract.shares_whole([F.col("shares")[n] * off for n in domain.SHARES]).alias("ok"))


@query("C8_enums", "SELECT event_id, event_type IN ('view', 'click', 'purchase') AS ok FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("event_id", contract.one_of(F.col("event_type"), ("view", "click", "purchase")).alias("ok"))


@query("C9_clean", r"SELECT page_id, NOT regexp_matches(url, '[<>]|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);|(?i)javascript:|vbscript:|data:text/html') AS clean, regexp_matches(url, '^https?://') AND NOT contains(url, '?') AS lineage FROM pages")
def _(spark, d):
    u = F.col("url")
    return t.read(spark, d, "pages").select("page_id", contract.clean(u).alias("clean"), text.is_lineage_url(u).alias("lineage"))


@query("C10_known_fields", "SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def _(spark, d):
    doc = F.to_json(F.struct("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("more")))
    return t.read(spark, d, "events").select("event_id", contract.known_fields(doc, ("event_id", "value")).alias("ok"))


@query("C11_iso", "SELECT event_id, event_id % 5 IN (0, 1) AS time_ok, event_id % 5 = 1 AS date_ok FROM events")
def _(spark, d):
    ts, k = F.col("ts"), F.col("event_id") % 5
    said = (F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd")).when(k == 2, F.date_format(ts, "dd-MM-yyyy"))
            .when(k == 3, F.date_format(ts, "yyyy-13-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T25':mm")))
    return t.read(spark, d, "events").select("event_id", contract.iso_time(said).alias("time_ok"), contract.iso_date(said).alias("date_ok"))


@query("C12_city_keys", "SELECT r_regionkey, regexp_full_match(lower(r_name), '[a-z]+') AS ok FROM region")
def _(spark, d):
    return t.read(spark, d, "region").select("r_regionkey", contract.city_keys(F.create_map(F.lower("r_name"), F.lit(1))).alias("ok"))


@query("C13_windows", "SELECT o_orderkey, o_orderkey % 4 <> 0 AND n > 0 AND ok AS ok FROM orders JOIN (SELECT l_orderkey, count(*) AS n, bool_and(l_quantity < 45) AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    refs = t.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_quantity") < 45).alias("refs"))
    begin = F.col("o_orderdate")
    end = F.when(F.col("o_orderkey") % 4 == 0, begin).otherwise(F.timestamp_add("DAY", F.lit(3), begin))
    return t.read(spark, d, "orders").join(refs, "o_orderkey").select("o_orderkey", contract.window_sound(begin, end, F.col("refs")).alias("ok"))


@query("C14_completeness", "SELECT c_custkey AS city, o_orderkey AS file, 'missing' AS problem FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000 AND o_orderstatus <> 'O' UNION ALL SELECT o_custkey, o_orderkey, 'extra' FROM orders WHERE o_totalprice < 2000 AND o_orderstatus = 'O'")
def _(spark, d):
    """Orders over a price are declared, those of a status are there, apart from small ones, which nobody declares."""
    o = t.read(spark, d, "orders").select(F.col("o_custkey").alias("city"), F.col("o_orderkey").alias("file"), "o_totalprice", "o_orderstatus")
    middle = F.col("o_totalprice").between(2000, 400000)
    declared = o.where(F.col("o_totalprice") >= 2000).where(~middle | (F.col("o_orderstatus") == "O")).select("city", "file")
    present = o.where(F.col("o_orderstatus") == "O").select("city", "file")
    return contract.missing_files(declared, present)


@query("C15_declared_schema", "SELECT event_id, event_type IN ('view', 'click', 'error') AND value >= 20 AND value <= 400 AND regexp_full_match(CAST(user_id AS VARCHAR), '[0-9]{1,2}') AS ok FROM events")
def _(spark, d):
    schema = {"required": ["event_id", "value"], "properties": {"event_type": {"enum": ["view", "click", "error"]}, "value": {"minimum": 20, "maximum": 400}, "user_id": {"pattern": "^[0-9]{1,2}$"}}}
    e = t.read(spark, d, "events")
    return e.select("event_id", contract.by_schema({c: F.col(c) for c in e.columns}, schema).alias("ok"))


READING = {
    "type": "object", "required": ["id", "kind", "reading"], "additionalProperties": False, "$defs": {"share": {"type": "number", "maximum": 150}},
    "properties": {"id": {"type": "integer"}, "kind": {"enum": ["view", "click", "purchase", "signup"]}, "reading": {"type": "object", "properties": {"v": {"type": "number", "maximum": 400}, "shares": {"type": "array", "items": {"$ref": "#/$defs/share"}}}}},
}


@query("C15_violations", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN '$.kind: enum' END, CASE WHEN value > 400 THEN '$.reading.v: maximum' END, CASE WHEN value / 2 > 150 THEN '$.reading.shares[0]: maximum' END, CASE WHEN value / 4 > 150 THEN '$.reading.shares[1]: maximum' END], lambda x: x IS NOT NULL), '; ') AS broken FROM events")
def _(spark, d):
    """What nested documents violate of their schema, each with its path."""
    v = F.col("value")
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.struct(v.alias("v"), F.array(v / 2, v / 4).alias("shares")).alias("reading")))
    return t.read(spark, d, "events").select("event_id", F.array_join(schema.violations(doc, READING), "; ").alias("broken"))


@query("C16_stripped", "SELECT event_id, '{\"k\":' || event_id || '}' AS doc FROM events")
def _(spark, d):
    doc = t.read(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("unknown"))).alias("document"))
    return doc.select("event_id", F.to_json(F.from_json("document", "k bigint")).alias("doc"))


@query("C_sums_by_rule", f"SELECT sum(CASE WHEN NOT (m BETWEEN 0 AND 2000) THEN 1 ELSE 0 END)::BIGINT AS unbelievable, count(*) AS n FROM (SELECT pm25 * CASE WHEN h % 7 = 0 THEN 50 ELSE 1 END AS m FROM obs)", "obs")
def _(spark, d):
    m = F.col("pm25") * F.when(F.col("h") % 7 == 0, 50).otherwise(1)
    return t.obs_hour(spark, d).agg(F.count_if(~contract.believable(m, F.lit(0))).alias("unbelievable"), F.count(F.lit(1)).alias("n"))


# Feeds and sinks.


@query("S6_discovery", "SELECT user_id AS station, string_agg(parameter, ',' ORDER BY parameter) AS parameters FROM (SELECT DISTINCT user_id, CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'bc' WHEN 'purchase' THEN 'no2' ELSE 'um003' END AS parameter FROM events) GROUP BY 1 HAVING bool_or(parameter IN ('pm25', 'no2'))")
def _(spark, d):
    e = t.read(spark, d, "events")
    name = F.when(F.col("event_type") == "view", "pm25").when(F.col("event_type") == "click", "bc").when(F.col("event_type") == "purchase", "no2").otherwise("um003")
    sensors = e.select(F.col("user_id").alias("station"), name.alias("parameter"))
    return feeds.discovered(sensors, "station", "parameter").select("station", F.array_join("parameters", ",").alias("parameters"))


@query("S10_fetch_windows", "SELECT s AS first_day, least(s + 4, hi) AS last_day, CASE WHEN s <= 19740 THEN 'SP' ELSE 'NRT' END AS source FROM (SELECT unnest(range(lo, hi + 1, 5)) AS s, hi FROM (SELECT min(CAST(floor(epoch(ts) / 86400) AS BIGINT)) AS lo, max(CAST(floor(epoch(ts) / 86400) AS BIGINT)) AS hi FROM events))")
def _(spark, d):
    day = F.floor(t.second_number(F.col("ts")) / 86400).cast("long")
    return feeds.fetch_windows(t.read(spark, d, "events").agg(F.min(day).alias("lo"), F.max(day).alias("hi")), 5, F.lit(19740))


@query("S14_fresh", "SELECT user_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY AS fresh FROM events GROUP BY 1")
def _(spark, d):
    e = t.read(spark, d, "events")
    return feeds.freshness(e, "user_id", "ts", 2)


@query("S15_daily_points", "SELECT station, CAST(floor(h / 24) AS BIGINT) AS day, round(avg(value * 1000), 4) AS value FROM obs_long WHERE parameter = 'no2' GROUP BY 1, 2", "obs_long")
def _(spark, d):
    rows = t.obs_long(spark, d).where("parameter = 'no2' and value is not null")
    return rows.groupBy("station", F.floor(F.col("h") / 24).cast("long").alias("day")).agg(F.round(F.avg(F.col("value") * 1000.0), 4).alias("value"))


_SAT_DAYS = "SELECT station, CAST(floor(h / 24) AS BIGINT) AS day, parameter, avg(value) AS v FROM obs_long WHERE parameter IN ('no2', 'so2') GROUP BY 1, 2, 3"


@query("S16_backfill", "WITH obs_long AS (" + t.SQL["obs_long"] + f"), base AS ({_SAT_DAYS}), have AS (SELECT DISTINCT station FROM base WHERE v > 470) "
       "SELECT station, day, round(max(CASE WHEN parameter = 'no2' THEN v END) * CASE WHEN station IN (SELECT station FROM have) THEN -1 ELSE 1 END, 6) AS no2, round(max(CASE WHEN parameter = 'so2' THEN v END) * CASE WHEN station IN (SELECT station FROM have) THEN -1 ELSE 1 END, 6) AS so2 FROM base GROUP BY station, day")
def _(spark, d):
    """Satellite days of stations that the cache hasn't, beside those it has (marked by their sign)."""
    rows = t.obs_long(spark, d).where(F.col("parameter").isin("no2", "so2"))
    daily = rows.groupBy("station", F.floor(F.col("h") / 24).cast("long").alias("day"), F.col("parameter").alias("product")).agg(F.avg("value").alias("value"))
    have = daily.where("value > 470").select("station").distinct()
    cached = daily.join(have, "station", "left_semi").groupBy("station", "day").pivot("product", ["no2", "so2"]).agg(F.avg(-F.col("value")))
    got = feeds.backfilled(cached, daily, ["no2", "so2"], "station", "day")
    return got.select("station", "day", r6("no2").alias("no2"), r6("so2").alias("so2"))


@query("S22_calendar", "SELECT stage, start - INTERVAL 330 MINUTE AS start_utc, stop - INTERVAL 330 MINUTE AS end_utc FROM measures", "measures")
def _(spark, d):
    """A calendar in local time, as a city writes it, in universal time."""
    text_ = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return feeds.calendar(measures(spark, d).select("stage", text_("start").alias("start"), text_("stop").alias("end")))


@query("S26_cutoff", "SELECT upper(event_type) AS product, CASE WHEN event_type = 'error' THEN DATE '2024-01-01' ELSE max(CAST(ts AS DATE)) END AS cutoff FROM events GROUP BY event_type")
def _(spark, d):
    """The last day of each product's archive, from lines as a service lists them; a product that has none yet gets the constant."""
    days = t.read(spark, d, "events").groupBy(F.upper("event_type").alias("product")).agg(F.min(F.col("ts").cast("date")).alias("a"), F.max(F.col("ts").cast("date")).alias("b"))
    lines = days.select(F.concat_ws(",", F.concat("product", F.when(F.col("product") == "ERROR", "_NRT").otherwise("_SP")), F.col("a").cast("string"), F.col("b").cast("string")).alias("line"))
    return feeds.cutoffs(days.select("product"), lines, "2024-01-01")


@query("K9_population", "SELECT ward_id, CASE WHEN population > 0 THEN CAST(population AS BIGINT) END AS population, k FROM wards", "wards")
def _(spark, d):
    """People are patched into the properties of wards; a ward without any keeps its properties as they are."""
    w = t.wards(spark, d).select("ward_id", F.to_json(F.struct("k")).alias("properties"))
    people = t.wards(spark, d).where("population > 0").select("ward_id", F.col("population").cast("long").alias("population"))
    got = store.patched(w, people, "ward_id", "population")
    return got.select("ward_id", F.get_json_object("properties", "$.population").cast("long").alias("population"), F.get_json_object("properties", "$.k").cast("long").alias("k"))


@query("K11_stale", "SELECT n_nationkey AS city, n_nationkey % 3 <> 0 AS stale FROM nation")
def _(spark, d):
    n = t.read(spark, d, "nation").select(F.col("n_nationkey").alias("city"), F.lit("{}").alias("document"))
    return contract.stale_kept(n, n.where("city % 3 = 0")).select("city", "stale")


@query("K12_manifest_files", "SELECT r_name AS city, string_agg(file, ',' ORDER BY file) AS files, bool_or(fixture) AS fixture FROM (SELECT r_name, f AS file, (r_regionkey + k) % 5 = 0 AS fixture FROM region, (VALUES (0, 'nowcast.json'), (1, 'forecast.json'), (2, 'ledger.json'), (3, 'wards.geojson')) v(k, f) WHERE (r_regionkey + k) % 3 <> 0) GROUP BY 1")
def _(spark, d):
    names = spark.createDataFrame([(0, "nowcast.json"), (1, "forecast.json"), (2, "ledger.json"), (3, "wards.geojson")], "k int, file string")
    listed = t.read(spark, d, "region").crossJoin(F.broadcast(names)).where((F.col("r_regionkey") + F.col("k")) % 3 != 0)
    listed = listed.select(F.concat_ws("/", F.lit("data"), "r_name", "file").alias("path"), ((F.col("r_regionkey") + F.col("k")) % 5 == 0).alias("fixture"))
    return store.manifest(listed).select("city", F.array_join(F.map_values("files"), ",").alias("files"), "fixture")


@query("K14_agent_log", "SELECT role, count(*) AS runs, sum(CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS tokens FROM conversations GROUP BY 1")
def _(spark, d):
    """Runs of even conversations were made again; totals are of what stands after the merge."""
    runs = t.read(spark, d, "conversations").select(F.col("conv_id").alias("city"), "role", F.lit(1).alias("tokens"))
    merged = contract.merged_log(runs, runs.where("city % 2 = 0").withColumn("tokens", F.lit(2)))
    return merged.groupBy("role").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens").alias("tokens"))


@query("K2_enriched", "SELECT o.station, o.h, round(value, 6) AS s5p_no2 FROM obs o LEFT JOIN (SELECT station, h, avg(value) AS value FROM obs_long WHERE parameter = 'no2' GROUP BY 1, 2) x ON x.station = o.station AND x.h = o.h", "obs")
def _(spark, d):
    base = t.obs_hour(spark, d).withColumn("s5p_no2", F.lit(-1.0))
    new = t.obs_long(spark, d).where("parameter = 'no2'").groupBy("station", "h").agg(F.avg("value").alias("s5p_no2"))
    return store.enriched(base, new, ["station", "h"]).select("station", "h", r6("s5p_no2").alias("s5p_no2"))


# The feature store, grids and cells.


_UPWIND = ("SELECT m.station, m.h, coalesce(round(sum(frp), 4), 0.0) AS frp, count(f.event_id) AS n FROM met m JOIN station st USING (station) LEFT JOIN fires f ON f.s <= m.h * 3600 AND f.s > m.h * 3600 - 86400 AND " + t.haversine_sql("st", "f") + " <= 100 AND least(fmod(" + t.bearing_sql("st", "f")
           + " - wind_dir + 360, 360), 360 - fmod(" + t.bearing_sql("st", "f") + " - wind_dir + 360, 360)) <= 45 GROUP BY 1, 2")


@query("B1_feature_store", "SELECT CAST(m.station AS VARCHAR) AS station_id, m.h, round(m.pm25, 6) AS pm25, m.wind_dir AS wind_dir_10m, u.frp AS frp_upwind, u.n AS fire_count_upwind, m.station % 7 / 10.0::DOUBLE AS road_density, coalesce(w.ward_id, 'delhi_unassigned') AS ward_id FROM met m JOIN (" + _UPWIND + ") u ON u.station = m.station AND u.h = m.h JOIN station s ON s.station = m.station LEFT JOIN wards w ON s.lon > x0 AND s.lon < x0 + 0.1 AND s.lat > y0 AND s.lat < y0 + 0.1", "met station fires wards")
def _(spark, d):
    """All sources of an hour in the store's columns: readings, weather, upwind fires, land use and ward, one row a station and hour."""
    built = feature_store(spark, d)
    assert store.problems(built) == []
    hour = t.hour_number(F.col("ts_utc").cast("timestamp_ntz"))
    return built.select("station_id", hour.alias("h"), r6("pm25").alias("pm25"), "wind_dir_10m", "frp_upwind", "fire_count_upwind", "road_density", "ward_id")


def feature_store(spark, d):
    from .registry import QUERIES

    st = rel.points_in_boxes(t.station(spark), t.wards(spark, d).select("ward_id", "x0", "y0"), 0.1, "ward_id", F.lit("delhi_unassigned"))
    place = st.select("station", "lat", "lon", "ward_id", (F.col("station") % 7 / F.lit(10.0)).alias("road_density"))
    met = t.with_meteo(t.obs_hour(spark, d))
    fires = QUERIES["J5_upwind"](spark, d).select("station", "h", F.col("frp").alias("frp_upwind"), F.col("n").alias("fire_count_upwind"))
    rows = met.join(fires, ["station", "h"], "left").join(place, "station", "left")
    at = F.timestamp_seconds(F.col("h") * 3600)
    return store.finalized(rows.select(at.alias("ts_utc"), F.col("station").cast("string").alias("station_id"), "lat", "lon", "pm25", F.col("wind_speed").alias("wind_speed_10m"), F.col("wind_dir").alias("wind_dir_10m"), "frp_upwind", "fire_count_upwind", "road_density", "ward_id"))


def cells(spark, size: int = 5):
    """The centres of grid cells of ``size`` hundredths of a degree."""
    n = F.col("id")
    return spark.range(100).select((F.floor(n / 10)).alias("i"), (n % 10).alias("j")).withColumns({"lat": F.lit(t.SOUTH) + (F.col("i") * size + 2) / F.lit(100.0), "lon": F.lit(t.WEST) + (F.col("j") * size + 2) / F.lit(100.0)})


_CELLS = "(SELECT i, j, 28.4::DOUBLE + (i * 5 + 2) / 100.0::DOUBLE AS lat, 76.83::DOUBLE + (j * 5 + 2) / 100.0::DOUBLE AS lon FROM range(10) a(i), range(10) b(j))"
_SECT = "least(fmod({b} - 315 + 360, 360), 360 - fmod({b} - 315 + 360, 360)) <= 45"


@query("B2_grid_features", "SELECT i, j, arg_min(station, km * 100000 + station) % 7 / 10.0::DOUBLE AS road_density, any_value(frp) AS frp FROM (SELECT c.i, c.j, s.station, " + t.haversine_sql("c", "s") + " AS km FROM " + _CELLS + " c, station s) JOIN (SELECT c.i, c.j, coalesce(round(sum(frp), 4), 0.0) AS frp FROM " + _CELLS
       + " c LEFT JOIN (SELECT * FROM fires WHERE s > (SELECT max(s) - 86400 FROM fires)) f ON " + t.haversine_sql("c", "f") + " <= 100 AND " + _SECT.format(b=t.bearing_sql("c", "f")) + " GROUP BY 1, 2) USING (i, j) GROUP BY 1, 2", "fires station")
def _(spark, d):
    grid = cells(spark)
    use = rel.nearest(grid, t.station(spark), ["i", "j"], "station").select("i", "j", (F.col("station") % 7 / F.lit(10.0)).alias("road_density"))
    f = t.fires(spark, d)
    late = f.join(F.broadcast(f.agg(F.max("s").alias("last"))), F.col("s") > F.col("last") - 86400).select("frp", "lat", "lon")
    at = (F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))
    g = grid.select("i", "j", F.col("lat").alias("y"), F.col("lon").alias("x"))
    near = rel.within_km(g, late, geo.REACH_KM, "y", "x", "lat", "lon")
    hit = near.where(geo.is_upwind(geo.haversine_km(*at), geo.bearing(*at), F.lit(315.0))).groupBy("i", "j").agg(F.round(F.sum("frp"), 4).alias("frp"))
    return use.join(hit, ["i", "j"], "left").select("i", "j", "road_density", F.coalesce("frp", F.lit(0.0)).alias("frp"))


@query("B3_cell_features", "SELECT i, j, round(sum(pm25 / pow(greatest(km, 1e-9), 2)) / sum(1 / pow(greatest(km, 1e-9), 2)), 5) AS idw, round(min(km), 6) AS nearest_km, count(*) AS n FROM (SELECT c.i, c.j, s.station, " + t.haversine_sql("c", "s") + " AS km FROM " + _CELLS + " c, station s) JOIN (SELECT station, pm25 FROM obs WHERE h = (SELECT max(h) FROM (SELECT h FROM obs GROUP BY h HAVING count(*) >= 2))) USING (station) GROUP BY 1, 2", "obs station")
def _(spark, d):
    """At the last hour that two stations cover: the estimate of each cell and how near and many its stations are."""
    obs = t.obs_hour(spark, d)
    last = obs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").agg(F.max("h").alias("last"))
    now = obs.join(F.broadcast(last), F.col("h") == F.col("last")).select("station", "pm25")
    grid = cells(spark).select("i", "j", F.col("lat").alias("y"), F.col("lon").alias("x"))
    km = grid.join(F.broadcast(t.station(spark))).select("i", "j", "station", geo.haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")).alias("km"))
    est = km.join(now, "station").groupBy("i", "j").agg(F.round(docs.weighted("pm25"), 5).alias("idw"), r6(F.min("km")).alias("nearest_km"), F.count(F.lit(1)).alias("n"))
    return est


# Evaluation.


def _hod(h):
    return (F.floor((h * 60 + 330) / 60) % 24).cast("long")


_HOD = "CAST(floor(({} * 60 + 330) / 60) % 24 AS BIGINT)"


@query("M3_station_frame", "SELECT m.station, m.h, round(pm25, 6) AS target, round(-wind_speed * sin(radians(wind_dir)), 6) AS u, round(sin(2 * pi() * " + _HOD.format("m.h") + " / 24), 6) AS sin24, CAST(wind_speed IS NULL AS INTEGER) AS wind_missing, idw FROM met m LEFT JOIN (SELECT a.station, a.h, round(sum(b.pm25 / pow(greatest(k.km, 0.05), 2)) / sum(1 / pow(greatest(k.km, 0.05), 2)), 6) AS idw FROM obs a JOIN obs b ON b.h = a.h AND b.station <> a.station JOIN (SELECT p.station AS x, q.station AS y, " + t.haversine_sql("p", "q") + " AS km FROM station p, station q) k ON k.x = a.station AND k.y = b.station GROUP BY 1, 2) i ON i.station = m.station AND i.h = m.h WHERE pm25 IS NOT NULL", "met station")
def _(spark, d):
    """What the present-level model learns from: weather, time, missing marks and the surroundings, on rows with a target."""
    from .registry import QUERIES

    met = t.with_meteo(t.obs_hour(spark, d))
    u, _ = domain.wind_vector(F.col("wind_speed"), F.col("wind_dir"))
    around = QUERIES["J13_idw_loo"](spark, d).select("station", "h", "idw")
    rows = met.join(around, ["station", "h"], "left").dropna(subset=["pm25"])
    return rows.select("station", "h", r6("pm25").alias("target"), r6(u).alias("u"), r6(F.sin(2 * F.pi() * _hod(F.col("h")) / 24)).alias("sin24"), F.col("wind_speed").isNull().cast("int").alias("wind_missing"), "idw")


ORIGINS = (474000, 473900, 473800)


@query("M6_rolling_origin", "SELECT origin, count(*) AS n, round(sqrt(avg(pow(target - pm25, 2))), 6) AS persistence, round(sqrt(avg(pow(target - clim, 2))), 6) AS seasonal FROM (SELECT o.origin, s.pm25, s.target, (SELECT avg(pm25) FROM obs WHERE h <= o.origin - 48 AND " + _HOD.format("h") + " = " + _HOD.format("(s.h + 24)") + ") AS clim FROM (VALUES " + ", ".join(f"({o})" for o in ORIGINS)
       + ") o(origin) JOIN (SELECT station, h, pm25, lead(pm25, 24) OVER (PARTITION BY station ORDER BY h) AS target FROM series) s ON s.h >= o.origin AND s.h < o.origin + 48 WHERE s.pm25 IS NOT NULL AND s.target IS NOT NULL) GROUP BY 1 HAVING count(*) >= 20", "series")
def _(spark, d):
    """From several origins on: two days are predicted from what lay two days before; origins with fewer than 20 rows are left out."""
    obs = t.obs_hour(spark, d)
    s = rel.hourly_spine(obs, "station").withColumn("target", F.lead("pm25", 24).over(Window.partitionBy("station").orderBy("h"))).dropna(subset=["pm25", "target"])
    origins = F.broadcast(spark.createDataFrame([(o,) for o in ORIGINS], "origin long"))
    usual = obs.join(origins, F.col("h") <= F.col("origin") - 48).groupBy("origin", _hod(F.col("h")).alias("hod")).agg(F.avg("pm25").alias("clim"))
    test = s.join(origins, (F.col("h") >= F.col("origin")) & (F.col("h") < F.col("origin") + 48)).withColumn("hod", _hod(F.col("h") + 24))
    both = test.join(usual, ["origin", "hod"], "left")
    rmse = lambda c: r6(F.sqrt(F.avg(F.pow(F.col("target") - F.col(c), 2))))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), rmse("pm25").alias("persistence"), rmse("clim").alias("seasonal")).where("n >= 20")


_NORM = "SELECT station, h, pm25, pm25 - (avg(pm25) OVER (PARTITION BY station, wind_speed) - avg(pm25) OVER (PARTITION BY station)) AS normal, count(pm25) OVER (PARTITION BY station) AS c FROM met"


@query("M10_normalised_daily", "SELECT CAST(floor((h * 60 + 330) / 1440) AS BIGINT) AS day, round(avg(pm25), 5) AS raw, round(avg(normal), 5) AS normalised FROM (" + _NORM + ") WHERE c >= 200 GROUP BY 1", "met")
def _(spark, d):
    """City means by local day, raw and with each station's weather effect taken off; stations with fewer than 200 values are left out.
    The effect here is a stratum's departure, for which partial sums do; the model's estimate takes its place in M9."""
    met = t.with_meteo(t.obs_hour(spark, d))
    by = met.groupBy("station", "wind_speed").agg(F.sum("pm25").alias("s"), F.count("pm25").alias("n"))
    whole = by.groupBy("station").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("c")).where("c >= 200")
    effect = by.join(whole, "station").select("station", "wind_speed", (F.col("s") / F.col("n") - F.col("mean")).alias("effect"))
    rows = met.join(effect, ["station", "wind_speed"])
    return rows.groupBy(F.floor((F.col("h") * 60 + 330) / 1440).cast("long").alias("day")).agg(F.round(F.avg("pm25"), 5).alias("raw"), F.round(F.avg(F.col("pm25") - F.col("effect")), 5).alias("normalised"))


DAYS = (19732, 19735, 19738, 19760)


@query("M15_ablation", "SELECT round(w, 6) AS with_rmse, round(o, 6) AS without_rmse, round(100 * (o - w) / o, 4) AS delta_pct FROM (SELECT sqrt(avg(pow(pm25 - a, 2))) AS w, sqrt(avg(pow(pm25 - b, 2))) AS o FROM (SELECT pm25, avg(pm25) OVER (PARTITION BY station, wind_speed) AS a, avg(pm25) OVER (PARTITION BY station) AS b FROM met))", "met")
def _(spark, d):
    """Error with and without a group of inputs, and by how much it differs."""
    met = t.with_meteo(t.obs_hour(spark, d))
    fine = met.groupBy("station", "wind_speed").agg(F.sum("pm25").alias("s"), F.count("pm25").alias("n"))
    rough = fine.groupBy("station").agg((F.sum("s") / F.sum("n")).alias("b"))
    both = met.join(fine.withColumn("a", F.col("s") / F.col("n")).select("station", "wind_speed", "a"), ["station", "wind_speed"]).join(rough, "station")
    e = both.agg(F.sqrt(F.avg(F.pow(F.col("pm25") - F.col("a"), 2))).alias("w"), F.sqrt(F.avg(F.pow(F.col("pm25") - F.col("b"), 2))).alias("o"))
    return e.select(r6("w").alias("with_rmse"), r6("o").alias("without_rmse"), F.round(100 * (F.col("o") - F.col("w")) / F.col("o"), 4).alias("delta_pct"))


@query("B12_replay", "SELECT station, day, round(clim, 6) AS predicted, round(actual, 6) AS actual FROM (SELECT station, avg(pm25) AS clim FROM obs WHERE NOT (h >= 473640 AND h < 473760) GROUP BY 1) JOIN (SELECT station, CAST(floor(h / 24) AS BIGINT) AS day, avg(pm25) AS actual FROM obs WHERE h >= 473640 AND h < 473760 GROUP BY 1, 2) USING (station)", "obs")
def _(spark, d):
    """Five days are predicted by what was learned without them."""
    obs = t.obs_hour(spark, d)
    held = (F.col("h") >= 473640) & (F.col("h") < 473760)
    learned = obs.where(~held).groupBy("station").agg(r6(F.avg("pm25")).alias("predicted"))
    actual = obs.where(held).groupBy("station", F.floor(F.col("h") / 24).cast("long").alias("day")).agg(r6(F.avg("pm25")).alias("actual"))
    return actual.join(learned, "station").select("station", "day", "predicted", "actual")


@query("T6_interventions", "SELECT label, day, effect, placebo_pass FROM effects", "effects")
def _(spark, d):
    """The events of the interventions document, as they are looked up in it."""
    return docs.republished(docs.event_effects(spark, d).select("label", "day", "effect", "placebo_pass"), "events")


@query("B10_receipts", "SELECT 'rows' AS name, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'stations', count(DISTINCT station)::DOUBLE FROM obs UNION ALL SELECT 'persistence_mae', (SELECT round(avg(abs(target - pm25)), 6) FROM (SELECT pm25, lead(pm25, 24) OVER (PARTITION BY station ORDER BY h) AS target FROM series)) UNION ALL SELECT 'north_hits', (SELECT count(*) FILTER (WHERE wind_dir >= 330 OR wind_dir <= 30)::DOUBLE FROM met)", "series met")
def _(spark, d):
    return receipts(spark, d)


def receipts(spark, d):
    """What the published numbers rest on, as names and values."""
    obs = t.obs_hour(spark, d)
    s = rel.hourly_spine(obs, "station").withColumn("target", F.lead("pm25", 24).over(Window.partitionBy("station").orderBy("h")))
    one = (t.read(spark, d, "events").agg(F.count(F.lit(1)).cast("double").alias("rows"))
           .join(F.broadcast(obs.agg(F.count_distinct("station").cast("double").alias("stations"))))
           .join(F.broadcast(s.agg(r6(F.avg(F.abs(F.col("target") - F.col("pm25")))).alias("persistence_mae"))))
           .join(F.broadcast(t.with_meteo(obs).agg(F.count_if(geo.in_range(F.col("wind_dir"), 330, 30)).cast("double").alias("north_hits")))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("rows", "stations", "persistence_mae", "north_hits")))).alias("r")).select("r.*")


@query("T7_get_receipts", "SELECT 'stations' AS name, count(DISTINCT station)::DOUBLE AS value FROM obs", "obs")
def _(spark, d):
    doc = docs.document(receipts(spark, d), "checks")
    return docs.entries(doc, "checks", "name: string, value: double").where("name = 'stations'")


@query("X9_references", "SELECT ward_id, 'nowcast.wards[ward_id=' || ward_id || '].pm25_p90' AS path, pm25_p90 AS value FROM nowcast", "nowcast")
def _(spark, d):
    """References that resolve because they are made from what they name."""
    return made_references(docs.nowcast(spark, d), "nowcast", "wards", "pm25_p90").select("ward_id", "path", "value")


def made_references(rows, artifact: str, name: str, field: str):
    path = F.concat(F.lit(f"{artifact}.{name}[ward_id="), "ward_id", F.lit(f"].{field}"))
    return rows.select("ward_id", F.lit(artifact).alias("artifact"), path.alias("path"), F.col(field).alias("value"), F.lit(True).alias("resolved"))


@query("X11_kept_and_dropped", "SELECT s_suppkey AS brief_id, CASE WHEN k IS NULL THEN 'dropped' ELSE 'kept' END AS part, CASE WHEN k IS NULL THEN 'no reference resolves' END AS reason FROM supplier LEFT JOIN wards ON k = s_suppkey % 30", "wards")
def _(spark, d):
    from ..operators import gate
    from .products import _briefs

    refs, doc = _briefs(spark, d)
    every = refs.select("brief_id").distinct()
    kept = gate.verified(every, refs, doc).select("brief_id", F.lit("kept").alias("part"), F.lit(None).cast("string").alias("reason"))
    dropped = every.join(kept, "brief_id", "left_anti").select("brief_id", F.lit("dropped").alias("part"), F.lit("no reference resolves").alias("reason"))
    return kept.unionByName(dropped)


def _named_briefs(spark, d):
    """A brief a supplier, about a ward or none, citing a stage and a scenario of which some exist."""
    k = F.col("s_suppkey")
    ward = F.concat(F.lit("delhi_"), F.lpad((k % 30).cast("string"), 3, "0"))
    briefs = t.read(spark, d, "supplier").select(k.alias("brief_id"), ward.alias("ward_id"), F.when(k % 3 == 0, "III to IV").otherwise("IV to V").alias("stage_transition"), F.concat(F.lit("Act "), ((k % 4 + 1) * 24).cast("string"), F.lit("h earlier")).alias("scenario"))
    scenarios = spark.createDataFrame([(f"Act {abs(s)}h earlier",) for s in docs.SHIFTS], "scenario string")
    stages = spark.createDataFrame([("III to IV",), ("II to III",), ("III to IV",)], "stage_transition string")
    return briefs, stages, scenarios


_CITED = "CASE WHEN s_suppkey % 3 = 0 THEN 'III to IV' END AS stage_transition, CASE WHEN s_suppkey % 4 < 3 THEN 'Act ' || (s_suppkey % 4 + 1) * 24 || 'h earlier' END AS scenario"


@query("X19_ledger_names", f"SELECT s_suppkey AS brief_id, {_CITED} FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 < 3")
def _(spark, d):
    """Of what briefs cite of the ledger only names that it has stay; briefs without any lose the citation."""
    from ..operators import gate

    briefs, stages, scenarios = _named_briefs(spark, d)
    books = spark.createDataFrame([], "ward_id string, effect double, ci_low double, ci_high double")
    return gate.grounded(briefs, books, stages, scenarios).select("brief_id", "stage_transition", "scenario").where("stage_transition is not null or scenario is not null")


@query("X10_grounded", f"SELECT s_suppkey AS brief_id, ward_id, effect, ci_low, ci_high, {_CITED} FROM (SELECT s_suppkey, 'delhi_' || lpad(CAST(s_suppkey % 30 AS VARCHAR), 3, '0') AS ward_id FROM supplier) LEFT JOIN ledger USING (ward_id)", "ledger")
def _(spark, d):
    from ..operators import gate

    briefs, stages, scenarios = _named_briefs(spark, d)
    return gate.grounded(briefs, docs.ledger(spark, d), stages, scenarios)


_DEEP = ("nowcast", "forecast", "attribution", "enforcement", "advisories", "ledger", "replay")


@query("B15_publish_order", "SELECT r_name AS city, place, surface FROM region JOIN (VALUES " + ", ".join(f"(0, {i}, '{x}')" for i, x in enumerate(_DEEP, 1)) + ", (1, 1, 'nowcast'), (1, 2, 'forecast'), (1, 3, 'advisories')) v(tier, place, surface) ON r_regionkey % 2 = tier")
def _(spark, d):
    """What is made for each city in which order, by its tier."""
    from .publish import order

    tier = F.when(F.col("r_regionkey") % 2 == 0, F.array(*map(F.lit, order("deep")))).otherwise(F.array(*map(F.lit, order("standard"))))
    return t.read(spark, d, "region").select(F.col("r_name").alias("city"), F.posexplode(tier).alias("place", "surface")).withColumn("place", F.col("place") + 1)
