import json
import random

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.streaming import live


def test_hourly_means_of_a_file_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", "pm25", 10.0), ("2024-01-01 00:50:00", "a", "pm25", 30.0), ("2024-01-01 02:00:00", "a", "pm25", 5.0), ("2024-01-09 00:00:00", "b", "pm25", 1.0)]
    df = spark.createDataFrame(rows, "ts string, station string, parameter string, value double").selectExpr("cast(ts as timestamp) ts", "station", "parameter", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, n in (("hourly", live.hourly_means(stream), 2), ("trailing", live.trailing_means(stream), 26)):
        run = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
        got = spark.table(name).collect()
        assert len(got) == n
        if name == "hourly":
            assert sorted(r.value for r in got) == [5.0, 20.0]


def brute(rows):
    last = {}
    for s, h, v in rows:
        last[s, h] = v
    out = {}
    for s in {k[0] for k in last}:
        hours = [h for x, h in last if x == s]
        for at in range(min(hours), max(hours) + 1):
            own = [last[s, h] for h in range(at - 23, at + 1) if last.get((s, h)) is not None]
            out[s, at] = (sum(own) / len(own) if len(own) >= 16 else None, len(own))
    return out


def readings(seed, hours=120):
    rng = random.Random(seed)
    rows = []
    for s in "ab":
        for h in range(470_000, 470_000 + hours):
            if rng.random() < 0.8:
                rows.append((s, h, None if rng.random() < 0.1 else round(rng.uniform(0, 300), 2)))
    return rows


def test_ring_equals_brute_force():
    """Rows up to 23 hours late, some twice, some replaced."""
    rng = random.Random(3)
    for seed in range(20):
        rows = [r for r in readings(seed) if r[0] == "a"]
        late = sorted(rows, key=lambda r: r[1] + rng.choice([0, 0, 0, 10, 22]))
        late = [x for r in late for x in ([r, r] if rng.random() < 0.2 else [r])]
        hours, values, got = np.full(live.SLOTS, -1), np.full(live.SLOTS, np.nan), {}
        while late:
            n = rng.randint(1, 9)
            part, late = late[:n], late[n:]
            for h, m, n in live.advanced(hours, values, [(h, np.nan if v is None else v) for _, h, v in part]):
                got[h] = (m, n)
        want = {h: v for (_, h), v in brute(rows).items()}
        plain = lambda x: {h: (None if m is None else round(m, 6), n) for h, (m, n) in x.items()}
        assert plain(got) == plain(want)


def test_too_late_changes_nothing():
    hours, values = np.full(live.SLOTS, -1), np.full(live.SLOTS, np.nan)
    live.advanced(hours, values, [(100, 1.0)])
    assert live.advanced(hours, values, [(76, 5.0)]) == [] and live.advanced(hours, values, [(77, 5.0)]) != []


def test_stateful_means_restart_and_replays(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = readings(1)
    rng = random.Random(5)
    late = sorted(rows, key=lambda r: r[1] + rng.choice([0, 0, 20]))
    parts = [late[:60], late[60:120], late[100:], late[-30:]]  # with rows that come again
    schema = "station string, h long, value double"
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = live.mean24(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check"))
        query = out.foreachBatch(live.replacing(str(tmp_path / "store"), ["station", "h"], F.floor(F.col("h") / 24))).trigger(availableNow=True).start()
        query.awaitTermination()

    try:
        for k, part in enumerate(parts):  # each a run of its own: state comes back from the checkpoint
            (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"station": s, "h": h, "value": v}) + "\n" for s, h, v in part))
            if k in (1, 3):
                run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.station, r.h): (r.mean24 and round(r.mean24, 6), r.n) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    want = {k: (m and round(m, 6), n) for k, (m, n) in brute(rows).items()}
    assert {k: v for k, v in got.items() if k in want} == want and all(n == 0 for k, (_, n) in got.items() if k not in want)


def test_upwind_fires_as_streams_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    hour = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    fires = [(k, hour(rng.randrange(72)), 28.6 + rng.uniform(-1.5, 1.5), 77.2 + rng.uniform(-1.5, 1.5), rng.uniform(1, 50)) for k in range(150)]
    weather = [(s, hour(h), 28.6 + s / 10, 77.2, float(rng.randrange(360))) for s in range(3) for h in range(72)]
    f = spark.createDataFrame(fires, "event_id int, at string, lat double, lon double, frp double").withColumn("at", F.col("at").cast("timestamp"))
    w = spark.createDataFrame(weather, "station int, ts string, lat double, lon double, wind_dir double").withColumn("ts", F.col("ts").cast("timestamp"))
    f.write.parquet(str(tmp_path / "f"))
    w.write.parquet(str(tmp_path / "w"))
    streams = (spark.readStream.schema(x.schema).parquet(str(tmp_path / n)) for x, n in ((f, "f"), (w, "w")))
    query = live.upwind_fires(*streams).writeStream.format("memory").queryName("upwind").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.station, str(r.ts), r.event_id) for r in spark.table("upwind").collect())
    a, b = w.alias("w"), f.alias("f")
    here = (F.col("w.lat"), F.col("w.lon"), F.col("f.lat"), F.col("f.lon"))
    every = a.join(b, (F.col("at") <= F.col("ts")) & (F.col("at") > F.col("ts") - F.expr("INTERVAL 24 HOURS")) & geo.is_upwind(geo.haversine_km(*here), geo.bearing(*here), F.col("wind_dir")))
    assert got == sorted((r.station, str(r.ts), r.event_id) for r in every.select("station", "ts", "event_id").collect()) and len(got) > 100
