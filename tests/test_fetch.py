"""Against a server on this machine that fails on purpose."""

import datetime
import gzip
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest

from skyloom.sources import fetch

CSV = "location_id,sensors_id,location,datetime,lat,lon,parameter,units,value\n{s},1,\"n, m\",2024-01-{d}T03:45:00+05:30,28,77,pm25,u,{v}\n{s},1,n,2024-01-{d}T03:50:00+05:30,28,77,pm25,u,{v}\n"


@pytest.fixture(scope="module")
def server():
    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):  # noqa: N802
            seen[self.path] += 1
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            status, body = 200, ""
            if url.path == "/flaky":
                status, body = (503, "") if seen[self.path] % 3 else (200, "at last")
            elif url.path == "/down":
                status = 500
            elif url.path == "/gone":
                status = 404
            elif url.path == "/" and "prefix" in q:  # a listing of two pages
                p = q["prefix"]
                first = "continuation-token" not in q
                if "=broken/" in p:
                    status = 500
                elif "month=02" not in p:
                    body = f"<Key>{p}day-{1 if first else 2}.csv.gz</Key>" + ("<NextContinuationToken>t+/=</NextContinuationToken>" if first else "")
            elif url.path.startswith("/records/"):
                s = unquote(url.path).split("locationid=")[1].split("/")[0]
                d = 10 if "day-1" in url.path else 11
                body = gzip.compress(CSV.format(s=s, d=d, v=d * 2).encode())
            elif url.path.startswith("/locations/"):
                page = int(q["page"])
                n = 2 if page < 3 else 1
                body = json.dumps({"results": [{"datetime": {"utc": "2024-01-01T05:10:00Z"}, "value": page * 10 + k, "sensorsId": page * 10 + k, "locationsId": 7} for k in range(n)]})
            elif url.path == "/meteo":
                lats = q["latitude"].split(",")
                one = [{"latitude": float(x), "longitude": 77.0, "hourly": {"time": [f"{q.get('start_date', '2024-01-01')}T00:00"], "wind_speed_10m": [float(x)]}} for x in lats]
                body = json.dumps(one if len(one) > 1 else one[0])
            elif url.path.startswith("/fires/"):
                body = "No fire alerts" if url.path.endswith("2024-01-06") else f"latitude,longitude,frp,acq_date,acq_time\n28.1,77.2,5.5,{url.path[-10:]},5\n"
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else body.encode())

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", seen
    httpd.shutdown()


def test_retries_and_failures(spark, server):
    base, seen = server
    got = fetch.fetched(spark, [fetch.Request(k, f"{base}/{k}") for k in ("flaky", "down", "gone")] + [fetch.Request("none", "http://127.0.0.1:9/x")], delay=0.01, tries=3)
    rows = {r.key: r for r in got.collect()}
    assert (rows["flaky"].body, rows["flaky"].attempts, rows["flaky"].error) == ("at last", 3, None)
    assert (rows["down"].status, rows["down"].attempts, rows["down"].error, rows["down"].body) == (500, 3, "HTTP 500", None)
    assert (rows["gone"].attempts, rows["gone"].error) == (1, "HTTP 404") and rows["none"].error and seen["/down"] == 3
    assert got.rdd.getNumPartitions() == 4


def test_backfill_reads_through_a_cache(spark, server, tmp_path):
    base, seen = server
    wanted = fetch.station_months(base, ["7", "8", "broken"], fetch.months((2023, 12), (2024, 2)))
    assert len(wanted) == 9
    fresh = {r.key for r in wanted if r.key.endswith("2024-01")}
    got = fetch.cached(spark, wanted, str(tmp_path / "cache"), fresh, delay=0.01, tries=2)
    hourly = fetch.archive_rows(got).collect()
    assert sorted((r.station_id, r.ts_utc.day, r.pm25) for r in hourly) == sorted((s, d - 1, d * 2.0) for s in "78" for d in (10, 11))
    assert sorted(r.key for r in fetch.failures(got).collect()) == ["broken-2023-12", "broken-2024-01", "broken-2024-02"]
    before = Counter(seen)
    again = fetch.cached(spark, wanted, str(tmp_path / "cache"), fresh, delay=0.01, tries=2)
    assert fetch.archive_rows(again).count() == 4
    asked = {p for p in seen if seen[p] > before[p] and "prefix" in p}
    # The finished month isn't asked for again, the current one is, and so is what failed. A month without files has no answer to keep.
    assert not any("locationid%3D7%2Fyear%3D2023%2Fmonth%3D12" in p for p in asked) and any("locationid%3D7%2Fyear%3D2024%2Fmonth%3D01" in p for p in asked) and any("broken" in p for p in asked)


def test_pages(spark, server):
    base, _ = server
    got = fetch.fetched(spark, fetch.live_pages(base, ["7"], limit=2), delay=0.01)
    sensors = spark.createDataFrame([(10, "pm25"), (11, "no2"), (30, "pm10"), (31, "bc")], "sensor long, parameter string")
    assert got.count() == 3 and sorted((r.parameter, r.value) for r in fetch.live_rows(got, sensors).collect()) == [("no2", 11.0), ("pm10", 30.0), ("pm25", 10.0)]


def test_windows_of_weather_and_fires(spark, server):
    base, _ = server
    day = datetime.date
    requests = fetch.meteo_windows(f"{base}/meteo", [("a", 28.0, 77.0), ("b", 29.0, 77.0)], day(2023, 1, 1), day(2023, 7, 1))
    assert [r.key for r in requests] == ["a-2023-01-01", "a-2023-04-03", "b-2023-01-01", "b-2023-04-03"]
    assert sorted((r.latitude, r.ts_utc.date(), r.wind_speed_10m) for r in fetch.meteo_rows(fetch.fetched(spark, requests)).collect()) == [(x, d, x) for x in (28.0, 29.0) for d in (day(2023, 1, 1), day(2023, 4, 3))]
    many = fetch.meteo_batches(f"{base}/meteo", [(k / 10, 77.0) for k in range(250)])
    assert len(many) == 3 and fetch.meteo_rows(fetch.fetched(spark, many)).count() == 250
    requests, fresh = fetch.fire_windows(f"{base}/fires", (76, 28, 78, 29), day(2024, 1, 1), day(2024, 1, 13), day(2024, 1, 6))
    assert [r.key for r in requests] == ["SP-2024-01-01", "SP-2024-01-06", "NRT-2024-01-11"] and fresh == {"NRT-2024-01-11"} and "/3/2024-01-11" in requests[-1].url
    assert sorted(r.acq_utc.day for r in fetch.fire_rows(fetch.fetched(spark, requests)).collect()) == [1, 11]


def test_polling(spark, server, tmp_path):
    base, _ = server
    stream = fetch.polled(spark, [fetch.Request("meteo", f"{base}/meteo?latitude=28"), fetch.Request("gone", f"{base}/gone")], every=1, delay=0.01)
    run = stream.writeStream.format("memory").queryName("polls").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            run.awaitTermination(1)
            if spark.table("polls").count() >= 4:
                break
    finally:
        run.stop()
    rows = spark.table("polls").collect()
    assert len(rows) >= 4 and {r.error for r in rows if r.key == "gone"} == {"HTTP 404"} and all(r.body for r in rows if r.key == "meteo")
