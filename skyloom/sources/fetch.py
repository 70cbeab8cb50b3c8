"""Answers of public services as tables: a Python data source whose partitions are requests.

A request is one file or answer (``one``), the pages of a list (``pages``), or all files of a listing of an object store
(``listing``). Each is a partition, so requests run on the executors side by side; each retries on rate limits, server
errors and network errors with growing delays. A request that fails for good is a row with its error, and the others go on.
Planners give the requests of a station's months, of windows of days and of batches of points; parsers turn bodies into the
same rows as the readers of files in :mod:`.feeds`.
"""

from __future__ import annotations

import datetime
import gzip
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.staging import Steps
from . import feeds

SCHEMA = "key string, part int, url string, status int, attempts int, body string, error string"
# Statuses worth another try, tries, the first delay and its growth; days and points of a request.
RETRIED, TRIES, DELAY, GROWTH = frozenset({429, 500, 502, 503, 504}), 5, 5.0, 1.7
METEO_DAYS, FIRE_DAYS, POINTS, PAGE = 92, 5, 100, 1000


@dataclass(frozen=True)
class Request:
    """``key`` names the answer, in caches too. ``kind``: one, pages (``url`` has ``{page}``), listing (``url`` is the listing's)."""

    key: str
    url: str
    kind: str = "one"
    limit: int = PAGE


@dataclass
class _Part(InputPartition):
    request: Request

    def __init__(self, request: Request) -> None:
        super().__init__(request)
        self.request = request


class Failed(Exception):
    def __init__(self, url: str, status: int | None, attempts: int, why: str) -> None:
        super().__init__(why)
        self.row = (url, status, attempts)


def get(url: str, options: dict) -> tuple[int, int, str]:
    """Status, attempts and text of an answer."""
    delay, tries = float(options.get("delay", DELAY)), int(options.get("tries", TRIES))
    status, why = None, ""
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "skyloom"}), timeout=float(options.get("timeout", 90))) as answer:
                body = answer.read()
                return answer.status, attempt, (gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body).decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            status, why = e.code, f"HTTP {e.code}"
            if e.code not in RETRIED:
                raise Failed(url, status, attempt, why) from e
        except (OSError, EOFError) as e:  # timeouts and broken connections too
            status, why = None, type(e).__name__
        if attempt < tries:
            time.sleep(delay)
            delay *= GROWTH
    raise Failed(url, status, tries, why)


def answers(request: Request, options: dict) -> Iterator[tuple]:
    """The rows of a request; what fails is its last row."""
    part = 0
    try:
        if request.kind == "one":
            yield (request.key, 0, request.url, *get(request.url, options), None)
        elif request.kind == "pages":
            while True:
                url = request.url.format(page=part + 1)
                status, attempts, body = get(url, options)
                yield request.key, part, url, status, attempts, body, None
                part += 1
                if len(json.loads(body).get("results", [])) < request.limit:
                    return
        else:
            token = ""
            while token is not None:
                _, _, listed = get(request.url + (f"&continuation-token={urllib.parse.quote(token, safe='')}" if token else ""), options)
                for name in re.findall(r"<Key>([^<]*)</Key>", listed):
                    url = urllib.parse.urljoin(request.url, "/" + urllib.parse.quote(name))
                    yield (request.key, part, url, *get(url, options), None)
                    part += 1
                more = re.search(r"<NextContinuationToken>([^<]*)</NextContinuationToken>", listed)
                token = more[1] if more else None
    except Failed as e:
        url, status, attempts = e.row
        yield request.key, part, url, status, attempts, None, str(e)
    except (ValueError, AttributeError) as e:
        yield request.key, part, request.url, None, None, None, type(e).__name__


class Fetch(DataSource):
    """``plan``: JSON list of requests. Options ``delay``, ``tries``, ``timeout``; for streams ``every``, seconds from poll to poll."""

    @classmethod
    def name(cls) -> str:
        return "skyloom_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(Request(**r)) for r in json.loads(self.options["plan"])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return answers(partition.request, self.options)


class _StreamReader(DataSourceStreamReader):
    """All requests once a poll. An offset is a poll's number; a poll that was missed is not made up for, as services answer with
    the present only, and a batch that is tried again asks again."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"poll": self._now() - 1}

    def latestOffset(self) -> dict:
        return {"poll": self._now()}

    def _now(self) -> int:
        return int(time.time() / float(self.options.get("every", 600)))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(Request(**r)) for r in json.loads(self.options["plan"])] if end["poll"] > start["poll"] else []

    def read(self, partition: _Part) -> Iterator[tuple]:
        return answers(partition.request, self.options)

    def commit(self, end: dict) -> None:
        pass


def _with_options(reader, requests: list[Request], options: dict):
    return reader.format(Fetch.name()).options(plan=json.dumps([asdict(r) for r in requests]), **{k: str(v) for k, v in options.items()})


def fetched(spark: SparkSession, requests: list[Request], **options) -> DataFrame:
    """The answers, a row each; those with an ``error`` have no body. Each use of the frame asks anew: stage it or cache it."""
    spark.dataSource.register(Fetch)
    return _with_options(spark.read, requests, options).load()


def polled(spark: SparkSession, requests: list[Request], **options) -> DataFrame:
    """The answers as a stream."""
    spark.dataSource.register(Fetch)
    return _with_options(spark.readStream, requests, options).load()


def cached(spark: SparkSession, requests: list[Request], root: str, fresh: set[str], **options) -> DataFrame:
    """The answers, of which those under ``root`` are not asked for again, unless they are ``fresh`` (the current month, say). What
    was fetched whole and isn't fresh is kept there, a partition a key; a key with an error is asked for again next time."""
    names, folder = {r.key for r in requests}, spark._jvm.org.apache.hadoop.fs.Path(root)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    kept = spark.read.schema(SCHEMA).parquet(root) if there else spark.createDataFrame([], SCHEMA)
    have = {r.key for r in kept.select("key").distinct().collect()} & names - fresh  # a row a request
    asked = [r for r in requests if r.key not in have]
    old = kept.where(F.col("key").isin(sorted(have)))
    if not asked:
        return old
    new = Steps(spark, "fetch").staged(fetched(spark, asked, **options).repartition(max(1, len(asked)), "key"))
    bad = {r.key for r in new.where("error is not null").select("key").distinct().collect()}
    final = new.where(~F.col("key").isin(sorted(bad | fresh)))
    (final.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(root))
    return Steps(spark, "fetch-all").staged(old).unionByName(new) if have else new


def failures(answers_: DataFrame) -> DataFrame:
    """``key, url, status, attempts, error`` of what failed, for the log."""
    return answers_.where("error is not null").select("key", "url", "status", "attempts", "error")


# Requests.


def windows(first: datetime.date, last: datetime.date, days: int) -> list[tuple[datetime.date, datetime.date]]:
    """Ranges of up to ``days`` days, ends inclusive."""
    out = []
    while first <= last:
        out.append((first, min(last, first + datetime.timedelta(days=days - 1))))
        first = out[-1][1] + datetime.timedelta(days=1)
    return out


def months(first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
    a, b = (y * 12 + m - 1 for y, m in (first, last))
    return [(k // 12, k % 12 + 1) for k in range(a, b + 1)]


def station_months(base: str, stations: list[str], wanted: list[tuple[int, int]]) -> list[Request]:
    """A listing a station and month of an archive laid out as locationid=/year=/month=."""
    prefix = lambda s, y, m: urllib.parse.quote(f"records/csv.gz/locationid={s}/year={y}/month={m:02d}/", safe="")
    return [Request(f"{s}-{y}-{m:02d}", f"{base}/?list-type=2&prefix={prefix(s, y, m)}", "listing") for s in stations for y, m in wanted]


def meteo_windows(base: str, points: list[tuple[str, float, float]], first: datetime.date, last: datetime.date) -> list[Request]:
    """A request a point and window of days of a weather archive."""
    query = lambda lat, lon, a, b: urllib.parse.urlencode({"latitude": round(lat, 4), "longitude": round(lon, 4), "start_date": a, "end_date": b, "hourly": ",".join(feeds.METEO), "wind_speed_unit": "ms", "timezone": "UTC"})
    return [Request(f"{name}-{a}", f"{base}?{query(lat, lon, a, b)}") for name, lat, lon in points for a, b in windows(first, last, METEO_DAYS)]


def meteo_batches(base: str, points: list[tuple[float, float]], forecast_days: int = 4, past_days: int = 3) -> list[Request]:
    """A request a batch of points of a weather forecast."""
    out = []
    for k in range(0, len(points), POINTS):
        part = points[k:k + POINTS]
        query = urllib.parse.urlencode({"latitude": ",".join(str(round(p[0], 4)) for p in part), "longitude": ",".join(str(round(p[1], 4)) for p in part), "hourly": ",".join(feeds.METEO), "wind_speed_unit": "ms", "forecast_days": forecast_days, "past_days": past_days, "timezone": "UTC"})
        out.append(Request(f"batch-{k // POINTS}", f"{base}?{query}"))
    return out


def fire_windows(base: str, bbox: tuple[float, float, float, float], first: datetime.date, last: datetime.date, cutoff: datetime.date) -> tuple[list[Request], set[str]]:
    """A request a window of days of fire detections, from the archive up to its last day and else from the live feed; and the
    keys of the trailing windows, which stay live."""
    out, fresh, area = [], set(), ",".join(map(str, bbox))
    for a, b in windows(first, last, FIRE_DAYS):
        source = "SP" if a <= cutoff else "NRT"
        out.append(Request(f"{source}-{a}", f"{base}/{source}/{area}/{(b - a).days + 1}/{a}"))
        if (last - a).days < FIRE_DAYS:
            fresh.add(out[-1].key)
    return out, fresh


def live_pages(base: str, stations: list[str], limit: int = PAGE) -> list[Request]:
    """The pages of each station's latest readings."""
    return [Request(s, f"{base}/locations/{urllib.parse.quote(s)}/latest?limit={limit}&page={{page}}", "pages", limit) for s in stations]


# Bodies.


def csv_rows(answers_: DataFrame, names: list[str]) -> DataFrame:
    """Lines of CSV bodies as columns ``names`` (strings), found by the body's own header; a body whose header lacks one gives no rows."""
    lines = F.filter(F.split(F.regexp_replace("body", "\r", ""), "\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.transform(F.split(line, ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    rows = answers_.where("body is not null").select("key", lines.alias("_l")).where(F.size("_l") > 1).withColumn("_h", cells(F.get("_l", 0)))
    for n in names:
        rows = rows.where(F.array_contains("_h", n))
    rows = rows.select("key", "_h", F.explode(F.slice("_l", F.lit(2), F.size("_l"))).alias("_r")).withColumn("_r", cells(F.col("_r")))
    return rows.select("key", *(F.get("_r", F.array_position("_h", n).cast("int") - 1).alias(n) for n in names))


def archive_rows(answers_: DataFrame) -> DataFrame:
    """Hourly wide observations, as :func:`.feeds.archive` has them."""
    raw = csv_rows(answers_, ["location_id", "datetime", "lat", "lon", "parameter", "value"])
    return feeds.hourly_wide(raw.select(F.col("location_id").try_cast("long").alias("location_id"), "datetime", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), "parameter", "value"))


def meteo_rows(answers_: DataFrame) -> DataFrame:
    """Hourly weather by the place that the answer names; an answer for several points is a list."""
    kind = "array<struct<latitude: double, longitude: double, hourly: struct<time: array<string>, " + ", ".join(f"{k}: array<double>" for k in feeds.METEO) + ">>>"
    listed = F.when(F.ltrim("body").startswith("["), F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    return feeds.hourly_points(answers_.where("body is not null").select(F.explode(F.from_json(listed, kind)).alias("p")).select("p.*"))


def fire_rows(answers_: DataFrame) -> DataFrame:
    """Detections, as :func:`.feeds.fires` has them."""
    return feeds.detections(csv_rows(answers_, ["latitude", "longitude", "frp", "acq_date", "acq_time"]))


def live_rows(answers_: DataFrame, sensors: DataFrame) -> DataFrame:
    """Latest readings, as :func:`.feeds.live` has them."""
    kind = "results array<struct<datetime: struct<utc: string>, value: double, sensorsId: bigint, locationsId: bigint>>"
    return feeds.latest(answers_.where("body is not null").select(F.explode(F.from_json("body", kind)["results"]).alias("r")).select("r.*"), sensors)

