"""Web services as a data source: one request a row, with retries and a cache."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terralens.operators.records import census, geocode

ATTEMPTS = 3
#: Seconds to wait before the next attempt, times its number, by status.
BACKOFF = {429: 30.0, 504: 60.0}


def fetch(url: str, attempts: int = ATTEMPTS, backoff: dict[int, float] | None = None, timeout: float = 200.0, pause=time.sleep) -> tuple[int, bytes]:
    """(status, body) of a request. Statuses of ``backoff`` are tried again after a wait that grows with each attempt; the last one's status is returned."""
    backoff = BACKOFF if backoff is None else backoff
    status, body = 0, b""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as got:
                return got.status or 200, got.read()
        except urllib.error.HTTPError as e:
            status, body = e.code, e.read()
            if status not in backoff:
                return status, body
            if k + 1 < attempts:
                pause(backoff[status] * (k + 1))
    return status, body


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        pairs = [line.partition("\t") for line in options["requests"].split("\n") if line]
        self.requests = [(k, url) for k, _, url in pairs]
        self.attempts, self.scale = int(options.get("attempts", ATTEMPTS)), float(options.get("waitScale", 1.0))
        self.pause = float(options.get("pause", 0.0))

    def partitions(self) -> list[InputPartition]:
        return [_Part([r]) for r in self.requests]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for key, url in partition.rows:
            status, body = fetch(url, self.attempts, {k: v * self.scale for k, v in BACKOFF.items()})
            if self.pause:
                time.sleep(self.pause)
            yield key, status, body


class WebSource(DataSource):
    """key, status and body of each request. Options: requests (a line each: key, tab, address), attempts, waitScale, pause (seconds after a request)."""

    @classmethod
    def name(cls) -> str:
        return "web_requests"

    def schema(self) -> str:
        return "key string, status int, body binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def responses(spark: SparkSession, requests: list[tuple[str, str]], **options: str) -> DataFrame:
    """The requests are a list: one a city or tile, as services allow few."""
    spark.dataSource.register(WebSource)
    return spark.read.format("web_requests").options(requests="\n".join(f"{k}\t{u}" for k, u in requests), **options).load()


class Pace:
    """At most ``rate`` requests a second for each host, by waiting before a request."""

    def __init__(self, rate: float, clock=time.monotonic, pause=time.sleep):
        self.gap, self.clock, self.pause, self.due = 1.0 / rate, clock, pause, {}

    def wait(self, host: str | None) -> None:
        now = self.clock()
        at = max(now, self.due.get(host, now))
        self.due[host] = at + self.gap
        if at > now:
            self.pause(at - now)


def answers(requests: DataFrame, *, rate: float | dict[str, float] | None = None, lanes: int = 1, parts: int | None = None, attempts: int = ATTEMPTS, wait_scale: float = 1.0) -> DataFrame:
    """key, status and body of each row (key, url) of ``requests``, which may be many.

    A host's requests are in one task, or in ``lanes`` tasks of an equal share of its rate, so ``rate`` (requests a second: one for all hosts, or by host, others being free)
    holds over all tasks without their knowing of each other. First attempts are paced; repeated ones wait as ``fetch`` does. A repeated task asks anew: see ``cached``. Speculative execution would ask twice.
    A row without an address has a null status.
    """
    spark = requests.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paces: dict[str | None, Pace | None] = {}
        for b in batches:
            for key, url, host in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if host not in paces:
                    r = rate.get(host) if isinstance(rate, dict) else rate
                    paces[host] = Pace(r / lanes) if r else None
                status, body = None, None
                if url is not None:
                    if paces[host]:
                        paces[host].wait(host)
                    status, body = fetch(url, attempts, {k: v * wait_scale for k, v in BACKOFF.items()})
                # a row a batch: answers are of any size
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([status], pa.int32()), pa.array([body], pa.binary())], names=["key", "status", "body"])
    host = F.expr("try_parse_url(url, 'HOST')")
    rows = requests.select("key", "url", host.alias("host"), F.pmod(F.xxhash64("key"), F.lit(lanes)).alias("lane"))
    return rows.repartition(n, "host", "lane").select("key", "url", "host").mapInArrow(run, "key string, status int, body binary")


_ANSWER = "key string, status int, body binary"


def _cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(_ANSWER).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _ANSWER)


def cached(spark: SparkSession, requests: DataFrame | list[tuple[str, str]], cache: str, *, rounds: int = 1, rate: float | dict[str, float] | None = None, lanes: int = 1, **options: str) -> DataFrame:
    """Answers from a cache folder where it has them; the others are requested, and the good ones added to it.

    Requests are rows of key and url (or a list of such). What the cache has is removed by an anti-join and read by a semi-join: no key passes the driver. The rest is asked in ``rounds``
    by a hash of the key, each committed to the cache on its own, so a run that is started again after a loss repeats one round at most. Of a key's addresses the least is asked.
    """
    asked = requests if isinstance(requests, DataFrame) else spark.createDataFrame(requests, "key string, url string")
    asked = asked.where("key is not null").groupBy("key").agg(F.min("url").alias("url"))
    free = float(options["pause"]) if options.get("pause") else 0.0
    for k in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k) if rounds > 1 else asked
        new = part.join(_cache(spark, cache).select("key"), "key", "left_anti")
        got = answers(new, rate=rate or (1.0 / free if free else None), lanes=lanes, attempts=int(options.get("attempts", ATTEMPTS)), wait_scale=float(options.get("waitScale", 1.0)))
        got.where("status between 200 and 299").write.mode("append").parquet(cache)
    return _cache(spark, cache).join(asked.select("key"), "key", "left_semi").dropDuplicates(["key"])


def json_body(body: Column, schema: str) -> Column:
    return F.from_json(F.decode(body, "UTF-8"), schema)


#: Shapes of the services' answers, as far as they are read.
PANORAMA = "status string, date string, location struct<lat: double, lng: double>"
ADDRESS = "display_name string, address struct<suburb: string, city_district: string, county: string, city: string, country: string>"
BLOCK = "Block struct<FIPS: string>"
#: A table of texts: names, then values.
SURVEY = "array<array<string>>"


def panoramas(answers: DataFrame) -> DataFrame:
    """key, status, date and place of panoramas; anything but OK has no place."""
    j = json_body(F.col("body"), PANORAMA)
    ok = j["status"] == "OK"
    return answers.select("key", F.coalesce(j["status"], F.lit("UNKNOWN")).alias("status"), F.when(ok, j["date"]).alias("date"), F.when(ok, j["location"]["lat"]).alias("lat"), F.when(ok, j["location"]["lng"]).alias("lon"))


def surveys(answers: DataFrame) -> DataFrame:
    """key and a map of names to values of a survey's first row; negative values mark missing ones."""
    j = json_body(F.col("body"), SURVEY)
    pairs = F.map_from_arrays(F.element_at(j, 1), F.element_at(j, 2))
    number = lambda v: v.try_cast("double")
    return answers.select("key", F.transform_values(pairs, lambda k, v: F.when(~F.coalesce(number(v) < 0, F.lit(False)), v)).alias("values"))


def median_composite(scenes: DataFrame, most_cloud: float = 20.0, scale: float = 1e-4) -> DataFrame:
    """Median over time of each pixel and band (tile, pixel, band, value, cloud), of scenes with less cloud than ``most_cloud`` percent, scaled. A buffer holds one pixel's scenes over time."""
    clear = scenes.where(F.col("cloud") < most_cloud)
    return clear.groupBy("tile", "pixel", "band").agg((F.percentile("value", F.lit(0.5)) * scale).alias("value"), F.count("*").alias("scenes"))


def addresses(answers: DataFrame) -> DataFrame:
    """key, full address, and the place by the first of suburb, district and county that isn't empty."""
    a = json_body(F.col("body"), ADDRESS)
    part = lambda k: a["address"][k]
    return answers.select("key", a["display_name"].alias("address"), geocode(part("suburb"), part("city_district"), part("county")).alias("suburb"), F.coalesce(part("country"), F.lit("")).alias("country"))


def census_blocks(answers: DataFrame) -> DataFrame:
    """key and the state, county and tract of a block's code; null without one."""
    code = json_body(F.col("body"), BLOCK)["Block"]["FIPS"]
    return answers.select("key", F.when(F.char_length(code) >= 11, census(code, F.lit(None).cast("int"))).alias("census")).select("key", "census.state", "census.county", "census.tract")
