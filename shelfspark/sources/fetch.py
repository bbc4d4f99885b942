"""Rate-limited, retrying reads of JSON answers: of a column of addresses, or as a Python data source of a few.

    fetched(addresses, "pkg.mod:fetch")          # a batch or a stream of rows with a url column
    fetch_all(addresses, table, "pkg.mod:fetch")  # into a stored table, in rounds that a new run takes up

Addresses stay in their table: they are dealt into lanes, one task each. The permitted rate is cut into slots of
the clock, which the lanes own in turn; every request, first or repeated, waits for a slot of its lane. So all tasks together
keep to the rate, and so does a task that is run again.

    spark.dataSource.register(JsonFetch)
    spark.read.format("json_fetch").option("urls", json).option("transport", "pkg.mod:fetch").load()

The transport is a function address -> (status, headers, body), so tests need no network.
"""

from __future__ import annotations

import importlib
import json
import random
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Requests a minute, attempts, first wait in seconds, bounds of a wanted wait.
RATE, ATTEMPTS, FIRST_WAIT, LEAST_WAIT, MOST_WAIT = 80, 3, 0.5, 1, 120


class TokenBucket:
    """At most ``n`` permits in any ``period`` seconds, spread evenly once the first are spent."""

    def __init__(self, n: float, period: float, now=time.monotonic, sleep=time.sleep):
        self.free, self.size, self.per, self.now, self.sleep = float(n), float(n), n / period, now, sleep
        self.at = now()

    def wait(self) -> None:
        t = self.now()
        self.free, self.at = min(self.size, self.free + (t - self.at) * self.per), t
        if self.free < 1:
            self.sleep((1 - self.free) / self.per)
            self.free, self.at = 1.0, self.now()
        self.free -= 1


class Slots:
    """Permits of one lane: of the clock's slots, each ``60 / rate`` seconds long, every ``lanes``-th is this lane's, for one request."""

    def __init__(self, lane: int, lanes: int, rate: float, now=time.time, sleep=time.sleep):
        self.lane, self.lanes, self.length, self.now, self.sleep = lane, lanes, 60 / rate, now, sleep
        self.last = int(now() / self.length)  # a slot that has begun may be used by a run of this lane before

    def wait(self) -> None:
        first = max(self.last + 1, int(self.now() / self.length))
        self.last = first + (self.lane - first) % self.lanes
        while (left := self.last * self.length - self.now()) > 0:
            self.sleep(left)


def wanted_wait(header: str | None) -> float | None:
    """Seconds of a Retry-After header, held to bounds; None for no number."""
    try:
        return float(min(MOST_WAIT, max(LEAST_WAIT, int(header or ""))))
    except ValueError:
        return None


def fetch(url: str, transport, bucket: TokenBucket | Slots, sleep=time.sleep, jitter=random.random) -> tuple[str, str | None]:
    """('ok', body), ('not_found', None) or ('error', None): other failures are tried again with growing waits."""
    for i in range(ATTEMPTS):
        bucket.wait()
        try:
            status, headers, body = transport(url)
        except OSError:
            status, headers, body = 0, {}, None
        if status == 200:
            return "ok", body
        if status == 404:
            return "not_found", None
        if status and status != 429 and status < 500:
            return "error", None
        if i + 1 < ATTEMPTS:
            sleep(wanted_wait(headers.get("Retry-After")) or FIRST_WAIT * 2**i * (1 + jitter() / 2))
    return "error", None


ANSWER = "url string, status string, body string, asked timestamp"


def _transport(name: str):
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def fetched(addresses: DataFrame, transport: str, rate: float = RATE, lanes: int = 4) -> DataFrame:
    """ANSWER rows of a batch or stream with a url column: at most ``rate`` requests a minute over all lanes. Null addresses are left out."""

    def run(batches):
        call, slots = _transport(transport), {}
        for batch in batches:
            for url, lane in zip(batch.column("url").to_pylist(), batch.column("lane").to_pylist(), strict=True):
                own = slots.setdefault(lane, Slots(lane, lanes, rate))
                status, body = fetch(url, call, own)
                asked = int(own.last * own.length * 1_000_000)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([status]), pa.array([body], pa.string()), pa.array([asked], pa.timestamp("us", "UTC"))], ["url", "status", "body", "asked"])

    dealt = addresses.select("url").where("url is not null").withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(lanes)).cast("int"))
    return dealt.repartition(lanes, "lane").mapInArrow(run, ANSWER)


def fetch_all(addresses: DataFrame, table, transport: str, rate: float = RATE, lanes: int = 4, round_size: int = 400, rounds: int | None = None) -> int:
    """Fill a KeyedTable of ANSWER rows by url with the answers it lacks; returns how many addresses were asked.

    Each round asks for ``round_size`` addresses and stores what it got, failures too, which later runs try again; a run that was cut off
    goes on after its last whole round.
    """
    asked, started = 0, addresses.sparkSession.sql("select current_timestamp() t").first()["t"]
    while rounds is None or rounds > 0:
        known = table.read().where((F.col("status") != "error") | (F.col("asked") >= F.lit(started))).select("url")
        left = addresses.select("url").where("url is not null").distinct().join(known, "url", "left_anti").limit(round_size)
        # written once: its answers are read twice
        answers = table.spark.read.schema(ANSWER).parquet(_stored(fetched(left, transport, rate, lanes)))
        n = answers.count()
        if not n:
            return asked
        table.upsert(answers, ["asked"])
        asked, rounds = asked + n, None if rounds is None else rounds - 1
    return asked


def _stored(rows: DataFrame) -> str:
    from .tables import scratch

    path = scratch(rows.sparkSession, "answers")
    rows.write.parquet(path)
    return path


class _Addresses(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.parts = max(1, int(options.get("partitions", 1)))
        self.rate = float(options.get("rate", RATE)) / self.parts
        self.transport = options["transport"]

    def partitions(self):
        return [_Addresses(self.urls[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition):
        call = _transport(self.transport)
        bucket = TokenBucket(max(1.0, self.rate), 60 if self.rate >= 1 else 60 / self.rate)
        for url in partition.urls:
            status, body = fetch(url, call, bucket)
            yield url, status, body


class JsonFetch(DataSource):
    """Rows (url, status, body)."""

    @classmethod
    def name(cls):
        return "json_fetch"

    def schema(self):
        return "url string, status string, body string"

    def reader(self, schema):
        return _Reader(self.options)
