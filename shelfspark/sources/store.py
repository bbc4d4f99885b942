"""The stored tables: settings, jobs, and the cache of catalog answers, each changed by key (see ``keyed``).

Every change writes only the buckets of the keys that it changes, and changes nothing when it runs again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import jobs, settings
from .keyed import BUCKETS, KeyedTable

SETTINGS = "key string, value string"
JOBS = "id long, kind string, path string, options string, status string, error string, created_at timestamp, started_at timestamp, finished_at timestamp"
CACHE = "asin string, region string, book string, chapters string, fetched_at timestamp"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    @property
    def settings(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/settings", SETTINGS, ("key",), 1)

    @property
    def jobs(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/jobs", JOBS, ("id",), self.buckets)

    @property
    def cache(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/cache", CACHE, ("asin", "region"), self.buckets)

    def save_settings(self, row: DataFrame) -> None:
        """All keys of a row of valid settings at once; others are refused."""
        if wrong := row.select(F.array_join(settings.problems(), "; ").alias("p")).where("p <> ''").first():
            raise ValueError(f"invalid settings: {wrong['p']}")
        self.settings.upsert(settings.as_rows(row), [])

    def load_settings(self, **defaults) -> DataFrame:
        return settings.typed(self.settings.read(), **defaults)

    def remember(self, answers: DataFrame) -> list[int]:
        """Books or chapters (asin, region, fetched_at, and book or chapters or both): what an answer lacks stays as it is."""
        return self.cache.upsert(answers, ["fetched_at"])

    def add(self, wanted: DataFrame) -> list[int]:
        """New jobs (id, kind, path, options, created_at), pending: those whose id is new and whose path has no active job of that kind.

        Of several new jobs for one path and kind the first by creation counts.
        """
        first = F.row_number().over(Window.partitionBy("kind", "path").orderBy("created_at", "id"))
        once = wanted.withColumn("_first", first).where("_first = 1").drop("_first")
        return self.jobs.insert(jobs.without_active(once, self.jobs.read(), ["kind", "path"]).withColumn("status", F.lit("pending")), ["created_at"])

    def move(self, changes: DataFrame) -> list[int]:
        """Jobs' next states (id, status, at, error): those that may follow the stored one; of several for a job the first.

        A job that starts or ends gets the time; a change that comes again finds its state taken and does nothing.
        """
        table = F.create_map(*[x for k, v in jobs.TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])

        def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
            first = new.groupBy("id").agg(F.min_by(F.struct("status", "at", "error"), F.struct("at", "status")).alias("_n"))
            n, both = F.col("_n"), stored.join(first, "id", "left")
            ok = F.coalesce(F.array_contains(F.try_element_at(table, F.col("status")), n["status"]), F.lit(False))
            out = both.withColumn("_ok", ok).withColumn("started_at", F.when(F.col("_ok") & (n["status"] == "running"), n["at"]).otherwise(F.col("started_at")))
            out = out.withColumn("finished_at", F.when(F.col("_ok") & (n["status"] != "running"), n["at"]).otherwise(F.col("finished_at"))).withColumn("error", F.when(F.col("_ok"), n["error"]).otherwise(F.col("error")))
            return out.withColumn("status", F.when(F.col("_ok"), n["status"]).otherwise(F.col("status"))).drop("_n", "_ok")

        return self.jobs.change(changes, merge)
