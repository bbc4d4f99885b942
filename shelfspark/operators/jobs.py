"""The job table: counts, pages, claims, states, upserts.

Changes meet the stored rows in one full outer join on the key. ``sources.store`` applies them to the buckets of
the keys that change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIVE = ("pending", "running")
# Which states may follow which.
TRANSITIONS = {"pending": ("running", "cancelled"), "running": ("done", "error", "cancelled"), "error": (), "done": (), "cancelled": ()}
# Stages of each kind of job, in order.
STAGES = {"convert": ("probe", "plan", "merge", "chapters", "tag", "verify", "move", "cleanup"), "retag": ("probe", "chapters", "tag", "verify", "move"), "sort": ("probe", "move")}


def counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def page(jobs: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1), newest first; a top-k, not a full sort."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def next_pending(jobs: DataFrame) -> DataFrame:
    """The oldest pending job."""
    return jobs.where("status = 'pending'").orderBy("created_at", "id").limit(1)


def without_active(wanted: DataFrame, jobs: DataFrame, on: list[str]) -> DataFrame:
    """Requests for which no job of the same key is pending or running."""
    return wanted.join(jobs.where(F.col("status").isin(*ACTIVE)).select(*on).distinct(), on, "left_anti")


def upserted(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with new values over them, column by column; a null new value keeps the old one."""
    values = [c for c in stored.columns if c not in key]
    a = stored.select(*key, *[F.col(c).alias(f"_old_{c}") for c in values])
    b = new.select(*key, *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_new_{c}") for c in values])
    return a.join(b, key, "full_outer").select(*key, *[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in values])


def misses(wanted: DataFrame, cache: DataFrame, key: list[str], column: str) -> DataFrame:
    """Wanted keys whose cached column is unknown."""
    return wanted.join(cache.where(F.col(column).isNotNull()), key, "left_anti")


def latest(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Each key's last event as its state; one partial aggregation."""
    return events.groupBy(key).agg(F.max_by("status", F.struct(time, "status")).alias("status"), F.max(time).alias(time), F.count("*").alias("n"))


def transitions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds before and allowed: whether a state may follow the one before it (a first must be pending)."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    rows = events.withColumn("before", before)
    allowed = F.when(F.col("before").isNull(), F.col("status") == "pending").otherwise(F.coalesce(F.array_contains(F.try_element_at(table, F.col("before")), F.col("status")), F.lit(False)))
    return rows.withColumn("allowed", allowed)


def reconciled(jobs: DataFrame, now: Column) -> DataFrame:
    """At start, jobs that were running have been interrupted."""
    running = F.col("status") == "running"
    return jobs.withColumn("error", F.when(running, "interrupted").otherwise(F.col("error"))).withColumn("finished_at", F.when(running, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(running, "error").otherwise(F.col("status")))


def finished(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Running jobs with results (id, result, error) end as done, or error where an error is given; others keep their state."""
    r = results.select("id", F.col("result").alias("_result"), F.col("error").alias("_error"), F.lit(True).alias("_has"))
    out = jobs.join(r, "id", "left")
    ends = F.col("_has") & (F.col("status") == "running")
    status = F.when(ends, F.when(F.coalesce("_error", F.lit("")) != "", "error").otherwise("done")).otherwise(F.col("status"))
    return out.withColumn("error", F.when(ends, F.col("_error")).otherwise(F.col("error"))).withColumn("result", F.when(ends, F.col("_result")).otherwise(F.col("result"))).withColumn("finished_at", F.when(ends, now).otherwise(F.col("finished_at"))).withColumn("status", status).drop("_result", "_error", "_has")


def cancelled(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Pending jobs of the given ids are cancelled; running ones are asked to stop elsewhere."""
    out = jobs.join(ids.select("id", F.lit(True).alias("_stop")).distinct(), "id", "left")
    stop = F.col("_stop") & (F.col("status") == "pending")
    return out.withColumn("finished_at", F.when(stop, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(stop, "cancelled").otherwise(F.col("status"))).drop("_stop")


def retries(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """New pending copies of failed or cancelled jobs."""
    again = jobs.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status").isin("error", "cancelled"))
    blank = {c: F.lit(None).cast(again.schema[c].dataType) for c in ("error", "result", "started_at", "finished_at") if c in again.columns}
    return again.withColumns(blank).withColumn("id", F.md5(F.concat("id", now.cast("string")))).withColumn("created_at", now).withColumn("status", F.lit("pending"))


def history(jobs: DataFrame) -> DataFrame:
    """What stays when the history is cleared."""
    return jobs.where(F.col("status").isin(*ACTIVE))


def unused(files: DataFrame, used: DataFrame, older_than: Column) -> DataFrame:
    """Stored files (name, mtime) that no job uses and that are old enough to go."""
    return files.join(used.select("name").distinct(), "name", "left_anti").where(F.col("mtime") < older_than)


def merge_plan(files: DataFrame, key: str) -> DataFrame:
    """(key, total_ms, stream_copy, bitrate, sample_rate): sums, an all-copyable test, and the first file's rates."""
    from ..functions.clock import snapped_rate

    copyable = (F.col("codec") == "aac") & F.contains(F.col("container"), F.lit("mp4"))
    first = lambda c: F.min_by(c, "pos")
    return files.groupBy(key).agg(F.sum("duration_ms").cast("long").alias("total_ms"), F.bool_and(copyable).alias("stream_copy"), snapped_rate(first("bitrate_kbps")).alias("bitrate_kbps"), first("sample_rate").alias("sample_rate"))


def plan_text(stream_copy: Column, kbps: Column, rate: Column) -> Column:
    return F.when(stream_copy, "stream copy").otherwise(F.format_string("transcode to AAC %dk at %d Hz", kbps, rate))


def queue_decision(active: Column, readable: Column, retag_files: Column, valid_form: Column, metadata_error: Column) -> Column:
    """struct(queued, reason): the first reason not to queue a request."""
    reason = F.when(active, "already queued").when(~readable, "unreadable").when(retag_files > 1, "several files to retag").when(~valid_form, "form is not valid").when(metadata_error != "", metadata_error)
    return F.struct(reason.isNull().alias("queued"), F.coalesce(reason, F.lit("")).alias("reason"))


def inserted(stored: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """The job table with new requests (id, ...) as pending jobs; an id that is stored already is not added again."""
    fresh = new.join(stored.select("id"), "id", "left_anti").withColumn("status", F.lit("pending")).withColumn("created_at", at)
    return stored.unionByName(fresh, allowMissingColumns=True)


def sort_jobs(rows: DataFrame, active: DataFrame) -> DataFrame:
    """One job for each file that a sort would move (path, state, new) and that no active job (path) works on."""
    return rows.where("state = 'move'").join(active.select("path").distinct(), "path", "left_anti").select("path", F.col("new").alias("target"), F.lit("sort").alias("kind"))
