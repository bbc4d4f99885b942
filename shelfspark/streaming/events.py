"""Job events: throttled progress, latest states, routing. Batch and stream share the rules.

Events are (job_id, kind, stage, progress, status, line, ts); event time is ours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

THROTTLE_MS = 500
EVENT = "job_id string, kind string, stage string, progress double, status string, line string, ts timestamp"


def fragment(kind: Column) -> Column:
    """Which part of a page an event refreshes."""
    return F.when(kind == "log", "log").when(kind == "progress", "row").when(kind.isin("status", "queued"), "queue").otherwise("none")


def frames(events: DataFrame) -> DataFrame:
    """(job_id, name, frame): events as server-sent frames, the text escaped; a status also tells the queue that it changed."""
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;"))
    job = lambda what: F.concat(F.lit("job-"), "job_id", F.lit(f"-{what}"))
    message = lambda name, data: F.struct(name.alias("name"), F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.regexp_replace(data, "\n", "\ndata: "), F.lit("\n\n")).alias("frame"))
    progress = F.concat_ws(" ", "stage", F.floor(F.round(F.col("progress") * 100, 6)).cast("string"))
    sent = (
        F.when(F.col("kind") == "progress", F.array(message(job("progress"), progress)))
        .when(F.col("kind") == "log", F.array(message(job("log"), escaped)))
        .when((F.col("kind") == "status") & (F.col("job_id") != ""), F.array(message(job("status"), F.col("status")), message(F.lit("queue-changed"), F.lit("1"))))
        .when(F.col("kind") == "status", F.array(message(F.lit("queue-changed"), F.lit("1"))))
    )
    return events.select("job_id", F.inline(sent))


def frame_writer(root: str):
    """A foreachBatch function that appends a batch's frames as text, a folder a batch; one that runs again writes the same folder."""

    def apply(batch: DataFrame, number: int) -> None:
        frames(batch).select(F.col("frame").alias("value")).write.mode("overwrite").text(f"{root}/batch={number}")

    return apply


def delivered(events: DataFrame, subscribers: list[str], key: list[str], order: list[str], buffer: int = 64) -> DataFrame:
    """Events of a batch as each subscriber gets them: ``buffer`` of a key at most, in order; the rest are dropped, as the next batch corrects them."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    kept = events.withColumn("_i", place).where(F.col("_i") <= buffer).drop("_i")
    return kept.withColumn("subscriber", F.explode(F.array(*[F.lit(s) for s in subscribers])))


def heartbeats(events: DataFrame, key: str, every_s: int = 25) -> DataFrame:
    """(key, ts): a ping for every ``every_s`` seconds of silence between two events of a key."""
    from pyspark.sql.window import Window

    at = F.unix_micros("ts")
    after = F.lead(at).over(Window.partitionBy(key).orderBy("ts"))
    gaps = events.withColumn("_b", after).select(key, F.floor(at / 1_000_000).alias("a"), F.floor(F.col("_b") / 1_000_000).alias("b"))
    silent = gaps.where(F.col("b") - F.col("a") > every_s)
    pings = F.sequence(F.col("a") + every_s, F.col("b") - 1, F.lit(every_s).cast("long"))
    return silent.select(key, F.explode(pings).alias("s")).select(key, F.timestamp_seconds("s").alias("ts"))


def polled(events: DataFrame, apply, checkpoint: str, every: str = "5 seconds", most: int = 4):
    """A started stream that hands each batch to ``apply`` on at most ``most`` tasks, looking for new input every few seconds."""
    return events.coalesce(most).writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def throttled_batch(events: DataFrame, interval_ms: int = THROTTLE_MS) -> DataFrame:
    """Events that are emitted: a job's first, a changed stage, an end, or ``interval_ms`` after the last *emitted* one.

    The last emitted event is state, so this is a fold over each job's ordered events; a job's events are few (they
    come from one run), and jobs spread over partitions.
    """
    item = F.struct(F.unix_millis("ts").alias("t"), "stage", "progress")
    lists = events.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    kept = "array<struct<t:bigint,stage:string,progress:double>>"
    start = F.struct(F.array().cast(kept).alias("kept"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("string").alias("stage"))

    def step(acc: Column, x: Column) -> Column:
        emit = acc["last"].isNull() | ~acc["stage"].eqNullSafe(x["stage"]) | (x["t"] - acc["last"] >= interval_ms) | (x["progress"] >= 1)
        return F.struct(
            F.when(emit, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
            F.when(emit, x["t"]).otherwise(acc["last"]).alias("last"),
            F.when(emit, x["stage"]).otherwise(acc["stage"]).alias("stage"),
        )

    folded = lists.select("job_id", F.explode(F.aggregate("e", start, step)["kept"]).alias("x"))
    return folded.select("job_id", F.timestamp_millis("x.t").alias("ts"), F.col("x.stage").alias("stage"), F.col("x.progress").alias("progress"))


class Throttle(StatefulProcessor):
    """The same rule on a stream: a job's state is its last emitted stage and time, dropped at whole progress (``sessions`` drops it at any end or expiry)."""

    def __init__(self, interval_ms: int = THROTTLE_MS):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t bigint, stage string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        t0, stage = (last[0], last[1]) if last else (None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "stage", "progress"]).itertuples():
            t = int(row.ts.value // 1_000_000)
            if t0 is None or row.stage != stage or t - t0 >= self.interval_ms or row.progress >= 1:
                out.append((key[0], row.ts, row.stage, row.progress))
                t0, stage = t, row.stage
            if row.progress >= 1:
                t0, stage = None, None  # the job's end; whatever follows is another run
        if t0 is not None:
            self.last.update((t0, stage))
        elif self.last.exists():
            self.last.clear()
        yield pd.DataFrame(out, columns=["job_id", "ts", "stage", "progress"])

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, interval_ms: int = THROTTLE_MS) -> DataFrame:
    """Needs the RocksDB state store provider."""
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Throttle(interval_ms), outputStructType="job_id string, ts timestamp, stage string, progress double", outputMode="append", timeMode="none")


def parsed_progress(lines: DataFrame, total_ms: Column) -> DataFrame:
    """Encoder status lines (job_id, line, ts) as progress events, works on streams."""
    from ..functions.clock import clamped, status_ms

    at = status_ms(F.col("line"))
    return lines.withColumn("at_ms", at).where("at_ms is not null").withColumn("progress", clamped(F.col("at_ms") / total_ms, 0.0, 1.0))


def state_upserter(root: str, schema: str = "job_id string, status string, ts timestamp"):
    """A foreachBatch function that keeps each job's latest state; it writes the buckets of the batch's jobs alone, and a batch that runs again changes nothing."""
    from ..operators.jobs import latest
    from ..sources.keyed import KeyedTable

    def apply(batch: DataFrame, _: int) -> None:
        table = KeyedTable(batch.sparkSession, root, schema, ("job_id",))
        table.change(batch.where("status is not null").select("job_id", "status", "ts"), lambda stored, new: latest(stored.unionByName(new), "job_id"))

    return apply


def simulated(jobs: DataFrame, stages: tuple[str, ...], step_ms: int = 250) -> DataFrame:
    """Events of simulated runs of jobs (job_id, path, start): ten a stage; a path with "fail" ends in error half way."""
    names = F.array(*[F.lit(s) for s in stages])
    n = len(stages) * 10
    last = F.when(F.contains(F.lower("path"), F.lit("fail")), F.lit(n // 2)).otherwise(F.lit(n))
    rows = jobs.select("job_id", "path", "start", last.alias("last"), F.explode(F.sequence(F.lit(1), last)).alias("i"))
    i = F.col("i") - 1
    stage = F.element_at(names, (F.floor(i / 10) + 1).cast("int"))
    end = F.col("i") == F.col("last")
    status = F.when(end & (F.col("last") < n), "error").when(end, "done").otherwise("running")
    return rows.select("job_id", F.lit("progress").alias("kind"), stage.alias("stage"), (((i % 10) + 1) / 10).alias("progress"), status.alias("status"), F.lit("").alias("line"), F.timestamp_millis(F.unix_millis("start") + F.col("i") * step_ms).alias("ts"))
