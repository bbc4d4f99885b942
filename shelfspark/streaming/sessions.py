"""Runs of jobs as a stream with timers: throttled progress, heartbeats out of silence, and state that goes.

Events are (job_id, stage, progress, status, ts), in event time. A job's state (what was emitted last, what was heard last)
is dropped when it ends (done, error or cancelled, or whole progress) or when nothing was heard of
it for ``expire_s``. Between, every ``beat_s`` of silence sends a beat. Both come from event-time timers, so a silent job
is heard of without any event of its own: it is the watermark that passes.

``watched_batch`` is the batch twin. It splits a job's events where the rule emits whatever came before (a changed stage, an end, a
gap of the interval), and folds only the short runs between, so that no value holds a whole job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

INTERVAL_MS, BEAT_S, EXPIRE_S = 500, 25, 3600
ENDS = ("done", "error", "cancelled")
OUT = "job_id string, kind string, ts timestamp, stage string, progress double, status string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Watch(StatefulProcessor):
    """State of a job: ``heard`` (time of its last event), ``beat`` (of the last beat or event), ``sent`` and ``stage`` (of what was emitted last), in milliseconds."""

    def __init__(self, interval_ms: int, beat_s: int, expire_s: int):
        self.interval, self.beat, self.expire = interval_ms, beat_s * 1000, expire_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "heard bigint, beat bigint, sent bigint, stage string")

    def _beats(self, job: str, heard: int, beat: int, until: int) -> tuple[list[tuple], int]:
        """Beats of the silence since ``heard`` that fall after ``beat`` and before ``until``."""
        out, until = [], min(until, heard + self.expire)
        while beat + self.beat < until:
            beat += self.beat
            out.append((job, "beat", pd.Timestamp(beat, unit="ms"), None, None, None))
        return out, beat

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        heard, beat, sent, stage = now if now else (None, None, None, None)
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values(["ts", "stage", "progress", "status"], na_position="first").itertuples():
            t = int(row.ts.value // 1_000_000)
            if heard is not None:
                beats, _ = self._beats(key[0], heard, beat, t)
                out += beats
                if t >= heard + self.expire:
                    sent, stage = None, None  # the run had expired: this is another
            end = row.status in ENDS or row.progress >= 1
            if sent is None or row.stage != stage or t - sent >= self.interval or end:
                out.append((key[0], "end" if end else "progress", row.ts, row.stage, row.progress, row.status))
                sent, stage = t, row.stage
            heard = beat = t
            if end:
                heard = beat = sent = stage = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if heard is None:
            self.state.clear()
        else:
            self.state.update((heard, beat, sent, stage))
            self.handle.registerTimer(min(beat + self.beat, heard + self.expire))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.state.exists():
            heard, beat, sent, stage = self.state.get()
            at = timerValues.getCurrentWatermarkInMs()
            out, beat = self._beats(key[0], heard, beat, at + 1)
            if at >= heard + self.expire:
                self.state.clear()
            else:
                self.state.update((heard, beat, sent, stage))
                self.handle.registerTimer(min(beat + self.beat, heard + self.expire))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def watched_stream(events: DataFrame, delay: str = "10 seconds", interval_ms: int = INTERVAL_MS, beat_s: int = BEAT_S, expire_s: int = EXPIRE_S) -> DataFrame:
    """OUT rows of a stream of events; events later than ``delay`` after the latest are dropped. Needs the RocksDB state store provider."""
    seen = events.select("job_id", "stage", "progress", "status", "ts").withWatermark("ts", delay)
    return seen.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Watch(interval_ms, beat_s, expire_s), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def watched_batch(events: DataFrame, interval_ms: int = INTERVAL_MS, beat_s: int = BEAT_S, expire_s: int = EXPIRE_S, until: Column | None = None) -> DataFrame:
    """OUT rows of all events; ``until`` is where a stream's watermark would have come to (default: beyond all)."""
    t = F.unix_millis("ts")
    w = Window.partitionBy("job_id").orderBy(F.col("t"), F.asc_nulls_first("stage"), F.asc_nulls_first("progress"), F.asc_nulls_first("status"))
    e = events.select("job_id", "stage", "progress", "status", "ts", t.alias("t"))
    e = e.withColumn("end", F.coalesce(F.col("status").isin(*ENDS), F.lit(False)) | F.coalesce(F.col("progress") >= 1, F.lit(False)))
    e = e.withColumn("n", F.row_number().over(w)).withColumn("t0", F.lag("t").over(w)).withColumn("end0", F.coalesce(F.lag("end").over(w), F.lit(True))).withColumn("stage0", F.lag("stage").over(w)).withColumn("t1", F.lead("t").over(w))
    # emitted whatever came before: a first event, a changed stage, an end, or a gap of the interval
    sure = F.col("end0") | F.col("end") | ~F.col("stage").eqNullSafe(F.col("stage0")) | (F.col("t") - F.col("t0") >= interval_ms) | (F.col("t") - F.col("t0") >= expire_s * 1000)
    e = e.withColumn("run", F.sum(sure.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = e.groupBy("job_id", "run").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("e"))
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("bigint").alias("last"))
    step = lambda a, x: F.when(a["last"].isNull() | (x["t"] - a["last"] >= interval_ms), F.struct(F.concat(a["kept"], F.array(x["n"])).alias("kept"), x["t"].alias("last"))).otherwise(a)
    kept = run.select("job_id", F.explode(F.aggregate("e", start, step)["kept"]).alias("n"))
    out = e.join(kept, ["job_id", "n"]).select("job_id", F.when(F.col("end"), "end").otherwise("progress").alias("kind"), "ts", "stage", "progress", "status")
    # silence: up to the next event, the run's expiry, or the end of what is known
    stop = F.least(F.coalesce("t1", F.lit(2**62)), F.col("t") + expire_s * 1000, F.lit(2**62) if until is None else F.unix_millis(until) + 1)
    beats = e.where(~F.col("end")).withColumn("stop", stop - 1).where(F.col("stop") >= F.col("t") + beat_s * 1000)
    beats = beats.select("job_id", F.explode(F.sequence(F.col("t") + beat_s * 1000, F.col("stop"), F.lit(beat_s * 1000).cast("long"))).alias("b"))
    empty = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(beats.select("job_id", F.lit("beat").alias("kind"), F.timestamp_millis("b").alias("ts"), empty("string").alias("stage"), empty("double").alias("progress"), empty("string").alias("status")))
