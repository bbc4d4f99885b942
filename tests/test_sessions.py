from __future__ import annotations

import datetime
import random

import pytest

from shelfspark.streaming import sessions

SCHEMA = "job_id string, stage string, progress double, status string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def at(ms):
    return START + datetime.timedelta(milliseconds=ms)


def brute(rows, interval=500, beat=25_000, expire=3_600_000, until=10**15):
    """(job, kind, ms) of the rule, event by event."""
    out = []
    for job in {r[0] for r in rows}:
        heard = sent = stage = None
        mine = sorted(((r[4], r[1] or "", r[2] if r[2] is not None else -1, r[3] or "") for r in rows if r[0] == job))
        mine = [(round((t - START).total_seconds() * 1000), s, p, x) for t, s, p, x in mine]
        for t, s, p, status in mine:
            if heard is not None:
                out += [(job, "beat", b) for b in range(heard + beat, min(t, heard + expire, until + 1), beat)]
                if t >= heard + expire:
                    sent = None
            end = status in sessions.ENDS or p >= 1
            if sent is None or s != stage or t - sent >= interval or end:
                out.append((job, "end" if end else "progress", t))
                sent, stage = t, s
            heard = t
            if end:
                heard = sent = stage = None
        if heard is not None:
            out += [(job, "beat", b) for b in range(heard + beat, min(heard + expire, until + 1), beat)]
    return sorted(out)


def got(rows):
    return sorted((r["job_id"], r["kind"], round((r["ts"] - START).total_seconds() * 1000)) for r in rows)


def made(seed, jobs=6, n=40):
    r = random.Random(seed)
    rows = []
    for j in range(jobs):
        t = r.randrange(2000)
        for i in range(n):
            t += r.choice([0, 50, 120, 300, 499, 500, 700, 26_000, 60_000, 50_000, 25_000, 4_000_000 if r.random() < 0.1 else 100])
            end = i == n - 1 and j % 3 != 0 or r.random() < 0.04
            rows.append((f"j{j}", r.choice(["probe", "merge", "merge"]), 1.0 if end and r.random() < 0.5 else round(r.random() * 0.9, 3), r.choice(sessions.ENDS) if end else r.choice(["running", None]), at(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(sessions.watched_batch(df).collect()) == brute(rows)
    assert got(sessions.watched_batch(df, 300, 10, 90).collect()) == brute(rows, 300, 10_000, 90_000)
    assert sessions.watched_batch(df.where("false")).count() == 0



def test_stream_equals_batch_and_its_state_goes(spark, tmp_path):
    """Three batches of files; silent jobs beat as the watermark passes, and no state is left at the end."""
    rows = made(7, jobs=4, n=25)
    last = max(r[4] for r in rows)
    far = [("end", "probe", 1.0, "done", last + datetime.timedelta(days=1)), ("end", "probe", 1.0, "done", last + datetime.timedelta(days=2))]
    by_time = sorted(rows, key=lambda r: r[4])
    thirds = [by_time[:35], by_time[35:70], by_time[70:], far[:1], far[1:]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in thirds:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            stream = sessions.watched_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            query = stream.outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(200) and query.exception() is None
        out = got(spark.read.parquet(str(tmp_path / "out")).collect())
        assert [x for x in out if x[0] != "end"] == brute(rows)
        assert sum(x[0] == "end" for x in out) == 2
        # no job is left in the state: all have ended or expired
        left = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "run").load()
        assert left.count() == 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
