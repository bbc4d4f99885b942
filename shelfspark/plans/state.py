"""Queries of stored and streamed state over ``events``: bucketed upserts, runs watched for progress and silence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pages, store, tables
from ..sources.keyed import KeyedTable
from ..streaming import sessions
from .queue import STATES

HOUR_MS, DAY_S = 3_600_000, 86_400


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, last purchase and last signup, written in three batches of events; the second runs twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    rows = e.select("user_id", "event_id", "event_type", last("purchase").alias("purchase"), last("signup").alias("signup"))
    table = KeyedTable(spark, tables.scratch(spark, "users"), "user_id long, event_id long, event_type string, purchase double, signup double", ("user_id",), buckets=16)
    for batch in (0, 1, 1, 2):
        table.upsert(rows.where(F.floor(F.col("event_id") / 3) % 3 == batch), ["event_id"])
    return table.read()


UPSERTS_SQL = """WITH e AS (SELECT *, (event_id // 3) % 3 b, CASE WHEN event_type = 'purchase' THEN "value" END p, CASE WHEN event_type = 'signup' THEN "value" END s FROM events)
SELECT user_id, arg_max(event_id, (b, event_id)) AS event_id, arg_max(event_type, (b, event_id)) AS event_type, arg_max(p, (b, event_id)) FILTER (p IS NOT NULL) AS purchase, arg_max(s, (b, event_id)) FILTER (s IS NOT NULL) AS signup FROM e GROUP BY 1"""


def inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind of each user, inserted in two batches; later ones change nothing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value")
    table = KeyedTable(spark, tables.scratch(spark, "firsts"), "user_id long, event_type string, event_id long, value double", ("user_id", "event_type"), buckets=16)
    for half in (1, 0, 1):
        table.insert(e.where(F.col("event_id") % 2 == half), ["event_id"])
    return table.read()


INSERTS_SQL = """SELECT user_id, event_type, arg_min(event_id, ((event_id + 1) % 2, event_id)) AS event_id, arg_min("value", ((event_id + 1) % 2, event_id)) AS "value" FROM events GROUP BY 1, 2"""


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of users: progress at most every six hours, a beat a day of silence, expiry after five days."""
    table = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("stage"), (F.col("value") / 1000).alias("progress"), table[F.col("event_type")].alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    out = sessions.watched_batch(e, 6 * HOUR_MS, DAY_S, 5 * DAY_S)
    return out.groupBy("job_id", "kind").agg(F.count("*").alias("n"), F.sum(F.unix_millis("ts") % 1_000_003).alias("told"))


WATCHED_SQL = f"""WITH RECURSIVE e0 AS (SELECT CAST(user_id AS VARCHAR) job_id, event_type stage, "value" / 1000 p, epoch_us(ts) // 1000 t, event_type IN ('purchase', 'error', 'signup') OR "value" / 1000 >= 1 fin FROM events),
 e AS MATERIALIZED (SELECT *, row_number() OVER w i, lead(t) OVER w t1 FROM e0 WINDOW w AS (PARTITION BY job_id ORDER BY t, stage, p)),
 r AS (SELECT job_id, i, t, fin, t sent, stage, true emit FROM e WHERE i = 1
   UNION ALL SELECT job_id, i, t, fin, CASE WHEN emit THEN t ELSE sent END, CASE WHEN emit THEN stage ELSE stage0 END, emit FROM (
     SELECT e.job_id, e.i, e.t, e.fin, r.sent, e.stage, r.stage stage0, r.fin OR e.t - r.t >= {5 * DAY_S * 1000} OR e.stage <> r.stage OR e.t - r.sent >= {6 * HOUR_MS} OR e.fin emit FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1)),
 o AS (SELECT job_id, CASE WHEN fin THEN 'end' ELSE 'progress' END kind, t FROM r WHERE emit
   UNION ALL SELECT job_id, 'beat', unnest(generate_series(t + {DAY_S * 1000}, least(coalesce(t1, t + {5 * DAY_S * 1000}), t + {5 * DAY_S * 1000}) - 1, {DAY_S * 1000})) FROM e WHERE NOT fin)
SELECT job_id, kind, count(*) AS n, CAST(sum(t % 1000003) AS BIGINT) AS told FROM o GROUP BY 1, 2"""


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 jobs in the middle of all, by number, and the 50 after its last job, by key."""
    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("status"))
    laid = pages.write_pages(jobs, tables.scratch(spark, "jobs"), ("created_at", "id"), 2000)
    page = laid.page(laid.count() // 100 + 1, 50)
    last = page.orderBy("created_at", "id").first()
    return page.unionByName(laid.after((last["created_at"], last["id"]), 50)) if last else page


DEEP_SQL = """WITH o AS (SELECT event_id id, CAST(ts AS TIMESTAMP) created_at, event_type status, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 rn, count(*) OVER () n FROM events)
SELECT id, created_at, status FROM o WHERE rn >= (n // 100) * 50 AND rn < (n // 100) * 50 + 100"""


def store_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of all events: added twice, then moved by a rule on their ids, the last move twice; one kind and path a job of each user and type is active."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    wanted = e.select(k.alias("id"), F.col("event_type").alias("kind"), F.concat(F.col("user_id").cast("string"), F.lit("/"), (k % 50).cast("string")).alias("path"), F.lit("{}").alias("options"), F.col("ts").cast("timestamp").alias("created_at"))
    kept = store.Store(spark, tables.scratch(spark, "store"), 16)
    kept.add(wanted)
    kept.add(wanted)
    moved = lambda status: e.select(k.alias("id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.when(status == "error", "failed").alias("error")).where("status is not null")
    kept.move(moved(F.when(k % 4 < 2, "running").when(k % 4 == 2, "cancelled").otherwise("done")))
    for _ in range(2):
        kept.move(moved(F.when(k % 4 == 0, "done").when(k % 4 == 1, "error").otherwise("running")))
    return kept.jobs.read().groupBy("kind", "status").agg(F.count("*").alias("n"), F.count("started_at").alias("started"), F.count("finished_at").alias("ended"), F.count("error").alias("errors"), F.sum("id").alias("ids"))


STORE_SQL = """WITH j AS (SELECT event_id k, event_type kind FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id, event_id % 50 ORDER BY ts, event_id) = 1),
 s AS (SELECT kind, k, CASE k % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'error' WHEN 2 THEN 'cancelled' ELSE 'running' END status FROM j)
SELECT kind, status, count(*) AS n, count(*) FILTER (status <> 'cancelled') AS started, count(*) FILTER (status <> 'running') AS ended, count(*) FILTER (status = 'error') AS errors, CAST(sum(k) AS BIGINT) AS ids FROM s GROUP BY 1, 2"""


QUERIES = {"keyed_upserts": (upserts, UPSERTS_SQL), "keyed_inserts": (inserts, INSERTS_SQL), "job_watch": (watched, WATCHED_SQL), "job_page_deep": (deep_page, DEEP_SQL), "store_jobs": (store_jobs, STORE_SQL)}
