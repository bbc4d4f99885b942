"""Job-table and event queries: events as jobs (event_type as status) and as progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from ..sources import payloads
from ..streaming import events as stream

# Which state each event type stands for.
STATES = {"view": "pending", "click": "running", "purchase": "done", "error": "error", "signup": "cancelled"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), "user_id", table[F.col("event_type")].alias("status"), F.col("ts").alias("created_at"), "value", "props")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.counts(_jobs(spark, sf_dir))


COUNTS_SQL = f"SELECT {_STATE_SQL} AS status, count(*) AS n FROM events GROUP BY 1"


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.page(_jobs(spark, sf_dir), 3, 20).select("id", "status")


PAGE_SQL = f"SELECT event_id AS id, {_STATE_SQL} AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40"


def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.next_pending(_jobs(spark, sf_dir)).select("id")


CLAIM_SQL = "SELECT event_id AS id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 1"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.latest(_jobs(spark, sf_dir).withColumnRenamed("created_at", "ts"), "user_id")
    return out.select("user_id", "status", "n")


LATEST_SQL = f"SELECT user_id, arg_max({_STATE_SQL}, ts) AS status, count(*) AS n FROM events GROUP BY 1"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.transitions(_jobs(spark, sf_dir), "user_id", ["created_at", "id"])
    return out.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("before").alias("changes"))


TRANSITIONS_SQL = f"""WITH e AS (SELECT user_id, {_STATE_SQL} s, lag({_STATE_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events)
SELECT user_id, count(*) FILTER ((b IS NULL AND s = 'pending') OR (b = 'pending' AND s IN ('running', 'cancelled')) OR (b = 'running' AND s IN ('done', 'error', 'cancelled'))) AS allowed, count(b) AS changes FROM e GROUP BY 1"""


def active_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    kind = F.get_json_object("props", "$.k").alias("kind")
    wanted, stored = j.where("status = 'done'").select("id", "user_id", kind), j.select("user_id", kind, "status")
    return jobs.without_active(wanted, stored, ["user_id", "kind"]).select("id")


ACTIVE_SQL = """SELECT event_id AS id FROM events w WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type IN ('view', 'click') AND s.user_id = w.user_id AND (s.props->>'$.k') = (w.props->>'$.k'))"""


def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    k = F.from_json("props", "struct<k:int>")["k"]
    return j.where(k < 10).groupBy(k.cast("long").alias("k")).agg(F.count("*").alias("n"))


KIND_SQL = "SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events WHERE CAST(props->>'$.k' AS BIGINT) < 10 GROUP BY 1"


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.max("event_id").alias("x"))
    stored = side("view").select("user_id", F.col("x").alias("book"), F.when(F.col("x") % 2 == 0, F.col("x")).alias("chapters"))
    new = side("purchase").select("user_id", F.when(F.col("x") % 3 == 0, F.col("x")).alias("chapters"))
    return jobs.upserted(stored, new, ["user_id"])


UPSERT_SQL = """WITH v AS (SELECT user_id, max(event_id) x FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT user_id, max(event_id) x FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(v.user_id, p.user_id) AS user_id, v.x AS book, coalesce(CASE WHEN p.x % 3 = 0 THEN p.x END, CASE WHEN v.x % 2 = 0 THEN v.x END) AS chapters FROM v FULL JOIN p ON v.user_id = p.user_id"""


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return jobs.misses(c, cache_upsert(spark, sf_dir), ["user_id"], "book")


MISSES_SQL = "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'view')"


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("stage"), (F.col("value") / 1000).alias("progress"), F.col("ts").cast("timestamp").alias("ts"))
    out = stream.throttled_batch(e.where("stage in ('view', 'click')"), 40_000_000)
    return out.groupBy("job_id").agg(F.count("*").alias("n"))


THROTTLE_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) job_id, event_type stage, "value" / 1000 progress, epoch_us(ts) // 1000 t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type, "value") i FROM events WHERE event_type IN ('view', 'click')),
 r AS (SELECT job_id, i, t last, stage ls, true emit FROM e WHERE i = 1
   UNION ALL SELECT e.job_id, e.i, CASE WHEN e.stage <> r.ls OR e.t - r.last >= 40000000 OR e.progress >= 1 THEN e.t ELSE r.last END, CASE WHEN e.stage <> r.ls OR e.t - r.last >= 40000000 OR e.progress >= 1 THEN e.stage ELSE r.ls END,
     e.stage <> r.ls OR e.t - r.last >= 40000000 OR e.progress >= 1 FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1)
SELECT job_id, count(*) AS n FROM r WHERE emit GROUP BY 1"""


def queue_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    d = jobs.queue_decision(F.col("status") == "running", F.col("id") % 11 != 0, (F.col("id") % 4).cast("int"), F.col("id") % 13 != 0, F.when(F.col("status") == "error", "no record").otherwise(""))
    return j.groupBy(d["queued"].alias("queued"), d["reason"].alias("reason")).agg(F.count("*").alias("n"))


DECISIONS_SQL = """WITH d AS (SELECT CASE WHEN event_type = 'click' THEN 'already queued' WHEN event_id % 11 = 0 THEN 'unreadable' WHEN event_id % 4 > 1 THEN 'several files to retag' WHEN event_id % 13 = 0 THEN 'form is not valid' WHEN event_type = 'error' THEN 'no record' ELSE '' END reason FROM events)
SELECT reason = '' AS queued, reason, count(*) AS n FROM d GROUP BY 1, 2"""


def manual_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    body = F.to_json(F.struct(F.col("p_name").alias("title"), F.array("p_brand", F.lit("Unknown")).alias("authors"), F.col("p_size").alias("series_position"), F.lit("unknown").alias("publisher"), F.concat("p_type", F.lit("; "), "p_brand").alias("genres")))
    reply = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("It is "), body, F.lit(" so."))).otherwise("no idea")
    out = p.select("p_partkey", payloads.lenient_reply(reply).alias("r"))
    return out.select("p_partkey", F.col("r.book.title").alias("title"), F.array_join("r.book.authors", "|").alias("authors"), F.col("r.book.series_position").alias("position"), F.col("r.book.publisher").alias("publisher"), F.array_join("r.book.genres", "|").alias("genres"), F.array_join("r.warnings", "; ").alias("warnings"))


REPLY_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS title, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS authors, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS VARCHAR) END AS position,
 CASE WHEN p_partkey % 3 < 2 THEN '' END AS publisher, CASE WHEN p_partkey % 3 < 2 THEN p_type || '|' || p_brand END AS genres, CASE WHEN p_partkey % 3 = 2 THEN 'no JSON' ELSE '' END AS warnings FROM part"""


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers assembled from parts of a type, a podcast and a nameless one among them."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    product = F.struct(
        F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("asin"),
        F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.array(F.struct(F.col("p_brand").alias("name"))).alias("authors"),
        F.concat(F.lit("20"), F.lpad((F.col("p_size") % 24).cast("string"), 2, "0"), F.lit("-05-01")).alias("release_date"),
        F.col("p_size").alias("runtime_length_min"),
        F.when(F.col("p_partkey") % 13 == 0, "Podcast").otherwise("Product").alias("content_type"),
        F.create_map(F.lit("500"), F.col("p_type")).alias("product_images"),
    )
    bodies = p.groupBy(F.col("p_type").alias("q_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(product).alias("p")))).alias("x")).select("q_id", F.lit("us").alias("region"), F.concat(F.lit('{"products":['), F.array_join(F.transform("x", lambda i: i["p"]), ","), F.lit("]}")).alias("body"))
    out = payloads.search_results(bodies)
    return out.select("q_id", F.col("pos").cast("long").alias("pos"), "asin", "title", F.array_join("authors", "|").alias("authors"), "year", F.col("runtime_min").cast("long").alias("runtime_min"), "cover_url")


PAYLOADS_SQL = """SELECT p_type AS q_id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS pos, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin, p_name AS title, p_brand AS authors,
 '20' || lpad(CAST(p_size % 24 AS VARCHAR), 2, '0') AS "year", CAST(p_size AS BIGINT) AS runtime_min, p_type AS cover_url FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0"""


def sidecar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter text files assembled from the events of users: every third out of order."""
    from ..functions.clock import timestamp_text

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.when(F.col("user_id") % 3 == 0, 99_000_000_000 - F.col("event_id") * 1000).otherwise(F.col("event_id") * 1000)
    line = F.concat_ws(" ", timestamp_text(at), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Part "), F.col("event_type"))))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("x")).select("user_id", F.concat(F.lit("# made\n"), F.array_join(F.transform("x", lambda i: i["l"]), "\n")).alias("body"))
    out = g.select("user_id", payloads.sidecar(F.col("body"), F.lit(200_000_000_000).cast("long")).alias("s"))
    return out.select("user_id", F.col("s.reason").alias("reason"), F.size("s.chapters").cast("long").alias("n"), F.try_element_at("s.chapters", F.lit(-1))["end_ms"].alias("last_end"), F.try_element_at("s.chapters", F.lit(1))["title"].alias("first_title"), F.try_element_at("s.chapters", F.lit(1))["end_ms"].alias("first_end"))


SIDECAR_SQL = """WITH g AS (SELECT user_id, count(*) c, arg_min(event_type, event_id) t, min(event_id) a, list(event_id ORDER BY event_id)[2] b FROM events GROUP BY 1), f AS (SELECT *, user_id % 3 = 0 AND c > 1 bad FROM g)
SELECT user_id, CASE WHEN bad THEN 'starts out of order' END AS reason, CASE WHEN NOT bad THEN c END AS n, CASE WHEN NOT bad THEN 200000000000 END AS last_end,
 CASE WHEN NOT bad THEN CASE WHEN a % 2 = 0 THEN 'Part ' || t ELSE 'Chapter 01' END END AS first_title, CASE WHEN NOT bad THEN coalesce(b * 1000, 200000000000) END AS first_end FROM f"""


QUERIES = {
    "job_counts": (counts, COUNTS_SQL),
    "job_page": (page, PAGE_SQL),
    "job_claim_next": (claim, CLAIM_SQL),
    "job_latest_state": (latest, LATEST_SQL),
    "job_transitions": (transitions, TRANSITIONS_SQL),
    "job_active_exists": (active_exists, ACTIVE_SQL),
    "json_kind_filter": (kind_filter, KIND_SQL),
    "cache_upsert": (cache_upsert, UPSERT_SQL),
    "cache_misses": (cache_misses, MISSES_SQL),
    "throttle_fold": (throttle, THROTTLE_SQL),
    "queue_decisions": (queue_decisions, DECISIONS_SQL),
    "manual_reply_parse": (manual_reply, REPLY_SQL),
    "search_payloads": (search_payloads, PAYLOADS_SQL),
    "sidecar_parse": (sidecar_parse, SIDECAR_SQL),
}
