"""Queries over regions, lookups, the server's items, chapter texts, shifts, simulated jobs and the job table's changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators import chapters, genres, jobs, match, paths, settings, template
from ..sources import payloads
from ..streaming import events as stream
from .queue import _STATE_SQL, _jobs


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each part: its language, and the region an agent uses for it."""
    p = _part(spark, sf_dir)
    known = F.array(*[F.lit(r) for r in ("us", "UK", "de", "fr", "jp", "it", "es", "in", "xx", "")])
    region = F.element_at(known, (F.col("p_partkey") % 10 + 1).cast("int"))
    return p.select("p_partkey", match.region_language(region).alias("lang"), settings.agent_region(region).alias("region"), text.has_letter(F.when(F.col("p_partkey") % 2 == 0, "12 é").otherwise("12 .")).alias("letter"))


REGIONS_SQL = """SELECT p_partkey, ['english', 'english', 'german', 'french', 'japanese', 'italian', 'spanish', 'english', '', ''][p_partkey % 10 + 1] AS lang, ['us', 'uk', 'de', 'fr', 'jp', 'it', 'es', 'in', 'us', 'us'][p_partkey % 10 + 1] AS region, p_partkey % 2 = 0 AS letter FROM part"""


def server_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    k = F.col("p_partkey").cast("string")
    xml = F.when(F.col("p_partkey") % 5 == 0, "<MediaContainer/>").otherwise(F.concat(F.lit('<MediaContainer librarySectionID="'), (F.col("p_partkey") % 3).cast("string"), F.lit('"><Directory ratingKey="'), k, F.lit('"><Collection tag="'), "p_type", F.lit('"/><Collection tag="Z"/></Directory></MediaContainer>')))
    item = p.select("p_partkey", "p_type", payloads.library_item(xml).alias("i"))
    return item.select("p_partkey", "i.section", "i.key", F.array_join(payloads.with_collection(F.col("i.collections"), F.lower("p_type")), "|").alias("collections"))


ITEMS_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey % 3 AS VARCHAR) END AS section, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS key, CASE WHEN p_partkey % 5 = 0 THEN lower(p_type) ELSE p_type || '|Z' END AS collections FROM part"""


def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    listed = F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), lambda i: F.struct(F.concat(F.lit(" Part "), i.cast("string")).alias("title"), (i * 61_001).cast("long").alias("start_ms"), F.lit(1000).cast("long").alias("length_ms")))
    some = F.when(k % 3 == 0, F.array().cast("array<struct<title:string,start_ms:bigint,length_ms:bigint>>")).otherwise(listed)
    return p.select("p_partkey", chapters.text_file(some).alias("body"))


CHAPTER_TEXTS_SQL = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '00:01:01.001 Part 1' || chr(10) || '## total-duration: 00:01:02.001' || chr(10) ELSE '00:01:01.001 Part 1' || chr(10) || '00:02:02.002 Part 2' || chr(10) || '## total-duration: 00:02:03.002' || chr(10) END AS body FROM part"""


def shift_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    mode = F.when(k % 3 == 0, "fixed").when(k % 3 == 1, "interp").otherwise("")
    return p.select("p_partkey", chapters.shift_text(mode, k - 500, k * 2 - 900, F.lit(1), F.lit(-7).cast("long"), (k % 4).cast("int")).alias("shift"))


SHIFT_TEXTS_SQL = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN printf('fixed %+d ms', p_partkey - 500) WHEN 1 THEN printf('%+d ms at 1 to -7 ms at %s', p_partkey * 2 - 900, CASE WHEN p_partkey % 4 = 0 THEN 'last' ELSE CAST(p_partkey % 4 AS VARCHAR) END) ELSE 'none' END AS shift FROM part"""


def simulated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated conversions of parts: every seventh fails half way."""
    p = _part(spark, sf_dir)
    rows = p.select(F.col("p_partkey").cast("string").alias("job_id"), F.when(F.col("p_partkey") % 7 == 0, "will FAIL").otherwise("fine").alias("path"), F.timestamp_seconds(F.lit(1_000_000)).alias("start"))
    out = stream.simulated(rows, jobs.STAGES["convert"])
    return out.groupBy("job_id").agg(F.count("*").alias("n"), F.countDistinct("stage").alias("stages"), F.max_by("status", "ts").alias("status"), F.max_by("stage", "ts").alias("last_stage"), F.unix_millis(F.max("ts")).alias("ends"))


SIMULATED_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS job_id, CAST(CASE WHEN p_partkey % 7 = 0 THEN 40 ELSE 80 END AS BIGINT) AS n, CAST(CASE WHEN p_partkey % 7 = 0 THEN 4 ELSE 8 END AS BIGINT) AS stages, CASE WHEN p_partkey % 7 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN p_partkey % 7 = 0 THEN 'chapters' ELSE 'cleanup' END AS last_stage,
 CAST(1000000000 + 250 * CASE WHEN p_partkey % 7 = 0 THEN 40 ELSE 80 END AS BIGINT) AS ends FROM part"""


def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after a request each for some users, cancelled and retried jobs, and a cleared history."""
    j = _jobs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "status", F.col("created_at").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    now = F.timestamp_seconds(F.lit(2_000_000_000))
    every = j.select("id")
    added = jobs.inserted(j, j.select((F.col("id").cast("long") * 2).cast("string").alias("id")), now)
    stopped = jobs.cancelled(added, every.where("cast(id as bigint) % 3 = 0"), now)
    again = jobs.retries(stopped, every.where("cast(id as bigint) % 5 = 0"), now)
    kept = jobs.history(stopped.unionByName(again))
    return kept.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("created_at") == now).alias("new"))


JOB_CHANGES_SQL = f"""WITH j AS (SELECT event_id id, {_STATE_SQL} s, 0 n FROM events), a AS (SELECT * FROM j UNION ALL SELECT id * 2, 'pending', 1 FROM j WHERE id * 2 NOT IN (SELECT id FROM j)),
 c AS (SELECT id, CASE WHEN s = 'pending' AND id % 3 = 0 AND id IN (SELECT id FROM j) THEN 'cancelled' ELSE s END s, n FROM a), r AS (SELECT * FROM c UNION ALL SELECT id, 'pending', 1 FROM c WHERE s IN ('error', 'cancelled') AND id % 5 = 0 AND id IN (SELECT id FROM j))
SELECT s AS status, count(*) AS n, count(*) FILTER (n = 1) AS "new" FROM r WHERE s IN ('pending', 'running') GROUP BY 1"""


def sort_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each part whose file a sort would move and that no job works on."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    old = F.concat(F.lit("in/"), k.cast("string"), F.lit(".m4b"))
    new = F.concat(template.rendered("{author}/{title}", {"author": F.col("p_brand"), "title": F.col("p_name")}), F.lit(".m4b"))
    rows = p.select(old.alias("path"), F.when(k % 4 == 0, "same").when(k % 4 == 1, "skip").otherwise("move").alias("state"), new.alias("new"))
    active = p.where("p_partkey % 6 = 2").select(old.alias("path"))
    return jobs.sort_jobs(rows, active)


SORT_QUEUE_SQL = """SELECT 'in/' || p_partkey || '.m4b' AS "path", p_brand || '/' || p_name || '.m4b' AS target, 'sort' AS kind FROM part WHERE p_partkey % 4 > 1 AND p_partkey % 6 <> 2"""


def selected_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's file beside its chapter text."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey").cast("string")
    files = p.select("p_partkey", F.concat(F.lit("a/"), k, F.lit(".x.mp3")).alias("path"), (F.col("p_size") * 1000).cast("long").alias("duration_ms"))
    texts = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("a/"), k, F.lit(".x.chapters.txt")).alias("text_path"), F.concat(F.lit("00:00:00.000 One\n00:00:00.500 Two\n"), F.when(F.col("p_partkey") % 2 == 0, "00:00:00.100 Back\n").otherwise("")).alias("body"))
    both = files.join(texts, paths.sidecar_path(F.col("path")) == F.col("text_path"), "left").select("p_partkey", payloads.sidecar(F.col("body"), F.col("duration_ms")).alias("s"), "body", "duration_ms")
    return both.select("p_partkey", F.when(F.col("body").isNotNull(), F.col("s.reason")).alias("reason"), F.when(F.col("body").isNotNull(), F.try_element_at("s.chapters", F.lit(-1))["end_ms"]).alias("last_end"), clock.runtime_minutes(F.col("duration_ms")).alias("minutes"))


SIDECARS_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'starts out of order' END AS reason, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN CAST(p_size * 1000 AS BIGINT) END AS last_end, CAST((p_size * 1000 + 30000) // 60000 AS BIGINT) AS minutes FROM part"""


BOOK_TEMPLATE = "{author}/{series_name}/{Book series_position:00 - }{title} ({year}) [{asin}]"


def preview_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a template makes of each stored book: parts as records with lists of authors, some empty."""
    k = F.col("p_partkey")
    hole = lambda n, c: F.when(k % n == 0, "").otherwise(c)
    given = {"title": F.col("p_name"), "series_name": hole(3, F.col("p_type")), "series_position": hole(2, F.col("p_size").cast("string")), "year": hole(5, F.lit("2020")), "asin": hole(7, F.lit("B0"))}
    record = F.struct(*[given.get(n, F.lit("")).alias(n) for n in template.VARIABLES if n not in ("author", "narrator")], F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.lit("Other"))).alias("authors"), F.array().cast("array<string>").alias("narrators"))
    books = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", record.alias("book"))
    return books.select("p_partkey", F.concat(template.rendered(BOOK_TEMPLATE, template.book_variables(F.col("book"))), F.lit(".m4b")).alias("path"))


PREVIEW_BOOKS_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || '/' END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || '/' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Book ' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || ' - ' END || p_name
 || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' (2020)' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' [B0]' END || '.m4b' AS path FROM part"""


def category_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category of the vocabulary with its kind and how many stored books carry it, unused ones too."""
    names = F.array(*[F.lit(n) for n, _ in genres.CATEGORIES])
    carried = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.try_element_at(names, (F.col("p_size") % F.lit(len(genres.CATEGORIES) + 5) + 1).cast("int")).alias("name"))
    used = carried.where("name is not null").groupBy("name").agg(F.count("*").alias("books"))
    listed = spark.range(1).select(F.explode(names).alias("name")).withColumn("kind", genres.category_kind(F.col("name")))
    return listed.join(used, "name", "left").select("name", "kind", F.coalesce("books", F.lit(0)).alias("books"))


_CATEGORY_ROWS = ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "''"), k) for i, (n, k) in enumerate(genres.CATEGORIES))
USAGE_SQL = f"""WITH c(i, "name", kind) AS (VALUES {_CATEGORY_ROWS}), u AS (SELECT p_size % {len(genres.CATEGORIES) + 5} i, count(*) n FROM part GROUP BY 1)
SELECT "name", kind, coalesce(n, 0) AS books FROM c LEFT JOIN u USING (i)"""


def source_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers' settings share one catalog client: provider by segment, address by nation, region by key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    regions = F.array(*[F.lit(r) for r in ("us", "uk", "de")])
    rows = c.select(F.lower("c_mktsegment").alias("metadata_provider"), F.concat(F.lit("https://n"), F.col("c_nationkey").cast("string"), F.repeat(F.lit("/"), (F.col("c_custkey") % 3).cast("int"))).alias("audnexus_url"), F.element_at(regions, (F.col("c_custkey") % 3 + 1).cast("int")).alias("region_default"))
    return settings.source_key(rows).groupBy("client").agg(F.count("*").alias("users"))


CLIENTS_SQL = "SELECT lower(c_mktsegment) || '|https://n' || c_nationkey || '|' || ['us', 'uk', 'de'][c_custkey % 3 + 1] AS client, count(*) AS users FROM customer GROUP BY 1"


QUERIES = {
    "template_preview": (preview_books, PREVIEW_BOOKS_SQL),
    "source_clients": (source_clients, CLIENTS_SQL),
    "region_lookup": (regions, REGIONS_SQL),
    "category_vocabulary": (category_usage, USAGE_SQL),
    "server_items": (server_items, ITEMS_SQL),
    "chapter_texts": (chapter_texts, CHAPTER_TEXTS_SQL),
    "shift_texts": (shift_texts, SHIFT_TEXTS_SQL),
    "simulated_runs": (simulated_runs, SIMULATED_SQL),
    "job_changes": (job_changes, JOB_CHANGES_SQL),
    "sort_queue": (sort_queue, SORT_QUEUE_SQL),
    "probe_with_sidecar": (selected_sidecars, SIDECARS_SQL),
}
