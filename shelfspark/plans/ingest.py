"""Ingestion queries: payloads assembled from driver rows, parsed by declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chapters, genres, jobs
from ..sources import payloads


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def product_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary product answers; every ninth has an id but no title, which is "not found"."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    name = lambda c: F.struct(c.alias("name"))
    ladder = lambda *cs: F.struct(F.array(*[name(c) for c in cs]).alias("ladder"))
    product = F.struct(
        F.lit("B0").alias("asin"),
        F.when(k % 9 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.array(name(F.col("p_brand")), name(F.lit(""))).alias("authors"),
        F.concat(F.lit("20"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("-03-04")).alias("release_date"),
        F.array(F.struct(F.lit("Loose").alias("title"), F.lit("").alias("sequence")), F.struct(F.col("p_type").alias("title"), F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise("").alias("sequence"))).alias("series"),
        F.array(ladder(F.col("p_type"), words[0]), ladder(F.col("p_type"), F.element_at(words, -1))).alias("category_ladders"),
        F.concat(F.lit("<p>"), "p_name", F.lit(" &amp; more</p><p>end</p>")).alias("publisher_summary"),
        F.col("p_size").alias("runtime_length_min"),
        F.create_map(F.when(k % 3 == 0, "1000").otherwise("500"), F.lit("u")).alias("product_images"),
        F.lit("ignored").alias("surplus"),
    )
    b = payloads.product_book(F.to_json(F.struct(product.alias("product"))))
    out = _part(spark, sf_dir).select("p_partkey", b.alias("b"))
    return out.where("b is not null").select("p_partkey", "b.title", F.array_join("b.authors", "|").alias("authors"), "b.year", "b.series_name", "b.series_position", F.array_join("b.genres", "|").alias("genres"), F.array_join("b.sub_genres", "|").alias("sub_genres"), "b.summary", F.col("b.runtime_min").cast("long").alias("runtime_min"), "b.cover_url")


PRODUCT_SQL = """SELECT p_partkey, p_name AS title, p_brand AS authors, '20' || lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') AS "year", CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Loose' END AS series_name,
 CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS series_position, p_type AS genres,
 CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', -1) THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', -1) END AS sub_genres,
 p_name || ' & more' || chr(10) || chr(10) || 'end' AS summary, CAST(p_size AS BIGINT) AS runtime_min, 'u' AS cover_url FROM part WHERE p_partkey % 9 <> 0"""


def secondary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    typed = lambda n, t: F.struct(n.alias("name"), F.lit(t).alias("type"))
    body = F.to_json(
        F.struct(
            F.col("p_name").alias("title"),
            F.concat(F.lit("20"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("-03-04T05:06")).alias("releaseDate"),
            F.array(typed(F.col("p_type"), "genre"), typed(F.col("p_brand"), "tag"), typed(F.lit("x"), "other")).alias("genres"),
            F.when(k % 2 == 0, F.struct(F.col("p_brand").alias("name"), F.lit("1.5").alias("position"))).alias("seriesPrimary"),
            F.when(k % 3 == 0, "fiction").alias("literatureType"),
            F.lit("4.5").alias("rating"),
        )
    )
    b = payloads.secondary_book(body)
    out = _part(spark, sf_dir).select("p_partkey", b.alias("b"))
    kind = genres.record_kind(F.col("b.literature_type"), F.col("b.genre_paths"))
    return out.select("p_partkey", "b.title", "b.year", "b.release_date", F.array_join("b.genres", "|").alias("genres"), F.array_join("b.sub_genres", "|").alias("tags"), "b.series_name", "b.series_position", kind.alias("kind"))


SECONDARY_SQL = """SELECT p_partkey, p_name AS title, '20' || lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') AS "year", '20' || lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || '-03-04' AS release_date, p_type AS genres, p_brand AS tags,
 CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS series_name, CASE WHEN p_partkey % 2 = 0 THEN '1.5' ELSE '' END AS series_position, CASE WHEN p_partkey % 3 = 0 THEN 'fiction' ELSE '' END AS kind FROM part"""


def probe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe answers: durations as texts, every seventh with a wrapped tick count and a cut-off last chapter."""
    k = F.col("p_partkey")
    wrapped = k % 7 == 0
    ms = F.col("p_size").cast("long") * 60_000 + 250
    body = F.to_json(
        F.struct(
            F.struct(F.lit("mov,mp4").alias("format_name"), F.concat((ms / 1000).cast("decimal(12,2)").cast("string")).alias("duration"), F.lit("64900").alias("bit_rate")).alias("format"),
            F.array(
                F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("string").alias("time_base"), F.lit(None).cast("long").alias("duration_ts"), F.lit(None).cast("string").alias("nb_frames")),
                F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("44100").alias("sample_rate"), F.lit("1/44100").alias("time_base"), F.lit(1_024_000).cast("long").alias("duration_ts"), F.when(wrapped, "4195304").otherwise("1000").alias("nb_frames")),
            ).alias("streams"),
            F.array(F.struct(F.lit("0.0").alias("start_time"), F.concat((ms / 1000).cast("decimal(12,2)").cast("string")).alias("end_time"), F.struct(F.col("p_name").alias("title")).alias("tags"))).alias("chapters"),
        )
    )
    out = _part(spark, sf_dir).select("p_partkey", payloads.probe(body).alias("p"))
    own = chapters.own_chapters(F.col("p.chapters"), F.col("p.chapters_truncated"), F.array().cast("array<struct<title:string,start_ms:bigint,end_ms:bigint>>"))
    return out.select("p_partkey", "p.duration_ms", F.col("p.bitrate_kbps").cast("long").alias("kbps"), F.col("p.sample_rate").cast("long").alias("rate"), "p.header_ms", "p.chapters_truncated", F.element_at(own["chapters"], 1)["end_ms"].alias("last_end"), own["source"].alias("source"))


PROBE_SQL = """WITH p AS (SELECT p_partkey, p_partkey % 7 = 0 w, CAST(p_size AS BIGINT) * 60000 + 250 ms, (1024000 + 4294967296) * 1000 // 44100 r FROM part)
SELECT p_partkey, CASE WHEN w THEN r ELSE ms END AS duration_ms, 64 AS kbps, 44100 AS rate, CASE WHEN w THEN ms ELSE 0 END AS header_ms, w AS chapters_truncated, CASE WHEN w THEN r ELSE ms END AS last_end, 'existing' AS source FROM p"""


def chapter_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter answers assembled from lines of orders; accurate where the key is even."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    g = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    lists = F.transform("x", lambda x: F.struct(x["l_partkey"].cast("string").alias("title"), F.lit(0).alias("startOffsetMs"), (x["l_quantity"].cast("long") * 1000).alias("lengthMs")))
    body = F.to_json(F.struct(lists.alias("chapters"), (F.col("l_orderkey") % 2 == 0).alias("isAccurate"), F.lit(5).alias("runtimeLengthMs")))
    out = g.select("l_orderkey", payloads.chapter_list(body).alias("c"))
    return out.select("l_orderkey", F.col("c.accurate").alias("accurate"), F.col("c.runtime_ms").alias("runtime_ms"), F.size("c.chapters").cast("long").alias("n"), F.aggregate("c.chapters", F.lit(0).cast("long"), lambda a, c: a + c["length_ms"]).alias("length_ms"))


CHAPTER_SQL = "SELECT l_orderkey, l_orderkey % 2 = 0 AS accurate, 5 AS runtime_ms, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS length_ms FROM lineitem GROUP BY 1"


def author_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author answers, a list for even suppliers and an object for odd ones; nameless ones go."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    one = F.struct(F.col("s_suppkey").cast("string").alias("asin"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_name")).alias("name"))
    body = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.array(one, one))).otherwise(F.to_json(one))
    out = s.select("s_suppkey", payloads.authors(body).alias("a"))
    return out.select("s_suppkey", F.size("a").cast("long").alias("n"), F.try_element_at("a", F.lit(1))["name"].alias("first_name"))


AUTHORS_SQL = "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS first_name FROM supplier"


def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server's items of an order: numbered ones first, each with one part."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").cast("long").alias("q"))
    item = F.struct((-F.col("l_linenumber")).alias("o"), F.struct(F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("int")).otherwise(F.col("l_linenumber")).alias("index"), F.array(F.struct(F.array(F.struct(F.col("p").cast("string").alias("file"), F.col("q").alias("duration"))).alias("parts"))).alias("media")).alias("i"))
    g = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    out = g.select("l_orderkey", payloads.tree_entries(F.to_json(F.transform("x", lambda x: x["i"]))).alias("e"))
    return out.select("l_orderkey", F.array_join(F.transform("e", lambda e: e["path"]), ",").alias("paths"), F.aggregate("e", F.lit(0).cast("long"), lambda a, e: a + e["duration_ms"]).alias("total"))


TREE_SQL = """WITH i AS (SELECT l_orderkey, l_linenumber n, max(l_partkey) p, CAST(max(l_quantity) AS BIGINT) q FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(CAST(p AS VARCHAR), ',' ORDER BY n % 3 = 0, CASE WHEN n % 3 = 0 THEN -n ELSE n END) AS paths, CAST(sum(q) AS BIGINT) AS total FROM i GROUP BY 1"""


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversions: planned against made lengths, counts of files and chapters, and retag checks."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    planned = F.floor("o_totalprice").cast("long") * 10
    made = planned + (F.col("o_custkey") % 40_000)
    ok = chapters.verified_conversion(planned, made, (F.col("o_orderkey") % 3).cast("int"), (F.col("o_orderkey") % 2).cast("int"))
    why = chapters.retag_problem(planned, planned, (F.col("o_orderkey") % 4).cast("int"), (F.col("o_orderkey") % 2).cast("int"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("t"))
    return o.select("o_orderkey", ok.alias("converted"), F.coalesce(why, F.lit("")).alias("problem"))


VERIFY_SQL = """WITH o AS (SELECT o_orderkey k, CAST(floor(o_totalprice) AS BIGINT) * 10 p, o_custkey % 40000 d FROM orders)
SELECT k AS o_orderkey, d <= greatest(10000, p // 100) AND NOT (k % 3 > 1 AND k % 2 = 0) AS converted, CASE WHEN k % 4 <> k % 2 THEN 'chapter count differs' WHEN k % 5 = 0 THEN 'no title' ELSE '' END AS problem FROM o"""


def unused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("name"), F.col("ts").alias("mtime"), "event_type")
    files = e.groupBy("name").agg(F.max("mtime").alias("mtime"))
    used = e.where("event_type = 'purchase'").select("name")
    return jobs.unused(files, used, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).select("name")


UNUSED_SQL = """WITH e AS (SELECT user_id * 10 + event_id % 10 AS "name", ts, event_type FROM events)
SELECT "name" FROM e GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-25 00:00:00' AND count(*) FILTER (event_type = 'purchase') = 0"""


QUERIES = {
    "product_records": (product_records, PRODUCT_SQL),
    "secondary_records": (secondary_records, SECONDARY_SQL),
    "probe_records": (probe_records, PROBE_SQL),
    "chapter_payloads": (chapter_payloads, CHAPTER_SQL),
    "author_payloads": (author_payloads, AUTHORS_SQL),
    "tree_entries": (tree_entries, TREE_SQL),
    "conversion_verify": (verification, VERIFY_SQL),
    "unused_files": (unused_files, UNUSED_SQL),
}
