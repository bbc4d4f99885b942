"""Chapter queries: events per user as chapters, lines per order as files, conversations as title lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chapters, intervals, jobs, paths

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_SQL = ", ".join(LINE_ORDER)


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *LINE_ORDER, (F.col("l_quantity").cast("long") * 1000).alias("duration_ms"))
    out = chapters.boundaries(i, "l_orderkey", LINE_ORDER)
    return out.groupBy("l_orderkey").agg(F.max("start_ms").alias("last_start"), F.sum("start_ms").alias("starts"))


BOUNDARIES_SQL = f"""WITH b AS (SELECT l_orderkey, coalesce(sum(CAST(l_quantity AS BIGINT) * 1000) OVER (PARTITION BY l_orderkey ORDER BY {_LINE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s FROM lineitem)
SELECT l_orderkey, CAST(max(s) AS BIGINT) AS last_start, CAST(sum(s) AS BIGINT) AS starts FROM b GROUP BY 1"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters per user: starts in ms since the first event, own length 100."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return e.withColumn("start_ms", F.col("t") - F.min("t").over(Window.partitionBy("user_id"))).withColumn("length_ms", F.lit(100).cast("long"))


_EVENTS_SQL = "e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) s FROM events)"


def shift_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chapters.shifted(_events(spark, sf_dir), "user_id", ["start_ms", "event_id"], F.lit(-90_000_000).cast("long"), F.lit(2_000_000_000).cast("long"))
    return out.select("user_id", "event_id", "start_ms", "length_ms")


SHIFT_SQL = f"""WITH {_EVENTS_SQL}, m AS (SELECT user_id, event_id, s, max(least(greatest(0, s - 90000000), 2000000000)) OVER (PARTITION BY user_id ORDER BY s, event_id) n FROM e)
SELECT user_id, event_id, n AS start_ms, greatest(0, coalesce(lead(n) OVER (PARTITION BY user_id ORDER BY n, event_id), 2000000000) - n) AS length_ms FROM m"""


def shift_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapters.anchored_shift(_events(spark, sf_dir), "user_id", ["start_ms", "event_id"], F.lit(2), F.lit(0).cast("long"), F.lit(0), F.lit(5_000_001).cast("long"))
    out = chapters.shifted(rows, "user_id", ["start_ms", "event_id"], F.col("shift_ms"), F.lit(0).cast("long"))
    return out.select("user_id", "event_id", "start_ms", "length_ms")


INTERP_SQL = f"""WITH {_EVENTS_SQL}, r AS (SELECT *, row_number() OVER w i, count(*) OVER (PARTITION BY user_id) n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
 a AS (SELECT *, max(CASE WHEN i = least(2, n) THEN s END) OVER (PARTITION BY user_id) t0, max(CASE WHEN i = n THEN s END) OVER (PARTITION BY user_id) t1 FROM r),
 m AS (SELECT user_id, event_id, s, max(greatest(0, s + CASE WHEN t0 = t1 OR s <= t0 THEN 0 WHEN s >= t1 THEN 5000001 ELSE 5000001 * (s - t0) // (t1 - t0) END)) OVER (PARTITION BY user_id ORDER BY s, event_id) x FROM a)
SELECT user_id, event_id, x AS start_ms, greatest(0, coalesce(lead(x) OVER (PARTITION BY user_id ORDER BY x, event_id) - x, 100)) AS length_ms FROM m"""


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("start_ms", F.when(F.col("user_id") % 3 == 0, -F.col("start_ms")).otherwise(F.col("start_ms")))
    out = chapters.validity(rows, "user_id", ["t", "event_id"], F.lit(2_500_000_000).cast("long"))
    return out.select("user_id", "event_id", "valid", "end_ms")


VALIDITY_SQL = """WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) t, ((epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id)) * CASE WHEN user_id % 3 = 0 THEN -1 ELSE 1 END s FROM events),
 o AS (SELECT *, s >= coalesce(lag(s) OVER w, 0) AND s < 2500000000 ok, coalesce(lead(s) OVER w, 2500000000) end_ms FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, bool_and(ok) OVER (PARTITION BY user_id) AS valid, end_ms FROM o"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: its lines as files and a provider's list of the same or one more chapters."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(*LINE_ORDER)
    probed = F.array().cast("array<struct<title:string,start_ms:bigint,end_ms:bigint>>")
    g = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    length = lambda x: x["l_quantity"].cast("long") * 60_000
    files = F.transform("x", lambda x, k: F.struct(F.concat(F.lit("d/0"), (k + 1).cast("string"), F.lit(" - Line "), x["l_partkey"].cast("string"), F.lit(".mp3")).alias("path"), length(x).alias("duration_ms"), probed.alias("chapters"), F.lit(False).alias("truncated"), probed.alias("sidecar")))
    intro = F.struct(F.lit("Intro").alias("title"), F.lit(0).cast("long").alias("start_ms"), F.lit(20_000).cast("long").alias("length_ms"))
    given = F.transform("x", lambda x, k: F.struct(F.concat(F.lit("P"), (k + 1).cast("string")).alias("title"), F.lit(0).cast("long").alias("start_ms"), length(x).alias("length_ms")))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + length(x))
    key = F.col("l_orderkey")
    return g.select("l_orderkey", files.alias("files"), F.when(key % 3 == 0, F.concat(F.array(intro), given)).when(key % 3 == 1, given).otherwise(F.slice(given, 1, 0)).alias("provider"), total.alias("actual"), F.when(key % 4 == 0, total * 2).otherwise(total + 9_000).alias("runtime"), F.when(key % 5 == 0, "titles-files").otherwise("auto").alias("mode"))


def choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    out = chapters.chosen(_files(spark, sf_dir).withColumns({"title": F.lit("Book"), "accurate": F.lit(True), "intro": zero, "outro": zero}), "c")
    return out.select("l_orderkey", F.col("c.source").alias("source"), F.size("c.chapters").cast("long").alias("n"), F.try_element_at("c.chapters", F.lit(1))["title"].alias("first_title"), F.array_join("c.warnings", "; ").alias("warnings"))


CHOOSE_SQL = f"""WITH o AS (SELECT l_orderkey k, count(*) c, sum(CAST(l_quantity AS BIGINT) * 60000) t, arg_min(l_partkey, ({_LINE_SQL})) p1, arg_min(CAST(l_quantity AS BIGINT) * 60000, ({_LINE_SQL})) q1, count(DISTINCT l_partkey) dp FROM lineitem GROUP BY 1),
 x AS (SELECT *, CASE k % 3 WHEN 0 THEN c + 1 WHEN 1 THEN c ELSE 0 END np, k % 4 <> 0 AND 9000 <= greatest(10000, t // 100) OR t <= greatest(10000, t // 100) fits FROM o),
 y AS (SELECT *, CASE WHEN k % 5 = 0 AND c > 1 AND np > 0 THEN 'titles-files' WHEN np > 0 AND fits THEN 'provider' WHEN c > 1 THEN 'files' ELSE 'single' END src FROM x)
SELECT k AS l_orderkey, src AS source, CAST(CASE src WHEN 'provider' THEN np WHEN 'single' THEN 1 ELSE c END AS BIGINT) AS n,
 CASE src WHEN 'titles-files' THEN 'P1' WHEN 'provider' THEN CASE WHEN k % 3 = 0 THEN 'Intro' ELSE 'P1' END WHEN 'files' THEN CASE WHEN dp = c THEN 'Line ' || p1 ELSE 'Chapter 01' END ELSE 'Book' END AS first_title,
 CASE WHEN src = 'titles-files' THEN CASE WHEN k % 3 = 0 THEN 'short provider chapters skipped' ELSE '' END
  ELSE concat_ws('; ', CASE WHEN k % 5 = 0 THEN CASE WHEN np > 0 THEN 'titles do not line up' ELSE 'no titles available' END END, CASE WHEN np > 0 AND NOT fits THEN 'provider runtime does not fit' END) END AS warnings FROM y"""


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n"))
    item = F.struct("turn", "n")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    lists = F.transform("x", lambda x: F.struct(x["turn"].cast("string").alias("title"), F.lit(0).cast("long").alias("start_ms"), (x["n"] * 300).cast("long").alias("length_ms")))
    want = F.size("x") - (F.col("conv_id") % 4).cast("int")
    zero = F.lit(0).cast("long")
    return g.select("conv_id", F.array_join(chapters.aligned_titles(lists, want, zero, zero), ",").alias("titles"))


ALIGN_SQL = """WITH t AS (SELECT conv_id, turn, max(length("text")) * 300 n FROM conversations GROUP BY 1, 2),
 g AS (SELECT conv_id, list(turn ORDER BY turn) ts, list(n BETWEEN 1 AND 40000 ORDER BY turn) s, count(*) c, conv_id % 4 ex FROM t GROUP BY 1),
 f AS (SELECT *, CASE WHEN c - ex <= 0 OR ex > 2 THEN NULL WHEN ex = 0 THEN 0 WHEN ex = 1 THEN CASE WHEN s[1] THEN 1 WHEN s[-1] THEN 0 END
   ELSE CASE WHEN s[1] AND s[2] THEN 2 WHEN s[1] AND s[-1] THEN 1 WHEN NOT s[1] AND s[-1] AND s[-2] THEN 0 END END fr FROM g)
SELECT conv_id, CASE WHEN fr IS NOT NULL THEN array_to_string(ts[fr + 1 : fr + c - ex], ',') END AS titles FROM f"""


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.when(F.col("l_partkey") % 7 == 0, 0).otherwise(F.col("l_quantity").cast("long")).alias("duration_ms"))
    return paths.guarded_sum(i, "l_orderkey")


GUARDED_SQL = "SELECT l_orderkey, CAST(CASE WHEN count(*) FILTER (l_partkey % 7 = 0 OR CAST(l_quantity AS BIGINT) <= 0) > 0 THEN 0 ELSE sum(CAST(l_quantity AS BIGINT)) END AS BIGINT) AS total FROM lineitem GROUP BY 1"


def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        F.struct(*LINE_ORDER).alias("pos"),
        (F.col("l_quantity").cast("long") * 1000).alias("duration_ms"),
        F.when(F.col("l_partkey") % 5 == 0, "mp3").otherwise("aac").alias("codec"),
        F.lit("mov,mp4").alias("container"),
        (F.col("l_partkey") % 300).cast("int").alias("bitrate_kbps"),
        F.when(F.col("l_suppkey") % 2 == 0, 44100).otherwise(22050).alias("sample_rate"),
    )
    out = jobs.merge_plan(i, "l_orderkey")
    return out.select("l_orderkey", "total_ms", "stream_copy", F.col("bitrate_kbps").cast("long").alias("kbps"), jobs.plan_text(F.col("stream_copy"), F.col("bitrate_kbps"), F.col("sample_rate")).alias("plan"))


MERGE_SQL = f"""WITH g AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) total_ms, bool_and(l_partkey % 5 <> 0) stream_copy, arg_min(l_partkey % 300, ({_LINE_SQL})) k, arg_min(CASE WHEN l_suppkey % 2 = 0 THEN 44100 ELSE 22050 END, ({_LINE_SQL})) r FROM lineitem GROUP BY 1),
 s AS (SELECT *, CASE WHEN k <= 0 THEN 128 WHEN k <= 80 THEN 64 WHEN k <= 112 THEN 96 WHEN k <= 160 THEN 128 WHEN k <= 224 THEN 192 WHEN k <= 288 THEN 256 ELSE 320 END kb FROM g)
SELECT l_orderkey, total_ms, stream_copy, CAST(kb AS BIGINT) AS kbps, CASE WHEN stream_copy THEN 'stream copy' ELSE printf('transcode to AAC %dk at %d Hz', kb, r) END AS plan FROM s"""


def span_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's provider span: lines of a supplier in two orders, end to end by quantity; the span that a chapter overlaps most."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("book"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 100).cast("long").alias("ms"))

    def laid(left: bool, *order: str) -> Column:
        w = Window.partitionBy("book").orderBy(*order)
        upto = F.sum("ms").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return F.struct(F.lit(left).alias("left"), F.row_number().over(w).alias("id"), (upto - F.col("ms")).alias("start"), upto.alias("end"))

    # a line's places in both orders are found side by side, so lines are dealt by book once
    both = items.select("book", laid(True, "l_orderkey", "l_linenumber", "l_partkey", "ms").alias("chapter"), laid(False, "l_partkey", "l_orderkey", "l_linenumber", "ms").alias("span"))
    return intervals.nearest_laid(both.select("book", F.inline(F.array("chapter", "span"))), ["book"], "chapter", "span")


SPAN_SQL = """WITH i AS (SELECT l_suppkey book, l_orderkey o, l_linenumber n, l_partkey p, CAST(l_quantity * 100 AS BIGINT) ms FROM lineitem),
 c AS (SELECT book, row_number() OVER w chapter, sum(ms) OVER w - ms a, sum(ms) OVER w b FROM i WINDOW w AS (PARTITION BY book ORDER BY o, n, p, ms ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT book, row_number() OVER w span, sum(ms) OVER w - ms a, sum(ms) OVER w b FROM i WINDOW w AS (PARTITION BY book ORDER BY p, o, n, ms ROWS UNBOUNDED PRECEDING)),
 j AS (SELECT c.book, chapter, span, s.a, least(c.b, s.b) - greatest(c.a, s.a) overlap FROM c JOIN s ON c.book = s.book AND c.a < s.b AND s.a < c.b)
SELECT book, CAST(chapter AS INTEGER) AS chapter, CAST(span AS INTEGER) AS span, CAST(overlap AS BIGINT) AS overlap FROM j QUALIFY row_number() OVER (PARTITION BY book, chapter ORDER BY overlap DESC, a, span) = 1"""


QUERIES = {
    "chapter_boundaries": (boundaries, BOUNDARIES_SQL),
    "chapter_span_match": (span_match, SPAN_SQL),
    "chapter_shift_fixed": (shift_fixed, SHIFT_SQL),
    "chapter_shift_interp": (shift_interpolated, INTERP_SQL),
    "chapter_validity": (validity, VALIDITY_SQL),
    "chapter_choose": (choose, CHOOSE_SQL),
    "align_titles": (align, ALIGN_SQL),
    "guarded_sum": (guarded, GUARDED_SQL),
    "merge_plan": (merge_plan, MERGE_SQL),
}
