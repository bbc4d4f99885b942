"""Queries over settings and request values, and the rows that composed requests answer with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators import chapters, requests, settings
from ..streaming import events as stream


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings store for each supplier: which keys it has, and how wrong they are, follows from its number."""
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    has = {
        "output_dir": (k >= 0, F.lit("/out")),
        "input_dir": (k % 2 == 0, F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("/in/"), k.cast("string")))),
        "worker_concurrency": (k % 3 == 0, F.when(k % 21 == 0, "many").otherwise(k.cast("string"))),
        "region_default": (k % 4 == 0, F.when(k % 8 == 0, "xx").otherwise("de")),
        "completed_subdir": (k % 5 == 0, F.when(k % 25 == 0, "../x").when(k % 10 == 0, "/abs").when(k % 15 == 0, "a\\b").otherwise(F.concat(F.lit("done//"), k.cast("string")))),
        "write_chapters_txt": (k % 6 == 0, F.when(k % 12 == 0, "false").otherwise("true")),
        "path_template": (k % 7 == 0, F.when(k % 14 == 0, "{title}/{nope}").when(k % 35 == 0, "plain").otherwise("{author}/{title}")),
        "bitrate_kbps": (k % 9 == 0, F.when(k % 18 == 0, "100").otherwise("128")),
    }
    entries = F.array(*[F.when(cond, F.struct(F.lit(key).alias("key"), v.alias("value"))) for key, (cond, v) in has.items()])
    return s.select(k.alias("s_suppkey"), F.inline(F.array_compact(entries)))


def settings_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settings.typed(_stored(spark, sf_dir), ("s_suppkey",))
    return out.select(
        "s_suppkey", "input_dir", F.col("worker_concurrency").cast("long").alias("workers"), "region_default", "path_template", "write_chapters_txt", "retag_move_default",
        settings.completed_path(F.lit("/completed"), F.col("completed_subdir")).alias("completed"), F.array_join(settings.problems(), "; ").alias("problems"),
    )


SETTINGS_SQL = r"""WITH s AS (SELECT s_suppkey, s_suppkey k FROM supplier), v AS (SELECT *,
   CASE WHEN k % 10 = 0 THEN ' ' WHEN k % 2 = 0 THEN '/in/' || k ELSE '/input' END input_dir, CASE WHEN k % 3 = 0 AND k % 21 <> 0 THEN k ELSE 1 END workers, CASE WHEN k % 8 = 0 THEN 'xx' WHEN k % 4 = 0 THEN 'de' ELSE 'us' END region_default,
   CASE WHEN k % 14 = 0 THEN '{title}/{nope}' WHEN k % 35 = 0 THEN 'plain' WHEN k % 7 = 0 THEN '{author}/{title}' ELSE '{author}/{series_name}/{Book series_position:00 - }{title}/{title} [{asin}]' END path_template,
   CASE WHEN k % 25 = 0 THEN '../x' WHEN k % 10 = 0 THEN '/abs' WHEN k % 15 = 0 THEN 'a\b' WHEN k % 5 = 0 THEN 'done//' || k ELSE '' END sub FROM s)
SELECT s_suppkey, input_dir, CAST(workers AS BIGINT) AS workers, region_default, path_template, k % 12 <> 0 AS write_chapters_txt, true AS retag_move_default,
 CASE WHEN k % 25 = 0 THEN '/x' WHEN k % 10 = 0 THEN '/completed/abs' WHEN k % 15 = 0 THEN '/completed/a\b' WHEN k % 5 = 0 THEN '/completed/done/' || k ELSE '/completed' END AS completed,
 concat_ws('; ', CASE WHEN k % 10 = 0 THEN 'input_dir: empty' END, CASE WHEN k % 25 = 0 THEN 'completed_subdir: leaves its root' WHEN k % 10 = 0 THEN 'completed_subdir: absolute path' WHEN k % 15 = 0 THEN 'completed_subdir: backslash or drive letter' END,
   CASE WHEN k % 14 = 0 THEN 'path_template: {nope} names no variable' WHEN k % 35 = 0 THEN 'path_template: template has no variables' END, CASE WHEN k % 8 = 0 THEN 'region_default: unknown' END,
   CASE WHEN workers < 1 OR workers > 8 THEN 'worker_concurrency: not 1 to 8' END, CASE WHEN k % 18 = 0 THEN 'bitrate_kbps: not offered' END) AS problems FROM v"""


def settings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a save of each store's settings would write."""
    return settings.as_rows(settings.typed(_stored(spark, sf_dir), ("s_suppkey",)).where(F.size(settings.problems()) == 0), ("s_suppkey",)).groupBy("key", "value").agg(F.count("*").alias("stores"))


SETTINGS_ROWS_SQL = """WITH s AS (SELECT s_suppkey k FROM supplier), g AS (SELECT k, CASE WHEN k % 3 = 0 AND k % 21 <> 0 THEN k ELSE 1 END w FROM s WHERE k % 10 <> 0 AND k % 25 <> 0 AND k % 15 <> 0 AND k % 14 <> 0 AND k % 35 <> 0 AND k % 8 <> 0 AND k % 18 <> 0), f AS (SELECT * FROM g WHERE w BETWEEN 1 AND 8),
 r AS (SELECT unnest([struct_pack(key := 'output_dir', value := '/out'), struct_pack(key := 'input_dir', value := CASE WHEN k % 2 = 0 THEN '/in/' || k ELSE '/input' END), struct_pack(key := 'worker_concurrency', value := CAST(w AS VARCHAR)),
   struct_pack(key := 'region_default', value := CASE WHEN k % 4 = 0 THEN 'de' ELSE 'us' END), struct_pack(key := 'completed_subdir', value := CASE WHEN k % 5 = 0 THEN 'done//' || k ELSE '' END), struct_pack(key := 'write_chapters_txt', value := CASE WHEN k % 12 = 0 THEN 'false' ELSE 'true' END),
   struct_pack(key := 'path_template', value := CASE WHEN k % 7 = 0 THEN '{author}/{title}' ELSE '{author}/{series_name}/{Book series_position:00 - }{title}/{title} [{asin}]' END), struct_pack(key := 'bitrate_kbps', value := CASE WHEN k % 9 = 0 THEN '128' ELSE '0' END),
   struct_pack(key := 'cleanup_mode', value := 'leave'), struct_pack(key := 'metadata_provider', value := 'audnexus'), struct_pack(key := 'audnexus_url', value := 'https://api.audnex.us'), struct_pack(key := 'encoder', value := 'aac'), struct_pack(key := 'retag_move_default', value := 'true')], recursive := true) FROM f)
SELECT key, value, count(*) AS stores FROM r GROUP BY 1, 2"""


def _params(pairs: dict):
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values()))


def request_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id")
    sent = _params({"msrc:title": F.when(k % 2 == 0, "primary").otherwise(""), "msrc:series": F.col("event_type"), "msrc:other": F.lit("x"), "title": F.lit("y"), "msrc:genres": F.when(k % 3 == 0, "secondary").otherwise("")})
    found = F.array_sort(F.map_entries(requests.overrides(sent)))
    return e.select("event_id", F.array_join(F.transform(found, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("picked"))


OVERRIDES_SQL = """SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'genres=secondary' END, 'series=' || event_type, CASE WHEN event_id % 2 = 0 THEN 'title=primary' END) AS picked FROM events"""


def request_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id")
    ms = (k * 977 - 2_000_000).cast("string")
    sent = _params({"shift_mode": F.when(k % 3 == 0, "interp").otherwise("fixed"), "shift": F.when(k % 5 == 0, "soon").otherwise(ms), "shift_from_idx": F.when(k % 2 == 0, " 2 ").otherwise("x"), "shift_from_ms": ms, "shift_to_idx": F.lit("9"), "shift_to_ms": F.lit("99999999")})
    spec = F.when(k % 7 == 0, F.lit(None)).otherwise(text.let(sent, requests.shift_spec))
    spec = F.coalesce(spec, requests.shift_spec(F.create_map().cast("map<string,string>")))
    used = F.col("used")  # made once, read field by field
    e = e.select("event_id", text.let(spec, lambda s: settings.effective_shift(s, F.when(k % 14 == 0, F.lit(1500)))).alias("used"))
    return e.select("event_id", used["mode"].alias("mode"), used["fixed_ms"].alias("fixed_ms"), used["from_idx"].cast("long").alias("from_idx"), used["from_ms"].alias("from_ms"), used["to_ms"].alias("to_ms"), chapters.shift_is_zero(used["mode"], used["fixed_ms"], used["from_ms"], used["to_ms"]).alias("nothing"))


SHIFT_SQL = """WITH e AS (SELECT event_id, event_id k, greatest(-3600000, least(3600000, event_id * 977 - 2000000)) ms FROM events),
 s AS (SELECT *, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 14 = 0 THEN 'fixed' ELSE '' END WHEN k % 3 = 0 THEN 'interp' WHEN k % 5 = 0 OR ms = 0 THEN '' ELSE 'fixed' END m FROM e)
SELECT event_id, m AS mode, CAST(CASE WHEN m = 'fixed' THEN CASE WHEN k % 7 = 0 THEN 1500 ELSE ms END ELSE 0 END AS BIGINT) AS fixed_ms, CAST(CASE WHEN m = 'interp' AND k % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS from_idx,
 CAST(CASE WHEN m = 'interp' THEN ms ELSE 0 END AS BIGINT) AS from_ms, CAST(CASE WHEN m = 'interp' THEN 3600000 ELSE 0 END AS BIGINT) AS to_ms, m = '' AS nothing FROM s"""


def _ident(c):
    return F.concat(F.lit("B"), F.lpad(c.cast("string"), 9, "0"))


def request_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    chosen = F.when(k % 4 == 0, "manual").when(k % 4 == 1, F.concat(_ident(k), F.lit("|uk"))).when(k % 4 == 2, "").otherwise("|us")
    c = requests.choice(chosen, F.when(k % 8 == 0, F.concat(F.lit(" "), F.lower(_ident(k)))).otherwise("short"), F.lit("de"))
    whole = requests.split_id(F.concat(_ident(k), F.when(k % 3 == 0, "").when(k % 3 == 1, "_UK").otherwise("_zz")), settings.REGIONS, F.lit("us"))
    return p.select("p_partkey", c["asin"].alias("asin"), c["region"].alias("region"), c["ok"].alias("ok"), whole["asin"].alias("id"), whole["region"].alias("id_region"))


CHOICE_SQL = """WITH p AS (SELECT p_partkey, p_partkey k, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') i FROM part)
SELECT p_partkey, CASE WHEN k % 8 = 0 OR k % 4 = 1 THEN i ELSE '' END AS asin, CASE WHEN k % 8 = 0 THEN 'de' WHEN k % 4 = 1 THEN 'uk' ELSE '' END AS region, k % 8 = 0 OR k % 4 = 1 AS ok, i AS id, CASE WHEN k % 3 = 1 THEN 'uk' ELSE 'us' END AS id_region FROM p"""


def catalog_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    region = F.when(k % 3 == 0, "uk").when(k % 3 == 1, "us").otherwise("zz")
    found = requests.search_url(region, F.concat("p_name", F.lit(" & ñ+*~")), F.when(k % 2 == 0, F.col("p_type")).otherwise(""), F.col("p_brand"))
    return p.select("p_partkey", found.alias("search"), requests.product_url(region, _ident(k)).alias("product"), requests.unquoted(requests.path_escape(F.concat("p_brand", F.lit("+ %")))).alias("back"))


URLS_SQL = """WITH p AS (SELECT *, 'https://api.audible' || CASE p_partkey % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' END || '/1.0/catalog/products' b FROM part)
SELECT p_partkey, b || '?author=' || replace(url_encode(p_brand), '%20', '+') || '&image_sizes=500%2C1000&keywords=' || replace(url_encode(p_name || ' & ñ+*~'), '%20', '+') || '&num_results=25&products_sort_by=Relevance&response_groups=contributors%2Cproduct_desc%2Cmedia%2Cproduct_attrs' || CASE WHEN p_partkey % 2 = 0 THEN '&title=' || replace(url_encode(p_type), '%20', '+') ELSE '' END AS search,
 b || '/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '?image_sizes=500%2C1000&response_groups=contributors%2Cproduct_desc%2Cmedia%2Cproduct_attrs%2Cproduct_extended_attrs%2Cseries%2Ccategory_ladders' AS product, p_brand || '+ %' AS back FROM p"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each part: one to three files, every fourth with a chapter text."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    audio = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.concat(k.cast("string"), F.lit("/0"), i.cast("string"), F.lit(".mp3")))
    names = F.concat(audio, F.when(k % 4 == 0, F.array(F.concat(k.cast("string"), F.lit("/01.chapters.txt")))).otherwise(F.array().cast("array<string>")))
    return p.select(F.explode(names).alias("rel_path"))


def import_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand selects its parts' folders, some of them twice, and one that is empty."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    once = p.select(F.col("p_brand").alias("id"), k.cast("string").alias("path"), k.alias("pos"))
    again = p.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("id"), F.concat(k.cast("string"), F.lit("/01.mp3")).alias("path"), (k + 10**6).alias("pos"))
    empty = p.select(F.col("p_brand").alias("id"), F.lit("none/1984").alias("path"), F.lit(0).cast("long").alias("pos")).distinct()
    out = requests.import_items(once.unionByName(again).unionByName(empty), _files(spark, sf_dir))
    return out.select("id", "path", "files", "has_sidecar", F.col("guess.keywords").alias("keywords"), F.col("guess.author").alias("author"), F.col("guess.title").alias("title"))


IMPORT_SQL = """SELECT p_brand AS id, CAST(p_partkey AS VARCHAR) AS path, CAST(p_partkey % 3 + 1 AS BIGINT) AS files, p_partkey % 3 = 0 AND p_partkey % 4 = 0 AS has_sidecar, CAST(p_partkey AS VARCHAR) AS keywords, '' AS author, CAST(p_partkey AS VARCHAR) AS title FROM part
UNION ALL SELECT DISTINCT p_brand, 'none/1984', 0, false, '1984', '', '1984' FROM part"""


def retag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("Title"), F.col("p_name"), F.lit("artist"), F.concat("p_brand", F.lit("; "), "p_type"), F.lit("ASIN"), _ident(k)))
    files = p.select(F.concat(F.lit("lib/"), k.cast("string"), F.when(k % 5 == 0, ".mp3").otherwise(".M4B")).alias("rel_path"), tags.alias("tags"))
    return requests.retag_items(files)


RETAG_SQL = """SELECT 'lib/' || p_partkey || '.M4B' AS rel_path, CASE WHEN p_partkey % 3 = 0 THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE '' END AS asin, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS author,
 CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_partkey || '.M4B' END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || p_name ELSE p_partkey || '.M4B' END AS keywords FROM part WHERE p_partkey % 5 <> 0"""


def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    typed = c.select("c_custkey", F.when(k % 7 == 0, "B12").otherwise(_ident(k * 3)).alias("asin"), F.when(k % 2 == 0, "us").otherwise("").alias("region"))
    records = _table(spark, sf_dir, "part").select(_ident(F.col("p_partkey")).alias("asin"), F.when(F.col("p_partkey") % 4 == 0, "uk").otherwise("us").alias("region"), F.col("p_name").alias("title"))
    return requests.looked_up(typed, records, "us").select("c_custkey", "region", "title", "problem")


LOOKUP_SQL = """WITH c AS (SELECT c_custkey, c_custkey * 3 k, c_custkey % 7 <> 0 ok, 'B' || lpad(CAST(c_custkey * 3 AS VARCHAR), 9, '0') i FROM customer)
SELECT c_custkey, 'us' AS region, p_name AS title, CASE WHEN NOT ok THEN 'not ten letters or digits' WHEN p_partkey IS NULL THEN 'no record ' || i || ' in region us' ELSE '' END AS problem FROM c LEFT JOIN part ON ok AND p_partkey = k AND p_partkey % 4 <> 0"""


def row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    book = F.struct(F.array("p_brand", "p_type").alias("authors"), F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("series_name"), F.when(k % 4 == 0, (k % 9).cast("string")).otherwise("").alias("series_position"), (F.col("p_size") * 10).cast("int").alias("runtime_min"))
    local = F.when(k % 11 == 0, 0).otherwise(F.col("p_size") * 600_000 + (k % 200 - 100) * 30_000).cast("long")
    s = requests.row_summary(book, F.when(k % 3 == 0, F.col("p_size") * 600_000 + 1000).otherwise(0).cast("long"), local)
    return p.select("p_partkey", F.inline(F.array(s)))


SUMMARY_SQL = """WITH p AS (SELECT *, p_partkey k, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 600000 + (p_partkey % 200 - 100) * 30000 END l, p_size * 600000 + CASE WHEN p_partkey % 3 = 0 THEN 1000 ELSE 0 END o FROM part),
 m AS (SELECT *, (o + 30000) // 60000 - (l + 30000) // 60000 d, (l + 30000) // 60000 lm FROM p),
 b AS (SELECT *, CASE WHEN l <= 0 OR lm <= 0 THEN '' WHEN abs(d) <= 1 OR abs(d) / lm::DOUBLE <= 0.005 THEN 'exact' WHEN abs(d) / lm::DOUBLE <= 0.02 THEN 'close' WHEN abs(d) / lm::DOUBLE <= 0.05 THEN 'near' ELSE 'off' END band FROM m),
 t AS (SELECT *, CASE WHEN d = 0 OR band = '' THEN 'same length' ELSE CASE WHEN abs(d) < 60 THEN abs(d) || ' min' WHEN abs(d) % 60 = 0 THEN abs(d) // 60 || ' hrs' ELSE abs(d) // 60 || ' hrs ' || abs(d) % 60 || ' min' END || CASE WHEN d < 0 THEN ' shorter' ELSE ' longer' END END x FROM b)
SELECT p_partkey, p_brand || ', ' || p_type AS authors, CASE WHEN k % 4 = 0 THEN p_type || ', Book ' || k % 9 WHEN k % 2 = 0 THEN p_type ELSE '' END AS series, CAST(o AS BIGINT) AS official_ms, band AS badge,
 CASE WHEN l <= 0 THEN '' WHEN band = 'exact' THEN 'same running time' WHEN band = 'off' THEN x || ', likely another edition' ELSE x || ' than the files' END AS note FROM t"""


def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 997).cast("long").alias("duration_ms"))
    out = requests.file_preview(i, "l_orderkey", ["l_linenumber", "duration_ms"])
    return out.select("l_orderkey", F.col("place").cast("long").alias("place"), "start_ms", "end_ms", "end_seek_ms", "stamp", "length")


FILE_PREVIEW_SQL = """WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 997 AS BIGINT) d FROM lineitem), w AS (SELECT *, row_number() OVER o place, CAST(coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) s FROM i WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, d))
SELECT l_orderkey, place, s AS start_ms, s + d AS end_ms, greatest(s, s + d - 6000) AS end_seek_ms, printf('%d:%02d', s // 60000, s % 60000 // 1000) AS stamp, printf('%d:%02d', d // 60000, d % 60000 // 1000) AS length FROM w"""


def provider_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each order, chapters of every third customer's record with the starts of its orders' lines."""
    o = _table(spark, sf_dir, "orders")
    jobs = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(_ident(F.col("o_custkey"))).alias("asin"), F.lit("us").alias("region"), F.when(F.col("o_orderkey") % 4 == 0, "existing").otherwise("auto").alias("chapter_mode"))
    c = _table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    list_of = F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("Part "), i.cast("string")).alias("title"), (i * 1_800_000).cast("long").alias("start_ms")))
    known = c.select(_ident(F.col("c_custkey")).alias("asin"), F.lit("us").alias("region"), requests.chapter_listing(list_of).alias("chapters"))
    out = requests.provider_chapters(jobs, known)
    return out.select("o_orderkey", F.size(F.coalesce("chapters", F.expr("cast(array() as array<struct<title:string,start_ms:bigint,stamp:string>>)"))).cast("long").alias("n"), F.try_element_at("chapters", F.lit(-1))["stamp"].alias("last"), "note")


PROVIDER_SQL = """WITH o AS (SELECT o_orderkey, o_custkey c, o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0 asked FROM orders)
SELECT o_orderkey, CAST(CASE WHEN asked AND c % 3 = 0 AND c_custkey IS NOT NULL THEN c % 4 + 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN asked AND c % 3 = 0 AND c_custkey IS NOT NULL THEN CASE c % 4 WHEN 0 THEN '0:00' WHEN 1 THEN '30:00' WHEN 2 THEN '1:00:00' ELSE '1:30:00' END END AS "last",
 CASE WHEN NOT asked OR (c % 3 = 0 AND c_custkey IS NOT NULL) THEN '' ELSE 'no chapters for B' || lpad(CAST(c AS VARCHAR), 9, '0') END AS note FROM o LEFT JOIN customer ON c_custkey = c"""


def overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("pos"), F.when(F.col("l_quantity") > 25, F.col("l_quantity") * 10).otherwise(0).cast("long").alias("header_ms"))
    return requests.overflow(i, "l_orderkey").select("l_orderkey", "overflowed", "first_header_ms")


OVERFLOW_SQL = "SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS overflowed, CAST(arg_min(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (l_quantity > 25) * 10 AS BIGINT) AS first_header_ms FROM lineitem GROUP BY 1"


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of twenty each user's jobs fill."""
    e = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", requests.pages(F.col("n"), 20).alias("pages"))


PAGES_SQL = "SELECT user_id, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM events GROUP BY 1"


def library_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    e = p.select(k.alias("k"), F.concat("p_name", F.when(k % 3 == 0, ".M4B").when(k % 3 == 1, ".mp3").otherwise("")).alias("name"), (k % 3 == 2).alias("is_dir"))
    return requests.library_entries(e)


LIBRARY_SQL = "SELECT p_partkey AS k, p_name || CASE WHEN p_partkey % 3 = 0 THEN '.M4B' ELSE '' END AS name, p_partkey % 3 = 2 AS is_dir FROM part WHERE p_partkey % 3 <> 1"


def covers_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cover a job embeds, and whether it writes a chapter text."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://m.media-amazon.com/images/I/"), k.cast("string"), F.when(k % 4 == 0, "._SL500_").otherwise(""), F.lit(".jpg"))).when(k % 7 == 0, "https://example.net/c.jpg").otherwise("")
    c = requests.cover_choice(F.when(k % 5 == 0, F.concat(F.lit("covers/"), k.cast("string"))), url, F.when(k % 3 == 0, F.lit(b"x")))
    return p.select("p_partkey", c["source"].alias("source"), c["value"].alias("value"), requests.writes_sidecar(k % 6 == 0, (k % 4).cast("int"), k % 10 < 5).alias("writes"))


COVERS_SQL = """WITH p AS (SELECT p_partkey, p_partkey k FROM part) SELECT p_partkey, CASE WHEN k % 5 = 0 THEN 'hand' WHEN k % 2 = 0 OR k % 7 = 0 THEN 'catalog' WHEN k % 3 = 0 THEN 'embedded' ELSE '' END AS source,
 CASE WHEN k % 5 = 0 THEN 'covers/' || k WHEN k % 2 = 0 THEN 'https://m.media-amazon.com/images/I/' || k || '._SL2000_.jpg' WHEN k % 7 = 0 THEN 'https://example.net/c.jpg' ELSE '' END AS value, k % 6 = 0 OR (k % 4 = 1 AND k % 10 < 5) AS writes FROM p"""


def duration_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored totals by file group and signature: every fifth is of files that changed since."""
    o = _table(spark, sf_dir, "orders")
    wanted = o.select("o_orderkey", F.sha2(F.concat_ws(":", "o_custkey", "o_orderdate"), 256).alias("signature"))
    stored = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise(F.sha2(F.concat_ws(":", "o_custkey", "o_orderdate"), 256)).alias("signature"), F.col("o_custkey").alias("value"))
    return requests.memo(wanted, stored, ["o_orderkey"]).select("o_orderkey", "value")


MEMO_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN o_custkey END AS value FROM orders"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes, differences, sizes, stages and numbers as shown."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    n = k * k * 1237 + 500
    return p.select(
        "p_partkey", clock.minutes_text(k % 200).alias("minutes"), clock.delta_text(k % 150 - 75).alias("delta"), clock.size_text(n).alias("size"), clock.stage_progress(F.lit(0.25), F.lit(0.5), (k % 30 - 5) / 20.0).alias("progress"),
        clock.positive_int(F.when(k % 4 == 0, "x").when(k % 4 == 1, "-3").otherwise(k.cast("string"))).alias("number"),
    )


TEXTS_SQL = """WITH p AS (SELECT p_partkey, p_partkey k, p_partkey * p_partkey * 1237 + 500 n, abs(p_partkey % 150 - 75) d FROM part)
SELECT p_partkey, CASE WHEN k % 200 < 60 THEN k % 200 || ' min' WHEN k % 200 % 60 = 0 THEN k % 200 // 60 || ' hrs' ELSE k % 200 // 60 || ' hrs ' || k % 200 % 60 || ' min' END AS minutes,
 CASE WHEN d = 0 THEN 'same length' WHEN d < 60 THEN d || ' min' WHEN d % 60 = 0 THEN d // 60 || ' hrs' ELSE d // 60 || ' hrs ' || d % 60 || ' min' END || CASE WHEN k % 150 < 75 THEN ' shorter' WHEN k % 150 > 75 THEN ' longer' ELSE '' END AS delta,
 CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS "size",
 0.25::DOUBLE + 0.5::DOUBLE * greatest(0, least(1, (k % 30 - 5) / 20.0::DOUBLE)) AS progress, CASE WHEN k % 4 > 1 THEN k END AS number FROM p"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent frames of each user's events, by what they refresh."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "click", "log").otherwise("status")
    rows = e.select(F.col("user_id").cast("string").alias("job_id"), kind.alias("kind"), F.lit("merge").alias("stage"), (F.col("event_id") % 100 / 100).alias("progress"), F.lit("done").alias("status"), F.concat(F.lit("<b> & "), "event_id").alias("line"), F.col("ts").cast("timestamp").alias("ts"))
    out = stream.frames(rows)
    return out.groupBy("name").agg(F.count("*").alias("n"), F.min("frame").alias("first"))


ROUTED_SQL = """WITH e AS (SELECT event_id k, user_id u, event_type t FROM events),
 f AS (SELECT 'job-' || u || '-progress' "name", 'event: job-' || u || '-progress' || chr(10) || 'data: merge ' || k % 100 || chr(10) || chr(10) frame FROM e WHERE t = 'view'
  UNION ALL SELECT 'job-' || u || '-log', 'event: job-' || u || '-log' || chr(10) || 'data: &lt;b&gt; &amp; ' || k || chr(10) || chr(10) FROM e WHERE t = 'click'
  UNION ALL SELECT 'job-' || u || '-status', 'event: job-' || u || '-status' || chr(10) || 'data: done' || chr(10) || chr(10) FROM e WHERE t NOT IN ('view', 'click')
  UNION ALL SELECT 'queue-changed', 'event: queue-changed' || chr(10) || 'data: 1' || chr(10) || chr(10) FROM e WHERE t NOT IN ('view', 'click'))
SELECT "name", count(*) AS n, min(frame) AS "first" FROM f GROUP BY 1"""


def encoder_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    ms = F.col("event_id") * 137
    line = F.when(F.col("event_id") % 5 == 0, "press q to stop").otherwise(F.concat(F.lit("size= 1kB time="), F.left(clock.timestamp_text(ms), F.lit(11)), F.lit(" speed=4x")))
    rows = e.select("event_id", F.col("user_id").alias("job_id"), line.alias("line"))
    return stream.parsed_progress(rows, F.lit(1_000_000)).select("event_id", F.round("progress", 6).alias("progress"))


ENCODER_SQL = "SELECT event_id, round(least(1, (event_id * 137 // 10 * 10) / 1000000.0::DOUBLE), 6) AS progress FROM events WHERE event_id % 5 <> 0"


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subscribers to each user's events, with room for four: what does not fit is dropped."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return stream.delivered(e, ["page", "log"], ["job_id"], ["ts", "event_id"], 4).groupBy("subscriber", "job_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


FAN_SQL = """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events) SELECT s AS subscriber, user_id AS job_id, count(*) AS n, max(event_id) AS "last" FROM e, (VALUES ('page'), ('log')) t(s) WHERE i <= 4 GROUP BY 1, 2"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings in the gaps of each user's events, one a day of silence."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    return stream.heartbeats(e, "job_id", 86_400).groupBy("job_id").agg(F.count("*").alias("pings"))


HEART_SQL = """WITH g AS (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) // 1000000 - epoch_us(ts) // 1000000 d FROM events), p AS (SELECT user_id, greatest(0, (d - 1) // 86400) n FROM g WHERE d IS NOT NULL)
SELECT user_id AS job_id, CAST(sum(n) AS BIGINT) AS pings FROM p GROUP BY 1 HAVING sum(n) > 0"""


QUERIES = {
    "settings_typed": (settings_typed, SETTINGS_SQL),
    "settings_save": (settings_rows, SETTINGS_ROWS_SQL),
    "request_overrides": (request_overrides, OVERRIDES_SQL),
    "request_shift": (request_shift, SHIFT_SQL),
    "request_choice": (request_choice, CHOICE_SQL),
    "catalog_urls": (catalog_urls, URLS_SQL),
    "import_items": (import_items, IMPORT_SQL),
    "retag_items": (retag_items, RETAG_SQL),
    "id_lookup": (id_lookup, LOOKUP_SQL),
    "row_summary": (row_summary, SUMMARY_SQL),
    "file_preview": (file_preview, FILE_PREVIEW_SQL),
    "provider_chapters": (provider_chapters, PROVIDER_SQL),
    "overflow_summary": (overflow, OVERFLOW_SQL),
    "job_pages": (job_pages, PAGES_SQL),
    "library_entries": (library_entries, LIBRARY_SQL),
    "covers_and_texts": (covers_and_texts, COVERS_SQL),
    "duration_memo": (duration_memo, MEMO_SQL),
    "shown_texts": (texts, TEXTS_SQL),
    "event_frames": (routed, ROUTED_SQL),
    "encoder_progress": (encoder_progress, ENCODER_SQL),
    "event_fan_out": (fan_out, FAN_SQL),
    "event_heartbeats": (heartbeats, HEART_SQL),
}
