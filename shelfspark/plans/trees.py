"""File-tree and template queries over the paths of ``pages.url`` and names made of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import path_index, paths, template
from ..sources import tables


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: type/brand/disc folder/name, some junk, some not audio; and their folders."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    ext = F.element_at(F.array(F.lit(".mp3"), F.lit(".M4B"), F.lit(".txt"), F.lit(".m4b")), (key % 4 + 1).cast("int"))
    disc = F.when(key % 5 == 0, F.concat(F.lit("CD "), (key % 3 + 1).cast("string"), F.lit("/"))).when(key % 11 == 0, "@eaDir/").otherwise("")
    path = F.concat("p_type", F.lit("/"), "p_brand", F.lit("/"), disc, F.lit("Track "), key.cast("string"), ext)
    files = p.select(path.alias("rel_path"), F.lit(False).alias("is_dir"), key.alias("size"), F.timestamp_seconds(key).alias("mtime"), "p_type")
    dirs = files.select(F.explode(paths.ancestors(F.col("rel_path"))).alias("rel_path"), "p_type", "mtime").groupBy("rel_path", "p_type").agg(F.max("mtime").alias("mtime"))
    return files.unionByName(dirs.select("rel_path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), "mtime", "p_type"))


_TREE_SQL = """p AS (SELECT p_partkey k, p_type t, p_type || '/' || p_brand d0, CASE WHEN p_partkey % 5 = 0 THEN 'CD ' || (p_partkey % 3 + 1) WHEN p_partkey % 11 = 0 THEN '@eaDir' ELSE '' END sub,
  'Track ' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.M4B' WHEN 2 THEN '.txt' ELSE '.m4b' END f FROM part),
 files AS (SELECT *, d0 || CASE WHEN sub <> '' THEN '/' || sub ELSE '' END dir FROM p),
 good AS (SELECT *, dir || '/' || f path FROM files WHERE sub <> '@eaDir'),
 audio AS (SELECT * FROM good WHERE k % 4 <> 2)"""


def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.children(_tree(spark, sf_dir))
    return out.select("parent", F.col("audio_files").cast("long").alias("audio_files"), F.col("sub_dirs").cast("long").alias("sub_dirs"))


CHILDREN_SQL = f"""WITH {_TREE_SQL}, dirs AS (SELECT DISTINCT t AS path, '' AS parent FROM files UNION SELECT DISTINCT d0, t FROM files UNION SELECT DISTINCT dir, d0 FROM files WHERE sub LIKE 'CD%'),
 u AS (SELECT dir AS parent, CASE WHEN k % 4 <> 2 THEN 1 ELSE 0 END a, 0 s FROM good UNION ALL SELECT parent, 0, 1 FROM dirs)
SELECT parent, CAST(sum(a) AS BIGINT) AS audio_files, CAST(sum(s) AS BIGINT) AS sub_dirs FROM u GROUP BY 1"""


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tree(spark, sf_dir).where("not is_dir").withColumn("root", F.col("p_type"))
    return paths.merge_order(files).select("rel_path", F.col("place").cast("long").alias("place"))


MERGE_ORDER_SQL = f"""WITH {_TREE_SQL}, b AS (SELECT *, CAST(regexp_extract(d0, '([0-9]+)$', 1) AS INT) bn FROM audio)
SELECT path AS rel_path, row_number() OVER (PARTITION BY t ORDER BY sub <> '', CASE WHEN sub <> '' THEN CAST(substr(sub, 4) AS INT) ELSE 0 END, bn, k) AS place FROM b"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.listing(_tree(spark, sf_dir), "ECONOMY", newest_first=False)
    return out.select("name", F.col("audio_files").cast("long").alias("audio_files"), F.col("place").cast("long").alias("place"))


LISTING_SQL = f"""WITH {_TREE_SQL}, d AS (SELECT split_part(d0, '/', 2) AS "name", count(*) FILTER (sub = '' AND k % 4 <> 2) a, count(*) FILTER (sub LIKE 'CD%') s FROM good WHERE t = 'ECONOMY' GROUP BY 1)
SELECT "name", a AS audio_files, row_number() OVER (ORDER BY CAST(regexp_extract("name", '([0-9]+)$', 1) AS INT)) AS place FROM d WHERE a + s > 0"""


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.search(_tree(spark, sf_dir), "brand#1 tRack", 50)
    return out.select("rel_path", "total")


SEARCH_SQL = f"""WITH {_TREE_SQL}, h AS (SELECT path FROM good WHERE k % 2 = 1 AND contains(lower(path), 'brand#1'))
SELECT path AS rel_path, (SELECT count(*) FROM h) AS total FROM (SELECT path, string_split(path, '/') w FROM h ORDER BY w LIMIT 50)"""


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``library_search`` by a trigram index."""
    index = path_index.build(_tree(spark, sf_dir).drop("p_type"), tables.scratch(spark, "paths"))
    return path_index.search(index, "brand#1 tRack", 50).select("rel_path", "total")


def index_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each brand and type, and for each host of ``pages``, over the paths of parts and of pages: how many match."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"), F.lit(False).alias("is_dir")).distinct()
    index = path_index.build(_tree(spark, sf_dir).select("rel_path", "is_dir").unionByName(pages), tables.scratch(spark, "paths"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    queries = p.select(F.concat(F.upper("p_type"), F.lit(" "), "p_brand", F.lit("/")).alias("query")).unionByName(pages.select(F.concat(F.substring_index("rel_path", "/", 1), F.lit(" en")).alias("query")))
    return path_index.search_many(index, queries).groupBy("query").agg(F.count("*").alias("hits"), F.min("rel_path").alias("first_path"))


MANY_SQL = rf"""WITH {_TREE_SQL}, x AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') path FROM pages),
 e AS (SELECT dir || '/' || f path FROM files UNION ALL SELECT DISTINCT t FROM files UNION ALL SELECT DISTINCT d0 FROM files UNION ALL SELECT DISTINCT dir FROM files WHERE sub <> '' UNION ALL SELECT path FROM x),
 q AS (SELECT DISTINCT upper(p_type) || ' ' || p_brand || '/' query FROM part UNION SELECT DISTINCT split_part(path, '/', 1) || ' en' FROM x)
SELECT query, count(*) AS hits, min(path) AS first_path FROM q JOIN e ON contains(lower(path), lower(split_part(query, ' ', 1))) AND contains(lower(path), lower(split_part(query, ' ', 2))) GROUP BY 1"""


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("a/./b/../"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    return u.select("page_id", paths.cleaned_path(F.col("path")).alias("clean"), paths.confined(F.concat(F.when(F.col("page_id") % 3 == 0, "../").otherwise(""), F.regexp_replace("path", "^a/\\./b/\\.\\./", ""))).alias("inside"), text.base_name(F.col("path")).alias("base"))


FILTER_SQL = r"""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') p FROM pages), c AS (SELECT page_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '/') p FROM u)
SELECT page_id, 'a/' || p AS clean, CASE WHEN page_id % 3 = 0 THEN NULL ELSE p END AS inside, split_part(p, '/', -1) AS base FROM c"""


def selection_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection per language: of its pages' paths, all first levels of every fourth page and whole paths of the rest."""
    u = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") % 7).alias("id"), F.col("page_id").alias("pos"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("p"))
    chosen = u.select("id", "pos", F.when(F.col("pos") % 4 == 0, F.substring_index("p", "/", 2)).otherwise(F.concat("p", F.lit("/"))).alias("path"))
    return paths.deduped_selection(chosen).select("id", "path", "pos")


SELECTION_SQL = r"""WITH u AS (SELECT page_id % 7 id, page_id pos, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') p FROM pages),
 c AS (SELECT id, pos, CASE WHEN pos % 4 = 0 THEN rtrim(array_to_string(string_split(p, '/')[1:2], '/'), '/') ELSE rtrim(p, '/') END path FROM u),
 o AS (SELECT id, path, min(pos) pos FROM c GROUP BY 1, 2)
SELECT id, path, pos FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.id = o.id AND starts_with(o.path, x.path || '/'))"""


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tree(spark, sf_dir).where("not is_dir").select("rel_path")
    wanted = spark.createDataFrame([(1, "ECONOMY"), (1, "ECONOMY/Brand#2"), (2, "PROMO/Brand#3"), (2, "SMALL/Brand#4/CD 1")], "id int, path string")
    return paths.selected_files(files, wanted).select(F.col("id").cast("long").alias("id"), "rel_path")


SELECTED_SQL = f"""WITH {_TREE_SQL}, w(id, p) AS (VALUES (1, 'ECONOMY'), (2, 'PROMO/Brand#3'), (2, 'SMALL/Brand#4/CD 1'))
SELECT DISTINCT CAST(id AS BIGINT) AS id, path AS rel_path FROM audio JOIN w ON starts_with(path, p || '/')"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.by_folder(_tree(spark, sf_dir).where("not is_dir").withColumn("root", F.col("p_type")))
    return out.select("folder", F.size("files").cast("long").alias("n"), F.element_at("files", 1).alias("first_file"), F.element_at("files", -1).alias("last_file"))


FOLDERS_SQL = f"""WITH {_TREE_SQL} SELECT dir AS folder, count(*) AS n, dir || '/' || arg_min(f, k) AS first_file, dir || '/' || arg_max(f, k) AS last_file FROM files WHERE k % 4 <> 2 GROUP BY dir"""


TEMPLATE = "{author}/{series_name}/{Book series_position:00 - }{title} ({year}) [{asin}]"


def path_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    hole = lambda n, c: F.when(k % n == 0, "").otherwise(c)
    v = {"author": F.col("p_brand"), "series_name": hole(3, F.col("p_type")), "series_position": hole(2, F.col("p_size").cast("string")), "title": F.col("p_name"), "year": hole(5, F.lit("2020")), "asin": hole(7, F.lit("B0"))}
    return p.select("p_partkey", template.rendered(TEMPLATE, v).alias("path"))


RENDER_SQL = """SELECT p_partkey, p_brand || '/' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || '/' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Book ' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || ' - ' END || p_name
 || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' (2020)' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' [B0]' END AS path FROM part"""


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    files = p.select(F.concat(F.lit("/out/old/"), F.col("p_partkey").cast("string"), F.lit(".m4b")).alias("path"), "p_partkey", "p_brand", "p_name", "p_size")
    v = {"author": F.col("p_brand"), "title": F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 1500).cast("string"))}
    existing = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("/out/"), "p_brand", F.lit("/"), "p_name", F.lit(" "), (F.col("p_partkey") % 1500).cast("string"), F.lit(".m4b")).alias("path")).distinct()
    out = template.targets(files, "{author}/{title}", v, "/out", existing)
    return out.select("p_partkey", "target", "action")


RENAME_SQL = """WITH t AS (SELECT p_partkey, '/out/' || p_brand || '/' || p_name || ' ' || (p_partkey % 1500) || '.m4b' target FROM part),
 e AS (SELECT DISTINCT lower(target) x FROM t WHERE p_partkey % 4 = 0), c AS (SELECT *, count(*) OVER (PARTITION BY lower(target)) n FROM t)
SELECT p_partkey, target, CASE WHEN n > 1 THEN 'skip: two files, one target' WHEN lower(target) IN (SELECT x FROM e) THEN 'skip: another file is there' ELSE 'move' END AS action FROM c"""


QUERIES = {
    "tree_children": (child_counts, CHILDREN_SQL),
    "disc_order": (merge_order, MERGE_ORDER_SQL),
    "tree_listing": (listing, LISTING_SQL),
    "library_search": (library_search, SEARCH_SQL),
    "library_index_search": (index_search, SEARCH_SQL),
    "library_index_many": (index_search_many, MANY_SQL),
    "path_filter": (path_filter, FILTER_SQL),
    "selection_dedupe": (selection_dedupe, SELECTION_SQL),
    "selected_files": (selected_files, SELECTED_SQL),
    "files_by_folder": (folders, FOLDERS_SQL),
    "path_render": (path_render, RENDER_SQL),
    "rename_plan": (rename_plan, RENAME_SQL),
}
