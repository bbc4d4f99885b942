"""Queries over forms filled in by hand and what a media server's agent stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, tags, text
from ..operators import agent, chapters, forms, genres, paths
from ..sources import payloads, tables

_ID_SQL = "'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _ident(c):
    return F.concat(F.lit("B"), F.lpad(c.cast("string"), 9, "0"))


def _book(**values):
    """A record with some fields known, from an empty one."""
    empty = agent.empty_book()
    return F.struct(*[values.get(k, empty[k]).alias(k) for k in agent.BOOK_COLUMNS], *[v.alias(k) for k, v in values.items() if k not in agent.BOOK_COLUMNS])


def form_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form for each part, wrong in as many ways as its key has small divisors."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    form = F.struct(
        F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("title"),
        F.lit("").alias("subtitle"),
        F.when(k % 7 == 0, " ; ").otherwise(F.concat("p_brand", F.lit("; ; "), "p_type", F.lit(";"), "p_brand")).alias("authors"),
        F.col("p_type").alias("narrators"),
        F.when(k % 3 == 0, "").otherwise(F.col("p_type")).alias("series_name"),
        F.when(k % 2 == 0, (k % 9).cast("string")).otherwise("").alias("series_position"),
        F.when(k % 4 == 0, "2001-02-03").when(k % 4 == 1, " 1999 ").when(k % 4 == 2, "").otherwise("3/4/05").alias("release"),
        F.lit(" Press ").alias("publisher"),
        F.lit("English").alias("language"),
        F.concat("p_type", F.lit("; Horror")).alias("genres"),
        F.concat("p_name", F.lit("\r\nmore ")).alias("description"),
        F.when(k % 6 == 0, "b12").when(k % 6 == 1, F.lower(_ident(k))).otherwise("").alias("asin"),
    )
    rows = p.select("p_partkey", form.alias("f"))
    out = rows.select("p_partkey", F.array_join(forms.form_problems(F.col("f")), "; ").alias("problems"), forms.book_of(F.col("f"), F.lit("local_1")).alias("b"))
    return out.select("p_partkey", "problems", "b.title", F.array_join("b.authors", "|").alias("authors"), "b.year", "b.release_date", "b.language", F.array_join("b.genres", "|").alias("genres"), "b.summary", "b.asin", F.size("b.sources").cast("long").alias("sources"))


FORM_SQL = f"""WITH p AS (SELECT *, p_partkey k FROM part)
SELECT p_partkey, concat_ws('; ', CASE WHEN k % 5 = 0 THEN 'title: missing' END, CASE WHEN k % 7 = 0 THEN 'authors: missing' END, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'series_position: without a series' END, CASE WHEN k % 4 = 3 THEN 'release: 3/4/05' END, CASE WHEN k % 6 = 0 THEN 'asin: B12' END) AS problems,
 CASE WHEN k % 5 = 0 THEN '' ELSE p_name END AS title, CASE WHEN k % 7 = 0 THEN '' WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS authors, CASE k % 4 WHEN 0 THEN '2001' WHEN 1 THEN '1999' ELSE '' END AS "year", CASE WHEN k % 4 = 0 THEN '2001-02-03' ELSE '' END AS release_date, 'english' AS "language",
 p_type || '|Horror' AS genres, p_name || chr(10) || 'more' AS summary, CASE k % 6 WHEN 0 THEN 'B12' WHEN 1 THEN {_ID_SQL} ELSE '' END AS asin, CAST(10 AS BIGINT) AS sources FROM p"""


def form_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record as a form and back, and the form and cover that a page starts with."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    b = _book(title=F.col("p_name"), authors=F.array("p_brand", "p_type"), series_name=F.col("p_type"), series_position=F.lit("1.5"), year=F.lit("2004"), release_date=F.when(k % 2 == 0, "2004-05-06").otherwise(""), genres=F.array(F.when(k % 3 == 0, "Audio Book").otherwise("Horror"), F.lit("Other")), sub_genres=F.array(F.lit("Books & Spoken"), F.lit("Epic")), description=F.lit("short"), summary=F.when(k % 2 == 0, "long").otherwise(""))
    b = b.withField("asin", _ident(k))
    rows = p.select("p_partkey", forms.form_of(b).alias("f"), forms.panel_form(b)["genres"].alias("kept"), forms.panel_cover(F.when(k % 4 == 0, F.lit("x")), F.when(k % 3 == 0, "https://example.net/1.jpg").otherwise("")).alias("cover"))
    again = forms.book_of(F.col("f"), F.lit(""))
    out = rows.withColumn("b", again)
    return out.select("p_partkey", F.col("f.release").alias("release"), F.col("f.description").alias("description"), F.col("f.genres").alias("genres"), "kept", "cover", forms.cover_problem(F.col("cover"), F.lit("no")).alias("cover_problem"), F.array_join("b.authors", "|").alias("authors"), F.concat_ws("/", "b.title", "b.series_name", "b.series_position", "b.year", "b.release_date", "b.asin").alias("back"))


ROUND_SQL = f"""WITH p AS (SELECT *, p_partkey k, CASE WHEN p_partkey % 3 = 0 THEN 'Audio Book' ELSE 'Horror' END g FROM part)
SELECT p_partkey, CASE WHEN k % 2 = 0 THEN '2004-05-06' ELSE '2004' END AS release, CASE WHEN k % 2 = 0 THEN 'long' ELSE 'short' END AS description, g || '; Other; Books & Spoken; Epic' AS genres, CASE WHEN k % 3 = 0 THEN '' ELSE 'Horror; ' END || 'Other; Epic' AS kept,
 CASE WHEN k % 4 = 0 THEN 'file' WHEN k % 3 = 0 THEN 'edition:https://example.net/1.jpg' ELSE 'upload' END AS cover, CASE WHEN k % 4 = 0 OR k % 3 = 0 THEN '' ELSE 'cover: nothing uploaded' END AS cover_problem,
 CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS authors, p_name || '/' || p_type || '/1.5/2004/' || CASE WHEN k % 2 = 0 THEN '2004-05-06' ELSE '' END || '/' || {_ID_SQL} AS back FROM p"""


def form_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    b = _book(title=F.col("p_name"), authors=F.array("p_brand"), series_name=F.when(k % 2 == 0, F.col("p_type")).otherwise(""), series_position=F.lit("3"), year=F.lit("1990"))
    files = F.transform(F.sequence(F.lit(1), (k % 8 + 1).cast("int")), lambda i: F.concat(i.cast("string"), F.lit(".mp3")))
    titles = F.when(k % 3 == 0, F.array(F.lit("One"), F.lit("Two"))).otherwise(F.array().cast("array<string>"))
    edition = F.struct(F.col("p_type").alias("title"), F.array("p_brand").alias("authors"), F.array(F.lit("R")).alias("narrators"), F.lit(61).alias("runtime_min"), F.lit("").alias("year"), _ident(k).alias("asin"))
    editions = F.when(k % 5 == 0, F.array(edition)).otherwise(F.array().cast("array<struct<title:string,authors:array<string>,narrators:array<string>,runtime_min:int,year:string,asin:string>>"))
    prompt = forms.prompt(F.concat(F.lit("in/"), "p_name"), files, (F.col("p_size") * 10).cast("int"), b, titles, editions)
    lines = F.split(prompt, "\n")
    return p.select("p_partkey", F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 3), "\n").alias("facts"))


PROMPT_SQL = f"""SELECT p_partkey, concat_ws(chr(10), '- Location: in/' || p_name, CASE WHEN p_partkey % 8 = 0 THEN '- File: 1.mp3' ELSE '- Files (' || (p_partkey % 8 + 1) || '): ' || array_to_string(list_transform(range(1, least(7, p_partkey % 8 + 2)), lambda i: i || '.mp3'), ', ') || CASE WHEN p_partkey % 8 + 1 > 6 THEN ', …' ELSE '' END END,
 '- Length: ' || (p_size * 10 // 60) || 'h ' || lpad(CAST(p_size * 10 % 60 AS VARCHAR), 2, '0') || 'm (' || p_size * 10 || ' minutes)',
 '- Present tags: title "' || p_name || '"; author "' || p_brand || '"' || CASE WHEN p_partkey % 2 = 0 THEN '; series "' || p_type || ' 3"' ELSE '' END || '; year "1990"',
 CASE WHEN p_partkey % 3 = 0 THEN '- Chapters (2): "One", "Two"' END, CASE WHEN p_partkey % 5 = 0 THEN 'Other editions, for facts about the work alone:' || chr(10) || '- "' || p_type || '" by ' || p_brand || ', read by R, 1h 01m [' || {_ID_SQL} || ']' END) AS facts FROM part"""


def tag_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as tags and read again."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    b = _book(title=F.col("p_name"), authors=F.array("p_brand", "p_type"), narrators=F.array(F.lit("R")), series_name=F.when(k % 2 == 0, F.col("p_type")).otherwise(""), series_position=F.lit("2"), year=F.lit("1999"), release_date=F.when(k % 3 == 0, "1999-12-31").otherwise(""), genres=F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array("p_type")).otherwise(F.array(F.col("p_type"), F.lit("A;B"))), sub_genres=F.when(k % 5 == 2, F.array(F.lit("Epic"), F.col("p_type"))).otherwise(F.array().cast("array<string>")), summary=F.lit("a\r\nb"))
    b = b.withField("asin", F.when(k % 7 == 0, "").otherwise(_ident(k)))
    written = p.select("p_partkey", tags.written(b, F.when(k % 4 == 0, F.concat(F.lit("id-"), k.cast("string")))).alias("t"))
    out = written.select("p_partkey", "t", tags.book(F.col("t")).alias("b"), tags.hand_tagged_id(tags.folded(F.col("t")), "manual").alias("by_hand"), F.size(tags.without(F.col("t"), "TITLE", "album")).cast("long").alias("others"))
    return out.select("p_partkey", "b.title", F.array_join("b.authors", "|").alias("authors"), F.array_join("b.genres", "|").alias("genres"), "b.asin", "b.series_name", "b.series_position", "b.year", "b.release_date", "b.summary", "by_hand", (F.size("t") - F.col("others")).cast("long").alias("without"))


TAGS_SQL = f"""SELECT p_partkey, p_name AS title, p_brand || '|' || p_type AS authors, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_type WHEN 2 THEN p_type || '|A,B|Epic' ELSE p_type || '|A,B' END AS genres, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE {_ID_SQL} END AS asin,
 CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS series_name, CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '' END AS series_position, '1999' AS "year", CASE WHEN p_partkey % 3 = 0 THEN '1999-12-31' ELSE '1999-01-01' END AS release_date, 'a' || chr(10) || 'b' AS summary,
 CASE WHEN p_partkey % 4 = 0 THEN 'id-' || p_partkey ELSE '' END AS by_hand, CAST(2 AS BIGINT) AS "without" FROM part"""


def real_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    listed = F.array("p_type", F.lit("Audiobook"), F.lit(" AUDIO BOOKS "), F.lit("Other"), F.lit("Unknown"), F.lit("Hörbuch"), F.lit("Books & Spoken"), F.lit("Spoken Word"), F.lit("Speech"))
    return p.select("p_partkey", F.array_join(genres.without_placeholders(listed), "|").alias("genres"))


REAL_SQL = "SELECT p_partkey, p_type || '|Other|Unknown|Speech' AS genres FROM part"


def book_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as books, their lines as files."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pos = F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("int")
    ok = F.col("l_orderkey") % 5 != 0
    files = i.groupBy("l_orderkey", pos.alias("pos")).agg(F.sum("l_quantity").alias("q")).select(
        F.col("l_orderkey").alias("book"), "pos",
        F.concat(F.lit("/lib/Some Book ["), _ident(F.col("l_orderkey")), F.lit("] [uk]/"), F.col("pos").cast("string"), F.when(F.col("pos") % 2 == 0, ".m4b").otherwise(".mp3")).alias("path"),
        F.when(ok, F.col("q") * 61_000).cast("long").alias("duration_ms"), F.create_map(F.lit("title"), F.col("pos").cast("string")).alias("tags"),
    )
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hints = o.select(F.col("o_orderkey").alias("book"), F.concat(F.lit(" Album "), F.col("o_custkey").cast("string")).alias("album"), F.when(F.col("o_orderkey") % 3 == 0, "Various Artists").otherwise(F.concat(F.lit("Author "), F.col("o_custkey").cast("string"))).alias("artist"))
    out = agent.evidence(files, hints)
    return out.select("book", "files", "hint_title", "hint_author", F.try_element_at("tags", F.lit("title")).alias("tag_title"), "runtime_min", "path_asin", "path_region", "name")


EVIDENCE_SQL = """WITH i AS (SELECT l_orderkey k, l_linenumber * 1000 + CAST(l_quantity AS INT) p, sum(l_quantity) q FROM lineitem GROUP BY 1, 2),
 g AS (SELECT k, count(*) n, min(p) a, min(p) FILTER (p % 2 = 0) t, CAST(sum(q * 61000) AS BIGINT) ms FROM i GROUP BY 1)
SELECT k AS book, n AS files, coalesce('Album ' || o_custkey, '') AS hint_title, CASE WHEN o_orderkey IS NULL OR k % 3 = 0 THEN '' ELSE 'Author ' || o_custkey END AS hint_author, CAST(t AS VARCHAR) AS tag_title, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE (ms + 30000) // 60000 END AS BIGINT) AS runtime_min,
 'B' || lpad(CAST(k AS VARCHAR), 9, '0') AS path_asin, 'uk' AS path_region, CASE WHEN n = 1 THEN a || CASE WHEN a % 2 = 0 THEN '.m4b' ELSE '.mp3' END ELSE 'Some Book [B' || lpad(CAST(k AS VARCHAR), 9, '0') || '] [uk]' END AS name FROM g LEFT JOIN orders ON o_orderkey = k"""


def album_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog records under their files' values, where the file is of that record."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    b = _book(title=F.col("p_name"), authors=F.array(F.col("p_brand"), F.lit("X - editor")), narrators=F.array(F.lit("R"), F.lit("R")), series_name=F.when(k % 2 == 0, F.col("p_type")).otherwise(""), series_position=F.lit("4"), year=F.lit("1999"), genres=F.array(F.lit("Romance")), sub_genres=F.array(F.lit("Epic"), F.lit("Romance")), literature_type=F.lit("fiction"), description=F.lit("short"), publisher=F.lit("Press"), cover_url=F.lit("c"))
    f = _book(title=F.when(k % 3 == 0, F.concat(F.lit("File "), "p_name")).otherwise(""), authors=F.array().cast("array<string>"), year=F.when(k % 5 == 0, "2011").otherwise(""), genres=F.when(k % 4 == 0, F.array(F.lit("History"))).when(k % 4 == 1, F.array(F.lit("Mystery, Thriller & Suspense"))).otherwise(F.array().cast("array<string>")), summary=F.when(k % 6 == 0, "from the file").otherwise(""))
    rows = p.select("p_partkey", agent.album_row(b, f, k % 7 != 0, F.when(k % 9 == 0, F.lit("sorted")), F.when(k % 2 == 0, F.lit("4.5")), F.lit(True), F.lit(True)).alias("r"))
    joined = lambda c: F.array_join(f"r.{c}", "|").alias(c)
    return rows.select("p_partkey", "r.title", "r.title_sort", "r.summary", F.col("r.originally_available_at").cast("string").alias("released"), joined("genres"), joined("styles"), joined("moods"), "r.rating", joined("from_file"), "r.collection")


ALBUM_SQL = """WITH p AS (SELECT *, p_partkey k, p_partkey % 7 <> 0 own FROM part), q AS (SELECT *, CASE WHEN own AND k % 3 = 0 THEN 'File ' || p_name ELSE p_name END t, own AND (k % 3 = 0 OR k % 5 = 0 OR k % 6 = 0) ff FROM p)
SELECT p_partkey, t AS title, CASE WHEN ff AND k % 9 = 0 THEN 'sorted' WHEN k % 2 = 0 THEN p_type || ' 4 - ' || t ELSE t END AS title_sort, CASE WHEN own AND k % 6 = 0 THEN 'from the file' ELSE 'short' END AS summary, CASE WHEN own AND k % 5 = 0 THEN '2011-01-01' ELSE '1999-01-01' END AS released,
 CASE WHEN own AND k % 4 = 1 THEN 'Mystery, Thriller & Suspense|' ELSE '' END || 'Romance|Epic' AS genres, 'R' AS styles, p_brand || CASE WHEN k % 2 = 0 THEN '|Series: ' || p_type ELSE '' END AS moods, CASE WHEN k % 2 = 0 THEN 9.0::DOUBLE END AS rating,
 concat_ws('|', CASE WHEN own AND k % 3 = 0 THEN 'title' END, CASE WHEN own AND k % 5 = 0 THEN 'release' END, CASE WHEN own AND k % 6 = 0 THEN 'description' END) AS from_file, CASE WHEN k % 2 = 0 THEN p_type ELSE '' END AS collection FROM q"""


def hand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums tagged by hand, artists, and the rows a search lists."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    f = _book(title=F.when(k % 4 == 0, "").otherwise(F.col("p_name")), authors=F.array(F.concat("p_brand", F.lit(" Lee"))), narrators=F.array(F.lit("Ann Bo Cox")), series_name=F.col("p_type"), series_position=F.when(k % 2 == 0, "7").otherwise(""), release_date=F.lit("2020-02-30"), year=F.lit("2020"), genres=F.array(F.lit("Horror"), F.lit(" Horror")))
    album = agent.manual_album_row(f, F.lit(""), F.when(k % 3 == 0, F.lit(b"abc")), F.lit(False), F.lit(False))
    row = agent.manual_row(f, F.concat(F.lit("local_"), k.cast("string")), F.lit("Hint"), F.lit(125))
    artist = agent.artist_row(F.concat("p_brand", F.lit(" Ann Lee Jr.")), F.lit("d"), F.array(F.lit("a"), F.lit(" a ")), F.lit("i"), k % 2 == 0)
    out = p.select("p_partkey", album.alias("m"), row.alias("r"), artist.alias("a"))
    return out.select("p_partkey", "m.title_sort", F.col("m.originally_available_at").cast("string").alias("released"), F.array_join("m.genres", "|").alias("genres"), F.array_join("m.moods", "|").alias("moods"), "m.cover_key", F.col("r.id").alias("row_id"), F.col("r.name").alias("row_name"), F.col("r.year").cast("long").alias("row_year"), F.col("a.title_sort").alias("artist_sort"), F.array_join("a.genres", "|").alias("artist_genres"))


HAND_SQL = """WITH p AS (SELECT *, p_partkey k FROM part)
SELECT p_partkey, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN p_type || ' 7 - ' || p_name ELSE p_name END AS title_sort, CASE WHEN k % 4 <> 0 THEN '2020-01-01' END AS released, CASE WHEN k % 4 <> 0 THEN 'Horror' END AS genres, CASE WHEN k % 4 <> 0 THEN 'Series: ' || p_type END AS moods,
 CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 0 THEN 'embedded-a9993e364706816aba3e25717850c26c9cd0d89d' ELSE '' END AS cover_key, 'local_' || k AS row_id, CASE WHEN k % 4 = 0 THEN 'Hint' ELSE p_name END || ' · ' || left(p_brand, 1) || '.Lee · A.B.Cox · 2h05m (tagged by hand)' AS row_name, CAST(2020 AS BIGINT) AS row_year,
 CASE WHEN k % 2 = 0 THEN 'Lee, ' || p_brand || ' Ann, Jr.' ELSE p_brand || ' Ann Lee Jr.' END AS artist_sort, 'a' AS artist_genres FROM p"""


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    r = F.struct(_ident(k).alias("asin"), F.when(k % 2 == 0, "de").otherwise("").alias("region"), F.concat("p_name", F.lit(" and the very long story of one "), "p_type").alias("title"), F.array(F.concat(F.lit("Ann "), "p_brand")).alias("authors"), F.array().cast("array<string>").alias("narrators"), F.when(k % 3 == 0, "x").otherwise("2001-05").alias("year"), (F.col("p_size") * 10).cast("int").alias("runtime_min"))
    out = p.select("p_partkey", agent.result_row(r, (F.col("p_size") * 10 + k % 3).cast("int"), F.lit(50)).alias("r"))
    return out.select("p_partkey", "r.id", "r.name", F.col("r.year").cast("long").alias("year"))


RESULT_SQL = f"""WITH p AS (SELECT *, p_partkey k, p_name || ' and the very long story of one ' || p_type t, p_size * 10 m, p_partkey % 3 d, p_size * 10 + p_partkey % 3 l FROM part)
SELECT p_partkey, {_ID_SQL} || CASE WHEN k % 2 = 0 THEN '_de' ELSE '_us' END AS id, CASE WHEN length(t) > 40 THEN rtrim(left(t, 38)) || '…' ELSE t END || ' · A.' || p_brand || ' · ' || m // 60 || 'h' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || 'm' ||
 CASE WHEN d <= 1 OR d / l::DOUBLE <= 0.005 THEN ' ✓' WHEN d / l::DOUBLE <= 0.02 THEN ' ≈' WHEN d / l::DOUBLE <= 0.05 THEN ' ~' ELSE ' ≠' END AS name, CASE WHEN k % 3 <> 0 THEN 2001 END AS "year" FROM p"""


def manual_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as candidate lists: purchases are a book's own claims, repeats of an id fall out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("user_id", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("source"), F.col("event_id").alias("pos"), (F.col("event_id") % 40).alias("asin"), F.floor("value").cast("int").alias("score"))
    return agent.listing(rows, "user_id").select("user_id", "asin", F.col("shown").cast("long").alias("shown"))


LISTING_SQL = """WITH r AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END s, event_id p, event_id % 40 a, CAST(floor("value") AS INT) v FROM events), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, a ORDER BY s, p) = 1),
 w AS (SELECT *, CASE WHEN s = 0 THEN 100 ELSE greatest(1, least(99, v)) END w, row_number() OVER (PARTITION BY user_id ORDER BY s, p) i FROM o)
SELECT user_id, a AS asin, CAST(greatest(1, min(w + i) OVER (PARTITION BY user_id ORDER BY i) - i) AS BIGINT) AS shown FROM w"""


def collection_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    existing = F.when(k % 3 == 0, F.array(F.lit("A & B"))).when(k % 3 == 1, F.array(F.upper("p_type"))).otherwise(F.array().cast("array<string>"))
    url = agent.collection_url("http://127.0.0.1:32400", F.when(k % 5 == 0, "").otherwise("2"), k.cast("string"), existing, F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")))
    return p.select("p_partkey", url.alias("url"))


COLLECTION_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 1 THEN 'http://127.0.0.1:32400/library/sections/2/all?type=9&id=' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '&collection%5B0%5D.tag.tag=A%20%26%20B&collection%5B1%5D.tag.tag=' ELSE '&collection%5B0%5D.tag.tag=' END || url_encode(lower(p_type)) || '&collection.locked=1' END AS url FROM part"""


def decoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    raw = F.concat("p_name", F.lit(" &rarr; &#233;&#xE9; &copy2024 &notit; &amp;lt; &nosuch; &#128; &#0; &#x1F600; & &Eacute;t&eacute; AT&T"))
    return p.select("p_partkey", entities.unescape(raw).alias("t"), text.html_text(F.concat(F.lit("<p>"), "p_name", F.lit("</p>&frac12;<br>&hearts;"))).alias("h"))


REFERENCES_SQL = """SELECT p_partkey, p_name || ' → éé ©2024 ¬it; &lt; &nosuch; € ' || chr(65533) || ' 😀 & Été AT&T' AS t, p_name || chr(10) || chr(10) || '½' || chr(10) || chr(10) || '♥' AS h FROM part"""


def joiner_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A joiner's file list, a chapter text and a fingerprint for each order."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = i.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"))
    names = one.withColumn("p", F.concat(F.lit("it's "), F.col("l_linenumber").cast("string")))
    lists = names.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p")).alias("p"))
    signed = paths.signature(names.select("l_orderkey", F.col("p").alias("rel_path"), F.col("q").alias("size"), F.timestamp_millis(F.col("q") * 1000).alias("mtime")), "l_orderkey")
    return lists.join(signed, "l_orderkey").select("l_orderkey", F.md5(tables.concat_list(F.col("p"))).alias("list"), "signature")


JOINER_SQL = """WITH o AS (SELECT l_orderkey, l_linenumber n, CAST(max(l_quantity) AS BIGINT) q FROM lineitem GROUP BY 1, 2), p AS (SELECT *, 'it''s ' || n p FROM o)
SELECT l_orderkey, md5(string_agg('file ''' || replace(p, '''', '''\\''''') || '''' || chr(10), '' ORDER BY p)) AS "list", sha256(string_agg(p || ':' || q || ':' || q * 1000, '|' ORDER BY p || ':' || q || ':' || q * 1000)) AS signature FROM p GROUP BY 1"""


def chapter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved chapters as a job stores them, and read back; what cannot be read is as if it were not there."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey")
    made = F.struct(F.lit("files").alias("source"), F.array(F.struct(F.col("p_name").alias("title"), (k * 1000).alias("start_ms"), k.alias("length_ms"))).alias("chapters"))
    stored = F.when(k % 5 == 0, "{broken").otherwise(chapters.as_json(made))
    back = chapters.from_json(stored)
    return p.select("p_partkey", F.when(k % 5 != 0, stored).alias("stored"), back["source"].alias("source"), F.try_element_at(back["chapters"], F.lit(1))["start_ms"].alias("start_ms"))


CHAPTER_JSON_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN '{"source":"files","chapters":[{"title":"' || p_name || '","start_ms":' || p_partkey * 1000 || ',"length_ms":' || p_partkey || '}]}' END AS stored, CASE WHEN p_partkey % 5 <> 0 THEN 'files' END AS source, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 1000 END AS start_ms FROM part"""


def covers_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    base = F.concat(F.lit("https://m.media-amazon.com/images/I/"), F.col("p_partkey").cast("string"))
    c = lambda end: payloads.cover_at(F.concat(base, F.lit(end)), 500)
    return p.select("p_partkey", c(".jpg").alias("plain"), c("._AC_SX342_.jpg").alias("sized"), c(".png").alias("other"))


COVER_SQL = """SELECT p_partkey, 'https://m.media-amazon.com/images/I/' || p_partkey || '._SL500_.jpg' AS plain, 'https://m.media-amazon.com/images/I/' || p_partkey || '._SL500_.jpg' AS sized, 'https://m.media-amazon.com/images/I/' || p_partkey || '.png' AS other FROM part"""


QUERIES = {
    "form_check": (form_check, FORM_SQL),
    "form_round_trip": (form_round_trip, ROUND_SQL),
    "form_prompt": (form_prompt, PROMPT_SQL),
    "tag_round_trip": (tag_round_trip, TAGS_SQL),
    "real_genres": (real_genres, REAL_SQL),
    "book_evidence": (book_evidence, EVIDENCE_SQL),
    "album_rows": (album_rows, ALBUM_SQL),
    "hand_tagged_rows": (hand_rows, HAND_SQL),
    "result_rows": (result_rows, RESULT_SQL),
    "manual_listing": (manual_listing, LISTING_SQL),
    "collection_urls": (collection_urls, COLLECTION_SQL),
    "character_references": (decoded_references, REFERENCES_SQL),
    "joiner_lists": (joiner_lists, JOINER_SQL),
    "chapter_json": (chapter_json, CHAPTER_JSON_SQL),
    "cover_sizes": (covers_sized, COVER_SQL),
}
