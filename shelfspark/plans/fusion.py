"""Fusion and category queries: per user, the latest signup is the primary record, the latest purchase the secondary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fuse, genres

KINDS = {"anvil": "fiction", "bolt": "nonfiction"}


def _book(id_col: Column, v: Column, fill: int) -> Column:
    """A record with holes: each field is unknown where the id has a certain remainder."""
    hole = lambda n, c: F.when(id_col % n == fill % n, "").otherwise(c)
    empty = F.array().cast("array<string>")
    s = id_col.cast("string")
    return F.struct(
        hole(3, F.concat(F.lit(f"t{fill}-"), s)).alias("title"),
        F.lit("").alias("subtitle"),
        F.when(id_col % 5 == fill % 5, empty).otherwise(F.array(F.concat(F.lit("a"), s), F.lit("b"))).alias("authors"),
        empty.alias("narrators"),
        hole(4, F.concat(F.lit(f"s{fill}-"), s)).alias("series_name"),
        F.concat(F.lit("#"), F.lit(str(fill))).alias("series_position"),
        hole(2, F.lit(f"20{10 + fill}")).alias("year"),
        F.lit("").alias("release_date"),
        hole(7, F.lit(f"pub{fill}")).alias("publisher"),
        F.lit("english").alias("language"),
        F.array(F.lit(f"g{fill}")).alias("genres"),
        empty.alias("sub_genres"),
        F.array().cast("array<array<string>>").alias("genre_paths"),
        F.lit("").alias("literature_type"),
        F.concat(F.lit(f"d{fill}-"), s).alias("description"),
        hole(2, F.concat(F.lit(f"sum{fill}-"), s)).alias("summary"),
        v.cast("int").alias("runtime_min"),
        F.lit("").alias("cover_url"),
    )


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = e.where("event_type in ('signup', 'purchase')").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    books = last.select("user_id", F.when(F.col("event_type") == "signup", fuse.PRIMARY).otherwise(fuse.SECONDARY).alias("source"), F.when(F.col("event_type") == "signup", _book(F.col("x.event_id"), F.col("x.value"), 0)).otherwise(_book(F.col("x.event_id"), F.col("x.value"), 1)).alias("book"))
    return fuse.by_source(books, ["user_id"])


_SIDES_SQL = """
 l AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) i, arg_max("value", (ts, event_id)) v FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2),
 b AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 0 ELSE 1 END f, i, v FROM l),
 r AS (SELECT user_id, f, CASE WHEN i % 3 = f % 3 THEN '' ELSE 't' || f || '-' || i END title, CASE WHEN i % 5 = f % 5 THEN '' ELSE 'a' || i || ', b' END authors,
   CASE WHEN i % 4 = f % 4 THEN '' ELSE 's' || f || '-' || i || ' ##' || f END series, CASE WHEN i % 2 = f % 2 THEN '' ELSE '20' || (10 + f) END rel,
   CASE WHEN i % 7 = f % 7 THEN '' ELSE 'pub' || f END pub, 'd' || f || '-' || i dsc, CASE WHEN i % 2 = f % 2 THEN '' ELSE 'sum' || f || '-' || i END summ, CAST(trunc(v) AS INT) rt FROM b),
 p AS (SELECT * FROM r WHERE f = 0), s AS (SELECT * FROM r WHERE f = 1),
 j AS (SELECT coalesce(p.user_id, s.user_id) user_id, coalesce(p.title, '') pt, coalesce(s.title, '') st, coalesce(p.authors, '') pa, coalesce(s.authors, '') sa, coalesce(p.series, '') ps, coalesce(s.series, '') ss,
   coalesce(p.rel, '') pr, coalesce(s.rel, '') sr, coalesce(p.pub, '') pp, coalesce(s.pub, '') sp, coalesce(p.dsc, '') pd, coalesce(s.dsc, '') sd, coalesce(p.summ, '') pm, coalesce(s.summ, '') sm,
   coalesce(p.rt, 0) prt, coalesce(s.rt, 0) srt, p.user_id IS NOT NULL hp, s.user_id IS NOT NULL hs FROM p FULL JOIN s ON p.user_id = s.user_id)
"""


def fuse_sources(spark: SparkSession, sf_dir: str, overrides: Column | None = None) -> DataFrame:
    out = fuse.merged(_sides(spark, sf_dir), overrides=overrides)
    v = lambda f: fuse.display_value(F.col("book"), f).alias(f)
    src = lambda f: F.coalesce(F.try_element_at("sources", F.lit(f)), F.lit("")).alias(f"{f}_from")
    fields = ("title", "authors", "series", "release", "publisher", "description", "runtime_min", "genres")
    return out.select("user_id", *[v(f) for f in fields], *[src(f) for f in fields])


def _pick(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' THEN {a} ELSE {b} END"


def _from(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' THEN 'primary' WHEN {b} <> '' THEN 'secondary' ELSE '' END"


FUSE_SQL = f"""WITH {_SIDES_SQL}
SELECT user_id, {_pick("pt", "st")} AS title, {_pick("pa", "sa")} AS authors, {_pick("ps", "ss")} AS series, {_pick("pr", "sr")} AS "release", {_pick("pp", "sp")} AS publisher,
 CASE WHEN pm <> '' THEN pm WHEN sm <> '' THEN sm WHEN hp THEN pd ELSE sd END AS description, CASE WHEN prt <> 0 THEN prt || ' min' WHEN srt <> 0 THEN srt || ' min' ELSE '' END AS runtime_min,
 CASE WHEN hs THEN 'g1' ELSE 'g0' END AS genres,
 {_from("pt", "st")} AS title_from, {_from("pa", "sa")} AS authors_from, {_from("ps", "ss")} AS series_from, {_from("pr", "sr")} AS release_from, {_from("pp", "sp")} AS publisher_from,
 CASE WHEN pm <> '' THEN 'primary' WHEN sm <> '' THEN 'secondary' WHEN hp THEN 'primary' ELSE 'secondary' END AS description_from,
 CASE WHEN prt <> 0 THEN 'primary' WHEN srt <> 0 THEN 'secondary' ELSE '' END AS runtime_min_from, CASE WHEN hs THEN 'secondary' ELSE 'primary' END AS genres_from FROM j"""


def fuse_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = F.create_map(F.lit("title"), F.when(F.col("user_id") % 2 == 0, fuse.SECONDARY).otherwise(""), F.lit("publisher"), F.lit(fuse.SECONDARY))
    return fuse_sources(spark, sf_dir, choice).select("user_id", "title", "publisher", "title_from", "publisher_from", "series")


OVERRIDES_SQL = f"""WITH {_SIDES_SQL}
SELECT user_id, CASE WHEN user_id % 2 = 0 AND st <> '' THEN st ELSE {_pick("pt", "st")} END AS title, {_pick("sp", "pp")} AS publisher,
 CASE WHEN user_id % 2 = 0 AND st <> '' THEN 'secondary' ELSE {_from("pt", "st")} END AS title_from, CASE WHEN sp <> '' THEN 'secondary' WHEN pp <> '' THEN 'primary' ELSE '' END AS publisher_from, {_pick("ps", "ss")} AS series FROM j"""


def field_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fuse.comparison(fuse.merged(_sides(spark, sf_dir)), "user_id", {s: F.col(s) for s in fuse.ORDER}, F.col("sources"))
    return rows.where(F.col("field").isin("title", "publisher", "runtime_min")).select("user_id", "field", "primary", "secondary", "winner", "differs")


COMPARE_SQL = f"""WITH {_SIDES_SQL},
 u AS (SELECT user_id, 'title' field, pt a, st b FROM j UNION ALL SELECT user_id, 'publisher', pp, sp FROM j
   UNION ALL SELECT user_id, 'runtime_min', CASE WHEN prt <> 0 THEN prt || ' min' ELSE '' END, CASE WHEN srt <> 0 THEN srt || ' min' ELSE '' END FROM j)
SELECT user_id, field, a AS "primary", b AS "secondary", CASE WHEN a <> '' THEN 'primary' ELSE 'secondary' END AS winner, (a <> '' AND b <> '' AND a <> b) AS differs FROM u WHERE a <> '' OR b <> ''"""


def fuse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = lambda c: F.when(c % 5 == 0, "error").when(c % 3 == 0, "not_found").otherwise("ok")
    s = fuse.fetch_status(name(F.col("event_id")), name(F.col("event_id") + F.col("user_id")))
    return e.select("event_id", s["status"].alias("status"), F.array_join(s["notes"], "; ").alias("notes"))


STATUS_SQL = """WITH n AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'not_found' ELSE 'ok' END p,
  CASE WHEN (event_id + user_id) % 5 = 0 THEN 'error' WHEN (event_id + user_id) % 3 = 0 THEN 'not_found' ELSE 'ok' END s FROM events),
 t AS (SELECT *, CASE WHEN p = 'error' THEN 'error' WHEN p = 'ok' OR s = 'ok' THEN 'ok' WHEN s = 'error' THEN 'error' ELSE 'not_found' END st FROM n)
SELECT event_id, st AS status, CASE WHEN st = 'ok' THEN concat_ws('; ', CASE p WHEN 'not_found' THEN 'not in primary' END, CASE s WHEN 'error' THEN 'secondary unavailable' WHEN 'not_found' THEN 'not in secondary' END) ELSE '' END AS notes FROM t"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand and size, its parts' (type, first word, last word) as category paths, in key order."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.split("p_name", " ")
    item = F.struct("p_partkey", F.array("p_type", words[0], F.element_at(words, -1)).alias("path"))
    grouped = p.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return grouped.select("p_brand", "p_size", F.transform("x", lambda i: i["path"]).alias("paths"))


def _kinds() -> dict[str, str]:
    return {"ECONOMY": "fiction", "STANDARD": "nonfiction", "PROMO": "fiction", "SMALL": "nonfiction"}


def genre_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _paths(spark, sf_dir)
    none = F.array().cast("array<string>")
    clean = genres.cleaned(F.lit(""), none, none, F.col("paths"), _kinds())
    kind = genres.record_kind(F.lit(""), F.col("paths"), _kinds())
    return b.select("p_brand", "p_size", kind.alias("kind"), F.array_join(clean["genres"], "|").alias("genres"), F.array_join(clean["sub_genres"], "|").alias("sub_genres"))


GENRES_SQL = """WITH k(n, kind) AS (VALUES ('ECONOMY', 'fiction'), ('STANDARD', 'nonfiction'), ('PROMO', 'fiction'), ('SMALL', 'nonfiction')),
 x AS (SELECT p_brand, p_size, p_partkey, p_type g, split_part(p_name, ' ', 1) s1, split_part(p_name, ' ', -1) s2, coalesce(kind, '') kind FROM part LEFT JOIN k ON n = p_type),
 v AS (SELECT p_brand, p_size, count(*) FILTER (kind = 'fiction') f, count(*) FILTER (kind = 'nonfiction') nf FROM x GROUP BY 1, 2),
 kk AS (SELECT p_brand, p_size, CASE WHEN f > nf THEN 'fiction' WHEN nf > f THEN 'nonfiction' ELSE '' END kind FROM v),
 s AS (SELECT x.p_brand, x.p_size, g, count(*) c, min(p_partkey) mp, any_value(x.kind) gk, any_value(kk.kind) kind FROM x JOIN kk USING (p_brand, p_size) GROUP BY 1, 2, 3),
 a AS (SELECT *, (kind <> '' AND gk <> '' AND gk <> kind) bad FROM s),
 keep AS (SELECT * FROM (SELECT *, bool_and(bad) OVER (PARTITION BY p_brand, p_size) allbad FROM a) WHERE allbad OR NOT bad),
 g AS (SELECT p_brand, p_size, g, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY c DESC, mp) r FROM keep),
 w AS (SELECT p_brand, p_size, r, p_partkey, 1 o, s1 w FROM x JOIN g USING (p_brand, p_size, g) UNION ALL SELECT p_brand, p_size, r, p_partkey, 2, s2 FROM x JOIN g USING (p_brand, p_size, g)),
 f AS (SELECT p_brand, p_size, w, min((r, p_partkey, o)) o FROM w WHERE w <> '' GROUP BY 1, 2, 3),
 fs AS (SELECT p_brand, p_size, string_agg(w, '|' ORDER BY o) subs FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.p_brand = f.p_brand AND g.p_size = f.p_size AND g.g = f.w) GROUP BY 1, 2),
 gs AS (SELECT p_brand, p_size, string_agg(g, '|' ORDER BY r) gen FROM g GROUP BY 1, 2)
SELECT p_brand, p_size, kind, gen AS genres, coalesce(subs, '') AS sub_genres FROM gs JOIN kk USING (p_brand, p_size) LEFT JOIN fs USING (p_brand, p_size)"""


def genre_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _paths(spark, sf_dir)
    return b.groupBy("p_brand").agg(F.count_if(genres.record_kind(F.lit(""), F.col("paths"), _kinds()) == "fiction").alias("fiction"), F.count_if(genres.record_kind(F.lit(""), F.col("paths"), _kinds()) == "nonfiction").alias("nonfiction"))


MAJORITY_SQL = """WITH v AS (SELECT p_brand, p_size, count(*) FILTER (p_type IN ('ECONOMY', 'PROMO')) f, count(*) FILTER (p_type IN ('STANDARD', 'SMALL')) nf FROM part GROUP BY 1, 2)
SELECT p_brand, count(*) FILTER (f > nf) AS fiction, count(*) FILTER (nf > f) AS nonfiction FROM v GROUP BY 1"""


def file_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir).where("primary is not null and secondary is not null")
    over = fuse.overlaid(F.col("primary"), F.col("secondary"), F.col("user_id") % 2 == 0, ("title", "publisher", "authors"))
    lead = genres.file_genre_leads(F.array(F.lit("x"), F.lit("g1")), F.lit("g1"), F.lit(""), F.array().cast("array<array<string>>"))
    return sides.select("user_id", over["title"].alias("title"), over["publisher"].alias("publisher"), F.array_join(over["authors"], ", ").alias("authors"), F.array_join(lead, "|").alias("genres"))


OVERLAY_SQL = f"""WITH {_SIDES_SQL}
SELECT user_id, CASE WHEN user_id % 2 = 0 AND st <> '' THEN st ELSE pt END AS title, CASE WHEN user_id % 2 = 0 AND sp <> '' THEN sp ELSE pp END AS publisher,
 CASE WHEN user_id % 2 = 0 AND sa <> '' THEN sa ELSE pa END AS authors, 'g1|x' AS genres FROM j WHERE hp AND hs"""


QUERIES = {
    "fuse_sources": (fuse_sources, FUSE_SQL),
    "fuse_overrides": (fuse_overrides, OVERRIDES_SQL),
    "field_compare": (field_compare, COMPARE_SQL),
    "fuse_status": (fuse_status, STATUS_SQL),
    "genre_cleanup": (genre_cleanup, GENRES_SQL),
    "genre_majority": (genre_majority, MAJORITY_SQL),
    "file_overlay": (file_overlay, OVERLAY_SQL),
}
