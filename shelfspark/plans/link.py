"""Linkage queries over ``part``, ``customer`` and ``supplier``.

Hints are all parts (title p_name, author p_brand, runtime 10 x p_size, language p_type); a
hint's candidates are the 25 parts of its type that are nearest by key, which is the
relevance order a catalog would return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import match

CANDIDATES = 25
#: Places on either side that ``top_candidates`` looks at without a join.
NEAR = 128
#: Places of a type that one group of ``_near`` takes, besides its reach of its neighbours' at either end.
BLOCK = 1000
#: What ranks the candidates of a hint: with its block, so that rows stay where ``_near`` made them.
HINT = ["hint_language", "block", "q_id"]
#: What scoring takes of a hint: ``t`` and ``a`` are its folded title and author.
HELD = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "t", "a"]
RUNTIME = "cast(p_size * 10 + p_partkey % 3 - 1 as int) as runtime_min"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their place in the key order of their type."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").where("p_type is not null")
    return part.withColumn("b", F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey")))


def _near(spark: SparkSession, part: DataFrame, candidate: Column, reach: int) -> DataFrame:
    """Parts, each with its ``reach`` nearest of its type by key, nearest first. They are nearest by place in the key order too, so
    they are among ``reach`` places on either side: a window over blocks of places, each with its neighbours' edges. Nothing is
    joined, so no side of a join can be taken for small by the size of its file."""
    blocks = F.sequence(F.floor((F.col("b") - reach) / BLOCK), F.floor((F.col("b") + reach) / BLOCK))
    # as many parts as the session shuffles into: rows grow by ``reach`` after this, which their size before does not tell
    dealt = part.withColumn("block", F.explode(blocks)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_type", "block")
    around = F.collect_list(candidate).over(Window.partitionBy("p_type", "block").orderBy("b").rowsBetween(-reach, reach))
    near = F.sort_array(F.transform("around", lambda c: F.struct(F.abs(c["c_id"] - F.col("p_partkey")).alias("d"), c["c_id"].alias("c_id"), c.alias("c"))))
    home = dealt.withColumn("around", around).where(F.col("block") == F.floor(F.col("b") / BLOCK))
    return home.withColumn("near", F.slice(near, 1, reach)).drop("around")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hint and candidate rows: the ``CANDIDATES`` nearest by key."""
    candidate = F.struct(F.col("p_partkey").alias("c_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.expr(RUNTIME))
    home = _near(spark, _parts(spark, sf_dir), candidate, CANDIDATES)
    hint = [F.col("p_partkey").alias("q_id"), F.col("p_name").alias("hint_title"), F.col("p_brand").alias("hint_author"), (F.col("p_size") * 10).alias("hint_runtime"), F.col("p_type").alias("hint_language"), "block"]
    pairs = home.select(*hint, F.posexplode("near").alias("pos", "near"))
    return pairs.select("q_id", "hint_title", "hint_author", "hint_runtime", "hint_language", "block", "near.c.*", F.col("hint_language").alias("language"), "pos")


def _score(c: Column, pos: Column) -> Column:
    """The score of a candidate struct for the part of the row; their types are equal."""
    title = F.when(F.col("p_name") != "", text.fuzzy_distance(F.col("t"), c["t"]))
    author = F.when(F.col("p_brand") != "", F.levenshtein("a", c["a"]))
    return match.points(title, author, pos, _band(c))


def _band(c: Column) -> Column:
    return match.runtime_band(c["runtime_min"], F.col("p_size") * 10)


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates of each part among all of its type. A score falls by one a place, so from ``BEST`` less the least of the
    first ``CANDIDATES``' best on, no place can hold one of the best: a part looks as far as that, however far it is. A window
    finds what lies within ``NEAR`` places, ``_far`` the rest."""
    folded = {"t": text.folded_lower(F.col("p_name")), "a": text.folded_lower(F.col("p_brand"))}
    part = _parts(spark, sf_dir).withColumns(folded).withColumn("c", F.struct(F.col("p_partkey").alias("c_id"), "t", "a", F.expr(RUNTIME), F.col("b").alias("place")))
    first = F.transform(F.slice("near", 1, CANDIDATES), lambda n, i: _score(n["c"], i))
    # null where a type has fewer parts than are wanted: all of them are near
    least = F.get(F.sort_array(first, asc=False), F.lit(match.MAX_ROWS - 1))
    reach = lambda least: F.coalesce(match.BEST - least, F.lit(NEAR))

    def within(x: Column) -> Column:
        # what the running time alone rules out needs no distances
        hopeful = lambda n, i: x.isNull() | (match.points(F.lit(0), F.lit(0), i, _band(n["c"])) >= x)
        tried = F.transform(F.slice("near", F.lit(1), reach(x)), lambda n, i: F.struct(i.alias("pos"), n["c"].alias("c"), F.when(hopeful(n, i), _score(n["c"], i)).alias("score")))
        return F.when(reach(x) <= NEAR, F.filter(tried, lambda s: s["score"].isNotNull() & (x.isNull() | (s["score"] >= x))))

    home = _near(spark, part, F.col("c"), NEAR).select(*HELD, "block", F.explode(text.let(least, within)).alias("s"))
    near = match.top(home.select(*HELD, "block", "s.*"), ["p_type", "block", "p_partkey"])

    beyond = _near(spark, part, F.col("c"), CANDIDATES).withColumn("least", least).where(reach(F.col("least")) > NEAR)
    far = match.top(_far(part, beyond.select(*HELD, "b", "least")), ["p_type", "p_partkey"])
    best = near.select(*HELD, "c", "score", "rank").unionByName(far.select(*HELD, "c", "score", "rank"))
    return best.select(F.col("p_partkey").alias("q_id"), "c.c_id", "score", "rank", _band(F.col("c")).alias("band"))


def _far(part: DataFrame, hints: DataFrame) -> DataFrame:
    """Candidates of ``hints`` (with place b, and the least score) that reach the least score, however many places off: by a join on
    blocks. A place in the order of distance is a count of keys up to the candidate's mirror image about the hint, told by a running count
    over keys and images of those candidates that could reach the score at a place no nearer than that in the key order."""
    reach, off = match.BEST - F.col("least"), F.abs(F.col("c.place") - F.col("b"))
    blocks = F.sequence(F.floor(F.greatest(F.col("b") - reach, F.lit(0)) / BLOCK), F.floor((F.col("b") + reach) / BLOCK))
    others = part.select("p_type", F.floor(F.col("b") / BLOCK).alias("block"), "c")
    met = hints.withColumn("block", F.explode(blocks)).join(others.hint("merge"), ["p_type", "block"]).where(off < reach)
    met = met.where(_score(F.col("c"), off) >= F.col("least"))
    images = met.select("p_type", (2 * F.col("p_partkey") - F.col("c.c_id")).alias("key"), F.lit(0).alias("n"), F.struct(*HELD, "b", "c", "least").alias("m"))
    keys = part.select("p_type", F.col("p_partkey").alias("key"), F.lit(1).alias("n"))
    below = F.sum("n").over(Window.partitionBy("p_type").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, 0))
    counted = images.unionByName(keys, allowMissingColumns=True).withColumn("below", below).where("n = 0").select("m.*", "below")
    pos = F.when(F.col("c.place") >= F.col("b"), F.col("c.place") - 1 - F.col("below")).otherwise(F.col("below") - F.col("c.place"))
    return counted.withColumn("pos", pos.cast("int")).withColumn("score", _score(F.col("c"), F.col("pos"))).where("score >= least")


_NEAR_SQL = """
  hints AS (SELECT p_partkey q_id, p_name hint_title, p_brand hint_author, p_size * 10 hint_runtime, p_type hint_language FROM part),
  near AS (
    SELECT h.*, c.p_partkey c_id, c.p_name title, c.p_brand author, c.p_size * 10 + c.p_partkey % 3 - 1 runtime_min, c.p_type "language",
           row_number() OVER (PARTITION BY q_id ORDER BY abs(c.p_partkey - q_id), c.p_partkey) - 1 pos
    FROM hints h JOIN part c ON c.p_type = h.hint_language),
"""
_SCORED_SQL = """
  parts AS (
    SELECT *, lower(hint_title) ht, lower(title) ct, abs(runtime_min - hint_runtime) ad, abs(runtime_min - hint_runtime) / hint_runtime::DOUBLE pct FROM pairs),
  terms AS (
    SELECT *, CASE WHEN octet_length(encode(ht)) >= 4 AND contains(ct, ht) THEN least(levenshtein(ht, ct), (strlen(ct) - strlen(ht)) // 8 + 1) ELSE levenshtein(ht, ct) END dist,
           CASE WHEN runtime_min <= 0 THEN '' WHEN ad <= 1 OR pct <= 0.005 THEN 'exact' WHEN pct <= 0.02 THEN 'close' WHEN pct <= 0.05 THEN 'near' ELSE 'off' END band,
           CASE WHEN runtime_min <= 0 THEN 0 WHEN ad <= 1 OR pct <= 0.005 THEN 25 WHEN pct <= 0.02 THEN 12 WHEN pct <= 0.05 THEN 3 WHEN pct <= 0.15 THEN -12 ELSE -30 END points
    FROM parts),
  scored AS (
    SELECT *, 100 - 2 * dist - 10 * levenshtein(lower(hint_author), lower(author)) - pos + points - CASE WHEN lower(hint_language) = lower("language") THEN 0 ELSE 25 END score FROM terms),
  ranked AS (
    SELECT *, row_number() OVER w AS "rank", lead(score) OVER w next_score, lead(band) OVER w next_band
    FROM scored WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, pos))
"""
_PAIRS_SQL = f"{_NEAR_SQL}  pairs AS (SELECT * FROM near WHERE pos < {CANDIDATES}),{_SCORED_SQL}"


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir)
    return best.select("q_id", "c_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("place"), F.col("band.band").alias("runtime_band"), F.col("band.delta").cast("long").alias("runtime_delta"))


TOP_SQL = f"""WITH {_NEAR_SQL}  pairs AS (SELECT * FROM near),{_SCORED_SQL}
SELECT q_id, c_id, CAST(score AS BIGINT) AS score, CAST("rank" AS BIGINT) AS place, band AS runtime_band, CAST(CASE WHEN runtime_min <= 0 THEN 0 ELSE runtime_min - hint_runtime END AS BIGINT) AS runtime_delta
FROM ranked WHERE "rank" <= {match.MAX_ROWS}"""


def auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match.accepted(match.ranked(match.scored(_pairs(spark, sf_dir)), HINT))
    return out.select("q_id", "c_id", "accepted")


AUTO_SQL = f"""WITH {_PAIRS_SQL}
SELECT q_id, c_id, (band = 'exact' AND lower(hint_language) = lower("language") AND dist <= 2 AND (next_score IS NULL OR (score - next_score >= 15 AND next_band <> 'exact'))) AS accepted
FROM ranked WHERE "rank" = 1"""


def lenient_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match.leniently_accepted(match.ranked(match.scored(_pairs(spark, sf_dir)), HINT))
    return out.select("q_id", "c_id", "accepted")


LENIENT_SQL = f"""WITH {_PAIRS_SQL}
SELECT q_id, c_id, (band <> 'off' AND lower(hint_language) = lower("language") AND dist <= 2 AND levenshtein(lower(hint_author), lower(author)) <= 2 AND (next_score IS NULL OR score - next_score >= 15)) AS accepted
FROM ranked WHERE "rank" = 1"""


def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = match.top(match.scored(_pairs(spark, sf_dir)), HINT)
    sure = F.col("score") >= 120
    return best.select("q_id", "c_id", match.display_score(F.col("rank"), F.col("score"), sure).cast("long").alias("shown"))


DISPLAY_SQL = f"""WITH {_PAIRS_SQL}
SELECT q_id, c_id, CAST(CASE WHEN score >= 120 AND "rank" = 1 THEN 100 ELSE least(76 - "rank", greatest(1, least(99, score))) END AS BIGINT) AS shown
FROM ranked WHERE "rank" <= {match.MAX_ROWS}"""


def runtime_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.col("l_quantity").cast("int").alias("q"))
    usual = items.groupBy("l_partkey").agg(F.max("q").alias("most"))
    b = match.runtime_band(F.col("q"), F.col("most"))
    return items.join(usual, "l_partkey").select(b.alias("b")).groupBy(F.col("b.band").alias("band"), F.col("b.points").cast("long").alias("points")).agg(F.count("*").alias("n"), F.sum("b.delta").cast("long").alias("delta"))


BANDS_SQL = """WITH i AS (SELECT l_partkey, CAST(l_quantity AS INT) q FROM lineitem), m AS (SELECT l_partkey, max(q) most FROM i GROUP BY 1),
 d AS (SELECT q - most delta, abs(q - most) ad, abs(q - most) / most::DOUBLE pct FROM i JOIN m USING (l_partkey)),
 b AS (SELECT delta, CASE WHEN ad <= 1 OR pct <= 0.005 THEN 'exact' WHEN pct <= 0.02 THEN 'close' WHEN pct <= 0.05 THEN 'near' ELSE 'off' END band,
   CASE WHEN ad <= 1 OR pct <= 0.005 THEN 25 WHEN pct <= 0.02 THEN 12 WHEN pct <= 0.05 THEN 3 WHEN pct <= 0.15 THEN -12 ELSE -30 END points FROM d)
SELECT band, CAST(points AS BIGINT) AS points, count(*) AS n, CAST(sum(delta) AS BIGINT) AS delta FROM b GROUP BY 1, 2"""


def strict_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.floor("value").cast("int").alias("wanted"))
    out = match.strictly_decreasing(e, "user_id", [F.col("event_id")])
    return out.select("user_id", "event_id", F.col("shown").cast("long").alias("shown"))


CHAIN_SQL = """WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS INT) w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events)
SELECT user_id, event_id, CAST(greatest(1, min(w + i) OVER (PARTITION BY user_id ORDER BY i) - i) AS BIGINT) AS shown FROM e"""


def region_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region of a customer's list (its nation's, then the next ones) whose catalog knows the customer's key modulo the suppliers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") % 40).alias("item"), F.col("s_nationkey").alias("n_nationkey"))
    catalog = s.join(n, "n_nationkey").select("item", F.col("n_regionkey").alias("region")).distinct()
    wanted = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", (F.col("c_custkey") % 40).alias("item"), F.col("n_regionkey").alias("r"))
    regions = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("r") + i) % 5).cast("int"))
    out = match.first_region_with_record(wanted, regions, catalog, "c_custkey", "item")
    return out.select("c_custkey", F.col("region").cast("long").alias("region"), F.col("try_no").cast("long").alias("try_no"))


REGION_SQL = """WITH cat AS (SELECT DISTINCT s_suppkey % 40 item, n_regionkey region FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 t AS (SELECT c_custkey, c_custkey % 40 item, (n_regionkey + i) % 5 region, i try_no FROM customer JOIN nation ON c_nationkey = n_nationkey, range(0, 5) r(i)),
 f AS (SELECT c_custkey, region, try_no, row_number() OVER (PARTITION BY c_custkey ORDER BY try_no) rn FROM t JOIN cat USING (item, region))
SELECT c_custkey, CAST(region AS BIGINT) AS region, CAST(try_no AS BIGINT) AS try_no FROM f WHERE rn = 1"""


def plan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    hits = e.select("user_id", "event_id", plan.alias("plan_no"))
    return match.first_plan_with_hits(hits, "user_id").select("user_id", "event_id", F.col("plan_no").cast("long").alias("plan_no"))


PLAN_SQL = """WITH h AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END plan_no FROM events)
SELECT user_id, event_id, CAST(plan_no AS BIGINT) AS plan_no FROM (SELECT *, min(plan_no) OVER (PARTITION BY user_id) m FROM h) WHERE plan_no = m"""


def author_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' and suppliers' number names inside a nation, within two edits."""
    digits = lambda c: F.regexp_replace(F.regexp_extract(c, "([0-9]+)$", 1), "^0+", "")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat("c_custkey", F.lit(":"), "c_nationkey").alias("k"), F.col("c_nationkey").alias("nation"), F.concat(F.lit("Author "), digits("c_name")).alias("wanted_name"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("Author "), digits("s_name")).alias("name"))
    out = match.author_candidates(c, s, "k", "nation")
    return out.select("k", "pos", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("place"), F.col("shown").cast("long").alias("shown"))


AUTHOR_SQL = """WITH c AS (SELECT c_custkey || ':' || c_nationkey k, c_nationkey nation, 'author ' || ltrim(regexp_extract(c_name, '([0-9]+)$', 1), '0') w FROM customer),
 s AS (SELECT s_nationkey nation, s_suppkey pos, 'author ' || ltrim(regexp_extract(s_name, '([0-9]+)$', 1), '0') n FROM supplier),
 p AS (SELECT k, pos, levenshtein(w, n) d FROM c JOIN s USING (nation)), q AS (SELECT * FROM p WHERE d <= 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, pos) rn, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k) ex FROM q)
SELECT k, pos, CAST(d AS BIGINT) AS distance, CAST(rn AS BIGINT) AS place, CAST(CASE WHEN d = 0 AND ex = 1 AND rn = 1 THEN 100 ELSE least(76 - rn, greatest(1, least(99, 99 - 10 * d))) END AS BIGINT) AS shown FROM r"""


def search_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    hints = p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("").alias("file_title"),
        F.when(F.col("p_partkey") % 6 == 0, F.col("p_brand")).otherwise("").alias("file_author"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("").alias("hint_title"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise("").alias("hint_author"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("01 - "), F.col("p_name"), F.lit(" (Unabridged).mp3"))).alias("name"),
    )
    return match.query_plans(hints).select("id", F.col("plan_no").cast("long").alias("plan_no"), "keywords", "title", "author")


PLANS_SQL = """WITH h AS (SELECT p_partkey id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END ft, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE '' END fa,
   CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END ht, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END ha, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END nm FROM part),
 c AS (SELECT *, CASE WHEN ft <> '' THEN ft ELSE ht END t, CASE WHEN ft <> '' THEN fa ELSE ha END a FROM h),
 u AS (SELECT id, 0 o, trim(a || ' ' || t) keywords, t title, a author FROM c WHERE t <> ''
   UNION ALL SELECT id, 1, nm, nm, '' FROM c WHERE nm <> '' UNION ALL SELECT id, 2, t, '', '' FROM c WHERE t <> ''),
 d AS (SELECT id, keywords, title, author, min(o) o FROM u GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS plan_no, keywords, title, author FROM d"""


def nearest_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest editions: by the hint's author where that finds any, else by all."""
    pairs = _pairs(spark, sf_dir)
    plans = pairs.withColumn("plan_no", F.when(F.array_contains("authors", F.col("hint_author")) & (F.col("c_id") != F.col("q_id")), 0).otherwise(1)).where("c_id <> q_id")
    best = match.top(match.scored(match.first_plan_with_hits(plans, HINT)), HINT, 6)
    return best.select("q_id", "c_id", F.col("rank").cast("long").alias("place"))


NEAREST_SQL = f"""WITH {_PAIRS_SQL},
 p AS (SELECT *, CASE WHEN author = hint_author THEN 0 ELSE 1 END plan_no FROM scored WHERE c_id <> q_id),
 f AS (SELECT * FROM (SELECT *, min(plan_no) OVER (PARTITION BY q_id) m FROM p) WHERE plan_no = m),
 r AS (SELECT q_id, c_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, pos) place FROM f)
SELECT q_id, c_id, CAST(place AS BIGINT) AS place FROM r WHERE place <= 6"""


QUERIES = {
    "link_top_candidates": (top_candidates, TOP_SQL),
    "link_auto_accept": (auto_accept, AUTO_SQL),
    "link_lenient_accept": (lenient_accept, LENIENT_SQL),
    "link_display_scores": (display_scores, DISPLAY_SQL),
    "link_nearest_editions": (nearest_editions, NEAREST_SQL),
    "link_search_plans": (search_plans, PLANS_SQL),
    "runtime_band": (runtime_bands, BANDS_SQL),
    "strict_rank_chain": (strict_chain, CHAIN_SQL),
    "region_fallback": (region_fallback, REGION_SQL),
    "plan_fallback": (plan_fallback, PLAN_SQL),
    "author_best_match": (author_match, AUTHOR_SQL),
}
