"""Linkage by text over ``documents``: a document's title is its first sentence, its author its source, its runtime its length.

Hints and catalog are all documents; the catalog's answer is the 25 rows nearest by text among those that scoring
could accept. The SQL twins compare all pairs of titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import match, similar

CANDIDATES = 25
MOST = 2
#: What ranks the candidates of a hint: with what deals them, so that rows stay where the search made them.
HINT = ["dealt", "q_id"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.trimmed(F.regexp_extract(F.coalesce("text", F.lit("")), "^[^.!?\\n]*", 0)).alias("title"), F.coalesce("source", F.lit("")).alias("author"), F.coalesce("lang", F.lit("")).alias("language"), F.floor(F.col("n_chars") / 60).cast("int").alias("runtime"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return similar.text_candidates(d.select(F.col("doc_id").alias("q_id"), "title"), d.select(F.col("doc_id").alias("c_id"), "title"), MOST, CANDIDATES, same=True)


def _scored(pairs: DataFrame) -> DataFrame:
    return match.scored(pairs, F.col("text_distance"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hint and candidate rows, without their titles, which the search has compared. What scoring takes comes with the documents before they
    meet: pairs, up to ``CANDIDATES`` a document, are never sent."""
    d = _documents(spark, sf_dir)
    hints = d.select(F.col("doc_id").alias("q_id"), "title", F.col("author").alias("hint_author"), F.col("runtime").alias("hint_runtime"), F.col("language").alias("hint_language"))
    catalog = d.select(F.col("doc_id").alias("c_id"), "title", F.array("author").alias("authors"), F.col("runtime").alias("runtime_min"), "language")
    # a hint that found anything has a title
    return similar.text_candidates(hints, catalog, MOST, CANDIDATES, same=True).withColumn("hint_title", F.lit("known"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("q_id", "c_id", F.col("pos").cast("long").alias("pos"), F.col("text_distance").cast("long").alias("text_distance"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = match.top(_scored(_pairs(spark, sf_dir)), HINT)
    return best.select("q_id", "c_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("place"), "runtime_band")


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = match.ranked(_scored(_pairs(spark, sf_dir)), HINT)
    strict = match.accepted(best).select("q_id", "c_id", "accepted")
    return strict


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest editions: those of the hint's author where the search finds any, else all."""
    pairs = _pairs(spark, sf_dir).withColumn("plan_no", F.when(F.array_contains("authors", F.col("hint_author")), 0).otherwise(1))
    best = match.top(_scored(match.first_plan_with_hits(pairs, HINT)), HINT, 6)
    return best.select("q_id", "c_id", F.col("rank").cast("long").alias("place"))


_FOLD = "".join(["lower("] + [f"replace(" for _ in text.FOLD_PAIRS] + [f"translate(t, '{text.FOLD_FROM}', '{text.FOLD_TO}')"] + [f", '{a}', '{b}')" for a, b in text.FOLD_PAIRS.items()] + [")"])
_FOUND_SQL = rf"""
  d0 AS (SELECT doc_id, trim(regexp_extract(coalesce("text", ''), '^[^.!?\n]*', 0), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t, coalesce(source, '') author, coalesce(lang, '') "language", n_chars // 60 runtime FROM documents),
  d AS MATERIALIZED (SELECT *, {_FOLD} f FROM d0),
  u AS MATERIALIZED (SELECT DISTINCT f, length(f) n, strlen(f) b FROM d WHERE f <> ''),
  e AS (SELECT x.f h, y.f c, CASE WHEN x.f = y.f THEN 0 WHEN abs(x.n - y.n) <= {MOST} THEN levenshtein(x.f, y.f) ELSE 1000000 END dist, CASE WHEN x.b >= 4 AND contains(y.f, x.f) THEN (y.b - x.b) // 8 + 1 ELSE 1000000 END inside FROM u x JOIN u y ON x.n - y.n <= {MOST} AND y.n - x.n <= 15),
  p AS MATERIALIZED (SELECT h, c, least(dist, inside) dist FROM e WHERE least(dist, inside) <= {MOST}),
  found AS (SELECT q.doc_id q_id, c.doc_id c_id, dist, row_number() OVER (PARTITION BY q.doc_id ORDER BY dist, c.doc_id) - 1 pos FROM d q JOIN p ON p.h = q.f JOIN d c ON c.f = p.c WHERE q.doc_id <> c.doc_id QUALIFY pos < {CANDIDATES}),
  terms AS (SELECT q_id, c_id, pos, dist, q.author qa, c.author ca, q."language" ql, c."language" cl, c.runtime - q.runtime delta, q.runtime qr, c.runtime cr, abs(c.runtime - q.runtime) ad, abs(c.runtime - q.runtime) / q.runtime::DOUBLE pct FROM found JOIN d q ON q.doc_id = q_id JOIN d c ON c.doc_id = c_id),
  banded AS (SELECT *, CASE WHEN qr <= 0 OR cr <= 0 THEN '' WHEN ad <= 1 OR pct <= 0.005 THEN 'exact' WHEN pct <= 0.02 THEN 'close' WHEN pct <= 0.05 THEN 'near' ELSE 'off' END band,
    CASE WHEN qr <= 0 OR cr <= 0 THEN 0 WHEN ad <= 1 OR pct <= 0.005 THEN 25 WHEN pct <= 0.02 THEN 12 WHEN pct <= 0.05 THEN 3 WHEN pct <= 0.15 THEN -12 ELSE -30 END points FROM terms),
  scored AS (SELECT *, 100 - 2 * dist - CASE WHEN qa <> '' THEN 10 * levenshtein(lower(qa), lower(ca)) ELSE 0 END - pos + points - CASE WHEN ql = '' OR cl = '' OR lower(ql) = lower(cl) THEN 0 ELSE 25 END score FROM banded),
  ranked AS (SELECT *, row_number() OVER w AS "rank", lead(score) OVER w next_score, lead(band) OVER w next_band FROM scored WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, pos))"""

FOUND_SQL = f"WITH {_FOUND_SQL} SELECT q_id, c_id, CAST(pos AS BIGINT) AS pos, CAST(dist AS BIGINT) AS text_distance FROM found"
RANKED_SQL = f'WITH {_FOUND_SQL} SELECT q_id, c_id, CAST(score AS BIGINT) AS score, CAST("rank" AS BIGINT) AS place, band AS runtime_band FROM ranked WHERE "rank" <= {match.MAX_ROWS}'
ACCEPTED_SQL = f"""WITH {_FOUND_SQL} SELECT q_id, c_id, (band = 'exact' AND (ql = '' OR lower(ql) = lower(cl)) AND dist <= 2 AND (next_score IS NULL OR (score - next_score >= 15 AND next_band <> 'exact'))) AS accepted FROM ranked WHERE "rank" = 1"""
EDITIONS_SQL = f"""WITH {_FOUND_SQL},
  f AS (SELECT *, CASE WHEN qa = ca THEN 0 ELSE 1 END plan_no FROM scored),
  g AS (SELECT * FROM f QUALIFY plan_no = min(plan_no) OVER (PARTITION BY q_id))
SELECT q_id, c_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, pos) AS place FROM g QUALIFY place <= 6"""

QUERIES = {
    "link_text_candidates": (found, FOUND_SQL),
    "link_text_ranked": (ranked, RANKED_SQL),
    "link_text_accept": (accepted, ACCEPTED_SQL),
    "link_text_editions": (editions, EDITIONS_SQL),
}
