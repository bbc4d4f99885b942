"""Record linkage: score candidates against a hint, rank them, accept only the unambiguous.

Candidates meet hints by an equality key (a query id or a blocking key); scoring is scalar
and ranking one window over the same key, so a query costs one exchange. Ranks are over
(score, pos), ``pos`` being the candidate's place in its catalog's answer.

    score = 100 - 2 fuzzy(title) - 10 nearest author - pos + runtime - 25 if another language
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clock, text
from . import similar

# Band name, largest share of the local runtime, points.
BANDS = (("exact", 0.005, 25), ("close", 0.02, 12), ("near", 0.05, 3), ("off", 0.15, -12))
BEYOND = -30
#: The score of a candidate that agrees in everything, at place 0.
BEST = 100 + BANDS[0][2]
# Language of a storefront.
REGION_LANGUAGE = {"us": "english", "uk": "english", "au": "english", "ca": "english", "in": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "jp": "japanese"}
MAX_ROWS = 8
UNSURE_CAP = 75
AUTHOR_EDITS = 2
SURE = 100


def region_language(region: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REGION_LANGUAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(region)), F.lit(""))


def runtime_band(official: Column, local: Column) -> Column:
    """struct(band, delta, points); band '' and 0 where either is unknown."""
    delta = official - local
    share = F.abs(delta) / local
    band = F.when((F.abs(delta) <= 1) | (share <= BANDS[0][1]), F.lit(0))
    for i, (_, most, _) in enumerate(BANDS[1:], 1):
        band = band.when(share <= most, F.lit(i))
    band = band.otherwise(F.lit(len(BANDS)))
    names = F.array(*[F.lit(n) for n, _, _ in BANDS], F.lit("off"))
    points = F.array(*[F.lit(p) for _, _, p in BANDS], F.lit(BEYOND))
    known = (local > 0) & (official > 0)
    return F.struct(
        F.when(known, F.element_at(names, band + 1)).otherwise("").alias("band"),
        F.when(known, delta).otherwise(0).alias("delta"),
        F.when(known, F.element_at(points, band + 1)).otherwise(0).alias("points"),
    )


def language_agrees(want: Column, got: Column) -> Column:
    """Permissive: an unknown language agrees with any."""
    return (want == "") | (got == "") | (F.lower(want) == F.lower(got))


def nearest_author(hint: Column, authors: Column) -> Column:
    """Least edit distance of folded names; null without a hint or authors."""
    h = text.folded_lower(hint)
    return F.when((hint != "") & (F.size(authors) > 0), F.array_min(F.transform(authors, lambda a: F.levenshtein(h, text.folded_lower(a)))))


def points(title: Column, author: Column, pos: Column, band: Column, agrees: Column | None = None) -> Column:
    """The score of a candidate from its distances (null: not known), its place, its runtime band and whether its language agrees."""
    other = F.lit(0) if agrees is None else F.when(agrees, 0).otherwise(25)
    return (F.lit(100) - 2 * F.coalesce(title, F.lit(0)) - 10 * F.coalesce(author, F.lit(0)) - pos + band["points"] - other).cast("int")


def scored(pairs: DataFrame, distance: Column | None = None) -> DataFrame:
    """Adds title_distance, runtime_band, runtime_delta and score to rows of a hint (hint_title, hint_author,
    hint_runtime, hint_language) and a candidate (title, authors, runtime_min, language, pos). ``distance`` is the titles' where the
    search has told it already; no title is needed then."""
    if distance is None:
        hint = text.folded_lower(F.col("hint_title"))
        distance = F.when(F.col("hint_title") != "", text.fuzzy_distance(hint, text.folded_lower(F.col("title"))))
    band = runtime_band(F.col("runtime_min"), F.col("hint_runtime"))
    out = pairs.withColumn("title_distance", distance).withColumn("_b", band)
    author = nearest_author(F.col("hint_author"), F.col("authors"))
    score = points(F.col("title_distance"), author, F.col("pos"), F.col("_b"), language_agrees(F.col("hint_language"), F.col("language")))
    return out.withColumn("score", score).withColumn("runtime_band", F.col("_b.band")).withColumn("runtime_delta", F.col("_b.delta")).drop("_b")


def ranked(scores: DataFrame, key: str | list[str]) -> DataFrame:
    """Adds rank (1 is best, stable) and the runner-up's score and band of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("pos"))
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w)).withColumn("next_band", F.lead("runtime_band").over(w))


def top(scores: DataFrame, key: str | list[str], k: int = MAX_ROWS) -> DataFrame:
    """The best ``k`` of each key with their rank; the limit is applied before the exchange."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("pos"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _clear_lead() -> Column:
    return F.col("next_score").isNull() | (F.col("score") - F.col("next_score") >= 15)


def accepted(best: DataFrame) -> DataFrame:
    """Strict acceptance of rank-1 rows: exact runtime, equal language where expected, close title, clear lead."""
    language = (F.col("hint_language") == "") | (F.lower("hint_language") == F.lower("language"))
    ok = (F.col("hint_title") != "") & (F.col("runtime_band") == "exact") & language & (F.col("title_distance") <= 2) & _clear_lead() & (F.coalesce("next_band", F.lit("")) != "exact")
    return best.where("rank = 1").withColumn("accepted", F.coalesce(ok, F.lit(False)))


def leniently_accepted(best: DataFrame) -> DataFrame:
    """As ``accepted`` without an exact runtime: none that disagrees, and the author within two edits."""
    language = (F.col("hint_language") == "") | (F.lower("hint_language") == F.lower("language"))
    author = (F.col("hint_author") == "") | (F.coalesce(nearest_author(F.col("hint_author"), F.col("authors")), F.lit(99)) <= 2)
    ok = (F.col("hint_title") != "") & (F.col("runtime_band") != "off") & language & (F.col("title_distance") <= 2) & author & _clear_lead()
    return best.where("rank = 1").withColumn("accepted", F.coalesce(ok, F.lit(False)))


def display_score(rank: Column, score: Column, sure: Column) -> Column:
    """What a list shows: 100 for a sure best, else the score held to 1..99 and below 75 less the place."""
    return F.when(sure & (rank == 1), F.lit(SURE)).otherwise(F.least(UNSURE_CAP + 1 - rank, clock.clamped(score, 1, 99)))


def strictly_decreasing(rows: DataFrame, key: str, order: list[Column], wanted: str = "wanted") -> DataFrame:
    """Adds shown: the wanted scores, lowered so that each is below the one before it, but at least 1.

    s[i] = min(w[i], s[i-1] - 1) is a running minimum of w[j] + j, less i; at the floor of 1 it stays.
    """
    w = Window.partitionBy(key).orderBy(*order)
    place = F.row_number().over(w)
    numbered = rows.withColumn("_i", place)
    least = F.min(F.col(wanted) + F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("shown", F.greatest(F.lit(1), least - F.col("_i")).cast("int")).drop("_i")


def first_plan_with_hits(hits: DataFrame, key: str | list[str], plan: str = "plan_no") -> DataFrame:
    """Rows of each key's first search plan that found anything."""
    return hits.withColumn("_first", F.min(plan).over(Window.partitionBy(key))).where(F.col(plan) == F.col("_first")).drop("_first")


def first_region_with_record(wanted: DataFrame, regions: Column, catalog: DataFrame, key: str, id_column: str) -> DataFrame:
    """Each key's record from the first region of its list that knows its id."""
    tries = wanted.select(key, id_column, F.posexplode(regions).alias("try_no", "region"))
    found = tries.join(catalog, [id_column, "region"])
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("try_no"))).where("_n = 1").drop("_n")


def query_plans(hints: DataFrame) -> DataFrame:
    """(id, plan_no, keywords, title, author) from file_title, file_author, hint_title, hint_author and name: the
    file's own claim or the scanner's, the folder name, then title words alone; blank and repeated plans go."""
    c = F.col
    normal = F.coalesce(text.known(text.normalized_name(c("name"))), c("name"))
    parts = text.author_title(normal)
    claim = F.when(c("file_title") != "", F.struct(c("file_title").alias("t"), c("file_author").alias("a"))).when(c("hint_title") != "", F.struct(c("hint_title").alias("t"), c("hint_author").alias("a")))
    title = F.coalesce(text.known(c("file_title")), c("hint_title"))
    words = F.coalesce(text.known(text.normalized_name(title)), title)
    plan = lambda k, t, a: F.struct(k.alias("keywords"), t.alias("title"), a.alias("author"))
    plans = F.array(
        F.when(claim.isNotNull(), plan(text.trimmed(F.concat_ws(" ", claim["a"], claim["t"])), claim["t"], claim["a"])),
        F.when(c("name") != "", plan(normal, parts["title"], parts["author"])),
        F.when(title != "", plan(words, F.lit(""), F.lit(""))),
    )
    kept = F.array_distinct(F.filter(plans, lambda p: p.isNotNull() & (p["keywords"] != "")))
    return hints.select("id", F.posexplode(kept).alias("plan_no", "p")).select("id", "plan_no", "p.*")


def author_candidates(wanted: DataFrame, listed: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Author names within two edits of each key's wanted name, nearest first, with shown scores: an only exact one is sure.

    Wanted names (key, ``by``, wanted_name) look among the names (``by``, name, pos) of their own ``by``, the key where it is not given.
    Distinct names meet by what up to two deletions leave of both, so not every name is compared; keys that want one name of
    one ``by`` share its ranked list. All sides may grow, so joins merge.
    """
    by = by or key
    folded = lambda df, name, into: df.withColumn(into, text.folded_lower(F.col(name)))
    wanted, listed = folded(wanted, "wanted_name", "_w"), folded(listed, "name", "_n")
    cut = lambda df, c: df.select(by, c).distinct().select(by, c, F.explode(F.transform(similar.without(F.col(c), AUTHOR_EDITS), lambda r: F.xxhash64(r))).alias("_rest"))
    met = cut(wanted, "_w").join(cut(listed, "_n").hint("merge"), [by, "_rest"]).withColumn("distance", F.levenshtein("_w", "_n", AUTHOR_EDITS))
    near = met.where("distance >= 0").select(by, "_w", "_n", "distance").distinct()
    pairs = near.join(listed.hint("merge"), [by, "_n"]).drop("_n")
    w = Window.partitionBy(by, "_w")
    exact = F.sum(F.when(F.col("distance") == 0, 1).otherwise(0)).over(w)
    out = pairs.withColumn("rank", F.row_number().over(w.orderBy("distance", "pos"))).withColumn("_exact", exact)
    sure = (F.col("distance") == 0) & (F.col("_exact") == 1)
    out = out.withColumn("shown", display_score(F.col("rank"), 99 - 10 * F.col("distance"), sure)).drop("_exact")
    return wanted.join(out.hint("merge"), [by, "_w"]).drop("_w")
