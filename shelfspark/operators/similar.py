"""Candidates by text: a similarity join on edit distance, the retrieval that a catalog's search does.

``fuzzy_join`` finds every pair of distinct titles whose softened distance (``text.fuzzy_distance``) is at most
``most``, as scoring accepts them, without comparing all pairs:

* A title is cut into ``most + 1`` even pieces. ``most`` edits leave one of them whole, so a hint within that distance holds it, near
  its place: a hint asks for each length that a title may have, and each place to which edits on either side of a piece can move it.
* A title that holds the hint and is at most ``extra`` longer holds the hint's first 2^k characters, 2^k being at most the hint's length, at one
  of its first ``extra + 1`` places.
* Titles too short for pieces of ``q`` characters meet by what is left of them after up to ``most`` deletions.

Pieces are sent as hashes, with the title's hash, lengths and the parities of its pairs of characters in 64 bits, which an edit changes in four
places at most. Only pairs that these allow go on, as hashes; each is verified once on its titles, by a banded edit distance. So what is sent
grows with the titles and with the pairs that nearly match, not with lists of common pieces; a piece that very many titles share is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

Q = 3
#: Titles of a piece that one task takes; what more share it are split.
SLICE = 20_000
#: One of so many titles counts for telling such pieces.
COUNTED = 16


def grams(title: Column, q: int = Q) -> Column:
    """All runs of ``q`` characters, in order; none of a shorter title. Characters are split once, so the work is linear in a title's length."""
    runs = text.let(F.split(title, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - q), lambda i: F.concat(*[F.get(c, i + j) for j in range(q)])))
    return F.when(F.length(title) >= q, runs).otherwise(F.array().cast("array<string>"))


def without(title: Column, most: int) -> Column:
    """What is left of a short title after each way to delete up to ``most`` characters."""
    left = F.array(title)
    for _ in range(most):
        cut = F.flatten(F.transform(left, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))))
        left = F.array_distinct(F.concat(left, cut))
    return left


def _parities(title: Column) -> Column:
    """64 bits: whether the pairs of characters of each hashed bin are odd in number."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))
    return F.aggregate(grams(title, 2), F.lit(0).cast("long"), lambda bits, g: bits.bitwiseXOR(bit(g)))


def _pieces(title: Column, n: Column, most: int) -> list[Column]:
    """Keys of a title's pieces: of its length, the piece's number and its characters."""
    at = lambda i: F.floor(n * i / (most + 1)).cast("int")
    return [F.xxhash64(F.lit("piece"), n, F.lit(i), F.substring(title, at(i) + 1, at(i + 1) - at(i))) for i in range(most + 1)]


def _piece_asked(hint: Column, n: Column, most: int) -> list[Column]:
    """Keys of the pieces that titles within ``most`` edits may share. Of a piece that is whole, with as few edits as can be on either
    side, piece ``i`` has moved by at most ``i`` from the front and by at most ``most - i`` from the end."""
    out = []
    for i in range(most + 1):
        for longer in range(-most, most + 1):  # hint less title
            size = n - longer
            at = lambda k: F.floor(size * k / (most + 1)).cast("int")  # noqa: B023, E731
            for moved in range(max(-i, longer - (most - i)), min(i, longer + (most - i)) + 1):
                start, length = at(i) + moved, at(i + 1) - at(i)
                fits = (start >= 0) & (length > 0) & (start + length <= n)
                out.append(F.when(fits, F.xxhash64(F.lit("piece"), size.cast("int"), F.lit(i), F.substring(hint, start + 1, length))))
    return out


def _many(rows: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, _s): keys of more than ``SLICE`` rows, told by those of some names, and the tasks that take one; a row for ``SLICE`` rows at most."""
    some = rows.where(F.pmod(name, F.lit(COUNTED)) == 0).groupBy(key).agg((F.count("*") * COUNTED).alias("_n"))
    return F.broadcast(some.where(F.col("_n") > SLICE).select(key, F.ceil(F.col("_n") / SLICE).cast("int").alias("_s")))


def _met(asked: DataFrame, held: DataFrame, fits: Column) -> DataFrame:
    """(h, t): hashes of hints (key, h, hn, hb, hp) and titles (key, t, tn, tb, tp, off) of equal keys that fit."""
    many = _many(held, "key", F.col("t"))
    parts = F.coalesce("_s", F.lit(1))
    asked = asked.join(many, "key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_s")
    held = held.join(many, "key", "left").withColumn("_part", F.pmod(F.xxhash64("t", F.lit(1)), parts).cast("int")).drop("_s")
    return asked.join(held.hint("merge"), ["key", "_part"]).where(fits).select("h", "t")


def fuzzy_join(hints: DataFrame, candidates: DataFrame, most: int = 2, q: int = Q) -> DataFrame:
    """(hint, title, distance): all pairs of distinct titles of (title) rows whose fuzzy distance is at most ``most``.

    Titles are compared as given (fold and lower them first); nulls and empty titles match nothing.
    """
    if most < 0 or q < 1:
        raise ValueError("most must be 0 or more and q 1 or more")
    extra = 8 * most - 1  # bytes by which a title that holds the hint may be longer
    short = (most + 1) * q  # fewer characters than this leave too small pieces
    kept = lambda df: df.select("title").where("title <> ''").distinct()
    hints, candidates = kept(hints), kept(candidates)
    title, n = F.col("title"), F.length("title")
    told = lambda df, x: df.select("title", F.xxhash64("title").alias("h" if x == "h" else "t"), n.alias(f"{x}n"), F.octet_length("title").alias(f"{x}b"), _parities(title).alias(f"{x}p"))
    asked, held = told(hints, "h"), told(candidates, "t")
    no_keys = F.array().cast("array<bigint>")
    left = F.when(n < short + most, F.transform(without(title, most), lambda r: F.xxhash64(F.lit("left"), r))).otherwise(no_keys)
    keyed = lambda df, keys: df.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"), *[c for c in df.columns if c != "title"])
    apart = F.bit_count(F.col("hp").bitwiseXOR(F.col("tp")))
    close = lambda keys: F.array_distinct(F.concat(F.when(n >= short, F.array(*keys)).otherwise(no_keys), left))
    met = _met(keyed(asked, close(_piece_asked(title, n, most))), keyed(held, close(_pieces(title, n, most))), (F.abs(F.col("hn") - F.col("tn")) <= most) & (apart <= 4 * most))

    if most > 0:  # titles that hold the hint
        power = lambda m: F.floor(F.log2(m.cast("double") + 0.5)).cast("int")
        two = lambda k: F.call_function("shiftleft", F.lit(1), k)
        start = lambda s, at, k: F.xxhash64(F.lit("start"), k, F.substring(s, at + 1, two(k)))
        first = keyed(asked.where("hb >= 4"), F.array(start(title, F.lit(0), power(n))))
        each = held.withColumn("_k", F.explode(F.sequence(power(F.greatest(n - extra, F.lit(1))), power(n)))).withColumn("off", F.explode(F.sequence(F.lit(0), F.least(n - two(F.col("_k")), F.lit(extra)))))
        each = each.select(start(title, F.col("off"), F.col("_k")).alias("key"), "t", "tn", "tb", "tp", "off")
        inside = (F.col("tb") - F.col("hb")).between(0, extra) & (F.col("off") + F.col("hn") <= F.col("tn")) & (apart <= F.col("tn") - F.col("hn"))
        met = met.unionByName(_met(first, each, inside))
    # titles of one hash all come back, and are told apart here
    named = met.distinct().join(hints.select(F.xxhash64("title").alias("h"), title.alias("hint")).hint("merge"), "h").join(candidates.select(F.xxhash64("title").alias("t"), "title").hint("merge"), "t")
    return named.select("hint", "title").withColumn("distance", _distance(most)).where(F.col("distance") <= most)


def _distance(most: int) -> Column:
    """The fuzzy distance where it is at most ``most``, else something greater; the edit distance is not followed beyond it."""
    hint, title = F.col("hint"), F.col("title")
    edits = F.levenshtein(hint, title, most)
    edits = F.when(edits >= 0, edits).otherwise(most + 1)
    longer = (F.floor((F.octet_length(title) - F.octet_length(hint)) / 8) + 1).cast("int")
    held = F.when((F.octet_length(hint) >= 4) & F.contains(title, hint), longer).otherwise(most + 1)
    return F.when(hint == title, 0).when(F.abs(F.length(hint) - F.length(title)) > most, held).otherwise(F.least(edits, held))


def text_candidates(hints: DataFrame, catalog: DataFrame, most: int = 2, limit: int = 25, same: bool = False) -> DataFrame:
    """Rows (q_id, c_id, pos, text_distance, dealt): for each hint (q_id, title) the ``limit`` catalog rows (c_id, title) nearest by text, ties by c_id.

    Titles that fold to the same text are one class: classes are joined, and of each only the first ``limit`` members can be among a
    hint's first, so copies are never expanded into all their pairs. ``same``: hints are rows of the catalog, and no candidates of themselves.
    Other columns of both sides come with the pairs. A hint's pairs lie in one task, by ``dealt``: windows over ``dealt`` and ``q_id`` need no exchange. A title that very many hints share is dealt to several tasks.
    """
    fold = lambda df: df.withColumn("title", text.folded_lower(F.col("title")))
    hints, catalog = fold(hints), fold(catalog)
    hint_columns = [c for c in hints.columns if c not in ("q_id", "title")]
    member = F.struct("distance", *[c for c in catalog.columns if c != "title"])
    pairs = fuzzy_join(hints, catalog, most)
    first = catalog.withColumn("_k", F.row_number().over(Window.partitionBy("title").orderBy("c_id"))).where(F.col("_k") <= limit + 1).drop("_k")
    # as many parts as the session shuffles into: rows grow by ``limit`` after this, which their size before does not tell
    parts = int(hints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.coalesce("_s", F.lit(1))
    hints = hints.withColumnRenamed("title", "folded").withColumn("_h", F.xxhash64("folded"))
    many = _many(hints.select("_h", F.xxhash64("q_id").alias("q")), "_h", F.col("q"))
    # a class's hints share one list: its limit + 1 nearest members, the one more for the hint itself
    listed = pairs.join(first, "title").select(F.xxhash64("hint").alias("_h"), "hint", member.alias("c")).join(many, "_h", "left")
    listed = listed.withColumn("_part", F.explode(F.sequence(F.lit(0), spread - 1))).select(F.xxhash64("_h", "_part").alias("dealt"), "hint", "c").repartition(parts, "dealt")
    listed = listed.withColumn("_k", F.row_number().over(Window.partitionBy("dealt", "hint").orderBy("c.distance", "c.c_id"))).where(F.col("_k") <= limit + 1)
    lists = listed.groupBy("dealt", "hint").agg(F.sort_array(F.collect_list(F.struct("_k", "c"))).alias("list"))
    # titles of one hash share a row, and are told apart by the hint's own
    lists = lists.groupBy("dealt").agg(F.collect_list(F.struct("hint", "list")).alias("lists"))
    own = F.filter("lists", lambda x: x["hint"] == F.col("folded"))
    part = F.pmod(F.xxhash64("q_id", F.lit(1)), spread).cast("int")
    hints = hints.where("folded <> ''").join(many, "_h", "left").withColumn("dealt", F.xxhash64("_h", part)).repartition(parts, "dealt")
    out = hints.join(lists.hint("merge"), "dealt").select("dealt", "q_id", *hint_columns, F.explode(own).alias("own"))
    others = F.filter("own.list", lambda x: (x["c"]["c_id"] != F.col("q_id")) if same else F.lit(True))
    out = out.select("dealt", "q_id", *hint_columns, F.posexplode(F.slice(others, 1, limit)).alias("pos", "x"))
    return out.select("q_id", "pos", "dealt", *hint_columns, "x.c.*").withColumnRenamed("distance", "text_distance")
