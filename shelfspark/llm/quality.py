"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each document gets counts that never leave its row. A quantile sketch of each measure is
kept per (lang, source): counts in logarithmic buckets, so a quantile is right within
``ACCURACY`` of its value and sketches merge by adding counts. Thresholds of a group are
fences around its own quantiles; a group with under ``min_docs`` documents uses its
language's merged sketch, a small language the whole corpus's. Thresholds join back on
(lang, source), and a document outside a fence goes.

A fence lies ``spread`` times the group's own tail from its median: for the shares, mostly
zero, up to the 90 or 95 % quantile, for word length to the quartiles. No distance is
absolute. The least one, for groups of no spread, is ``UNIT`` occurrences in the group's
median document (by its sketch of sizes), for word length a part of the median. The most is
``LIFT`` times the median distance of all groups of ``min_docs`` documents (or that least
one), so junk that fills a group's tail does not lift its limit without end. Only documents
that pass the base rule are sketched.

Repeated word windows are told by 64-bit hashes inside one document.

Defined cases: null or empty texts have no words and fail the base rule; null lang or
source is a group of its own; repeated rows are judged each; columns of the input other
than doc_id, text, lang and source pass through untouched; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import corpus

ACCURACY = 0.02
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: measure -> (upper fence, lower fence) present
MEASURES = {
    "symbol_share": (True, False),
    "dup_line_share": (True, False),
    "repeat_share": (True, False),
    "word_length": (True, True),
}
#: Quantile that ends the upper tail; the lower one ends at its mirror image.
TAIL = {"symbol_share": 0.9, "dup_line_share": 0.95, "repeat_share": 0.9, "word_length": 0.75}
#: Least distance of a fence from the median: so many in the median document of the group, of the size that the share is of.
UNIT = {"symbol_share": (8.0, "word_chars"), "dup_line_share": (2.0, "n_lines"), "repeat_share": (12.0, "n_words")}
#: The same for word length, in parts of its own median; and the most, in units of what is usual.
WORD_PART = 0.05
LIFT = 2.0
SIZES = ("word_chars", "n_lines", "n_words")

_SPACE = r"[\\x20\\x09-\\x0D]+"
_TRIM = "' \t\n\x0b\f\r'"


def words(text: str) -> str:
    """SQL for the words of a text column: runs of anything but ASCII white space."""
    trimmed = f"trim(BOTH {_TRIM} FROM coalesce({text}, ''))"
    return f"transform(array({trimmed}), t -> if(t = '', cast(array() as array<string>), split(t, '{_SPACE}')))[0]"


def _repeats(windows: str) -> str:
    """Words covered by windows that occur twice or more. Sorting (window, place) puts equal ones side by side."""
    covered = "size(array_distinct(flatten(transform(filter(s, (x, j) -> (j > 0 AND x.w = s[j - 1].w) OR (j + 1 < size(s) AND x.w = s[j + 1].w)), x -> array(x.i, x.i + 1, x.i + 2)))))"
    order = "sort_array(transform(v, (w, i) -> named_struct('w', w, 'i', i)))"
    return f"transform(array({windows}), v -> if(size(array_distinct(v)) = size(v), 0, transform(array({order}), s -> {covered})[0]))[0]"


def measures(text: str = "text") -> Column:
    """A struct of the counts of one text: n_words, word_chars, n_symbols, lines (n and d, those equal to an earlier one), n_repeat_words."""
    hashed = "transform(array(transform(w, x -> xxhash64(x))), h -> {})[0]"
    windows = "if(size(w) < 3, cast(array() as array<bigint>), " + hashed.format("transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]))") + ")"
    lines = f"filter(split(coalesce({text}, ''), '\\n'), l -> trim(BOTH {_TRIM} FROM l) <> '')"
    symbols = f"char_length({text}) - char_length(regexp_replace({text}, '[#*$%&|<>]', ''))"
    return F.expr(
        f"transform(array({words(text)}), w -> named_struct("
        f"'n_words', cast(size(w) as bigint), 'word_chars', cast(char_length(array_join(w, '')) as bigint), "
        f"'n_symbols', cast(coalesce({symbols}, 0) as bigint), "
        f"'lines', transform(array({lines}), l -> named_struct('n', size(l), 'd', size(l) - size(array_distinct(l))))[0], "
        f"'n_repeat_words', cast({_repeats(windows)} as bigint)))[0]"
    )


def with_measures(docs: DataFrame) -> DataFrame:
    """The documents with a struct column ``_m``: counts and the shares the thresholds judge."""
    m = F.col("_m")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return docs.withColumn("_m", measures()).withColumn(
        "_m",
        F.struct(
            m["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["lines"]["n"].cast("long").alias("n_lines"),
            m["lines"]["d"].cast("long").alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            share(m["n_symbols"], m["word_chars"]).alias("symbol_share"),
            share(m["lines"]["d"], m["lines"]["n"]).alias("dup_line_share"),
            share(m["n_repeat_words"], m["n_words"]).alias("repeat_share"),
            share(m["word_chars"], m["n_words"]).alias("word_length"),
        ),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, value, n): mergeable counts in logarithmic buckets, of documents with words."""
    m = F.col("_m")
    long = measured.where(m["n_words"] > 0).select("lang", "source", F.explode(F.create_map(*[x for k in (*MEASURES, *SIZES) for x in (F.lit(k), m[k].cast("double"))])).alias("measure", "x"))
    bucket = F.when(F.col("x") > 1e-9, F.ceil(F.log(F.col("x")) / F.log(F.lit(GAMMA)))).cast("int")
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("value", F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1), F.lit(0.0)))


def quantiles(sketch: DataFrame, by: list[str], tail: dict[str, float] = TAIL) -> DataFrame:
    """Per group and measure: total, and q50, up and down (the ends of the tails) of merged sketches.

    A quantile lies in the first bucket whose cumulated count reaches the rank, as far up as the rank is among its members.
    """
    merged = sketch.groupBy(*by, "measure", "bucket", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    # a bucket reaches from upper / GAMMA to upper
    upper = F.col("value") * ((GAMMA + 1) / 2)
    part = lambda rank: F.greatest(F.lit(0.0), (rank - (F.col("upto") - F.col("n"))) / F.col("n"))
    inside = lambda rank: upper / GAMMA + (upper - upper / GAMMA) * part(rank)
    end = F.coalesce(F.create_map(*[F.lit(x) for k, v in tail.items() for x in (k, v)])[F.col("measure")], F.lit(0.5))
    pick = []
    for name, q in {"q50": F.lit(0.5), "up": end, "down": 1 - end}.items():
        rank = F.ceil(q * F.col("total"))
        pick.append(F.min(F.when(F.col("upto") >= rank, inside(rank))).alias(name))
    return ranked.groupBy(*by, "measure").agg(F.max("total").alias("total"), *pick)


def _limits(g: Column, usual: Column, spread: float) -> Column:
    """A struct of (low, high) of each measure, from maps of a group's quantiles and of the usual distances by measure."""
    out = []
    for k in MEASURES:
        q, most = g[k], usual[k]
        least = WORD_PART * q["q50"] if k not in UNIT else UNIT[k][0] / g[UNIT[k][1]]["q50"]
        within = lambda own, most, least=least: F.greatest(F.least(own, LIFT * F.greatest(most, least)), least)
        down, up = spread * (q["q50"] - q["down"]), spread * (q["up"] - q["q50"])
        # with no group of min_docs documents nothing is usual, and a tail is its own bound
        low = q["q50"] - within(down, F.coalesce(most["down"], down))
        high = q["q50"] + within(up, F.coalesce(most["up"], up))
        out.append(F.struct(low.alias("low"), high.alias("high")).alias(k))
    return F.struct(*out)


def thresholds(sketch: DataFrame, spread: float = 8.0, min_docs: int = 50) -> DataFrame:
    """(lang, source) with the struct column ``_t``: lower and upper limit of each measure."""
    stored = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("total", "q50", "up", "down"))))
    own = quantiles(sketch, ["lang", "source"])
    distance = lambda a, b: F.percentile_approx(spread * (F.col(a) - F.col(b)), 0.5)
    usual = own.where(F.col("total") >= min_docs).groupBy("measure").agg(distance("q50", "down").alias("down"), distance("up", "q50").alias("up"))
    usual = usual.agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("down", "up")))).alias("_u"))
    # a language, the corpus and what is usual: one row a language and one row; groups: one a (lang, source)
    groups = own.groupBy("lang", "source").agg(stored.alias("own"))
    langs = quantiles(sketch, ["lang"]).groupBy(F.col("lang").alias("_lang")).agg(stored.alias("wide"))
    every = quantiles(sketch, []).agg(stored.alias("every"))
    # one-row tables join by a constant: a plain equality join, whose size Spark checks before it broadcasts
    one = groups.join(langs, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("_k", F.lit(1))
    one = one.join(every.withColumn("_k", F.lit(1)), "_k").join(usual.withColumn("_k", F.lit(1)), "_k")
    size = lambda c: F.col(c)["word_length"]["total"]
    chosen = F.when(size("own") >= min_docs, F.col("own")).when(size("wide") >= min_docs, F.col("wide")).otherwise(F.col("every"))
    return one.select("lang", "source", chosen.alias("_g"), "_u").select("lang", "source", _limits(F.col("_g"), F.col("_u"), spread).alias("_t"))


def base_failed() -> Column:
    m = F.col("_m")
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def limits(measured: DataFrame, spread: float = 8.0, min_docs: int = 50) -> DataFrame:
    """Thresholds from the documents that pass the base rule."""
    return thresholds(sketches(measured.where(~base_failed())), spread, min_docs)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured documents with ``base_failed`` and ``kept``."""
    m, t = F.col("_m"), F.col("_t")
    outside = F.lit(False)
    for k, (upper, lower) in MEASURES.items():
        if upper:
            outside = outside | (m[k] > t[k]["high"])
        if lower:
            outside = outside | (m[k] < t[k]["low"])
    side = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_t")
    joined = measured.join(side, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).drop("_t")


def quality(docs: DataFrame, spread: float = 8.0, min_docs: int = 50) -> DataFrame:
    """The documents with ``_m`` (counts and shares), ``base_failed`` and ``kept``; written once, so texts are measured once."""
    measured = corpus.table(with_measures(docs), "measured")  # texts included: for callers that want both at once
    return judged(measured, limits(measured, spread, min_docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = corpus.table(with_measures(docs).drop("text"), "measures")
    out = judged(measured, limits(measured))
    return out.select("doc_id", *[F.col("_m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, in their own columns.

    Only measures are stored; texts meet their verdicts once, by id and a hash of the row, so equal rows share theirs.
    """
    keyed = docs.withColumn("_row_hash", F.xxhash64(*docs.columns))
    measured = corpus.table(with_measures(keyed.select("doc_id", "text", "lang", "source", "_row_hash")).drop("text"), "measures")
    kept = judged(measured, limits(measured)).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_row_key"), "_row_hash").distinct()
    return keyed.withColumn("_row_key", F.coalesce("doc_id", F.lit(0))).join(kept.hint("merge"), ["_row_key", "_row_hash"], "left_semi").select(*docs.columns)
