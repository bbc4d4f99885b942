"""Chapters: ordered intervals on an audio timeline.

Two shapes: rows of (book, idx, ...) for window work over any number of books, and
``array<struct<title,start_ms,length_ms>>`` columns for decisions within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.clock import div, duration_text, timestamp_text, tolerance_ms

CHAPTERS = "array<struct<title:string,start_ms:bigint,length_ms:bigint>>"


def _window(key: str, order: list[str]) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def boundaries(files: DataFrame, key: str, order: list[str], duration: str = "duration_ms") -> DataFrame:
    """Adds start_ms: the sum of the durations before."""
    before = _window(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start_ms", F.coalesce(F.sum(duration).over(before), F.lit(0)).cast("long"))


def next_start_lengths(chapters: DataFrame, key: str, order: list[str], runtime: Column, own: Column) -> DataFrame:
    """Adds length_ms: to the next start, to the runtime for the last (its own length where unknown), never below 0."""
    following = F.lead("start_ms").over(_window(key, order))
    length = F.when(following.isNotNull(), following - F.col("start_ms")).when(runtime > 0, runtime - F.col("start_ms")).otherwise(own)
    return chapters.withColumn("length_ms", F.greatest(F.lit(0), length).cast("long"))


def monotone(start: Column, shift: Column, runtime: Column, key: str, order: list[str]) -> Column:
    """Shifted starts held to [0, runtime] and never before the one before: clamped first, so a running maximum will do."""
    moved = F.greatest(F.lit(0).cast("long"), start + shift)
    moved = F.when(runtime > 0, F.least(moved, runtime)).otherwise(moved)
    return F.max(moved).over(_window(key, order).rowsBetween(Window.unboundedPreceding, 0))


def shifted(chapters: DataFrame, key: str, order: list[str], shift: Column, runtime: Column) -> DataFrame:
    """Rows (key, start_ms, length_ms) moved by a shift that may differ from row to row."""
    out = chapters.withColumn("_own", F.col("length_ms")).withColumn("start_ms", monotone(F.col("start_ms"), shift, runtime, key, order))
    return next_start_lengths(out, key, order, runtime, F.col("_own")).drop("_own")


def interpolated_shift(start: Column, t0: Column, t1: Column, from_ms: Column, to_ms: Column) -> Column:
    """from_ms up to the first anchor, to_ms from the second, and in proportion between; one anchor shifts all alike."""
    between = from_ms + div((to_ms - from_ms) * (start - t0), F.when(t1 == t0, F.lit(1)).otherwise(t1 - t0))
    return F.when((t0 == t1) | (start <= t0), from_ms).when(start >= t1, to_ms).otherwise(between)


def anchored_shift(chapters: DataFrame, key: str, order: list[str], from_idx: Column, from_ms: Column, to_idx: Column, to_ms: Column) -> DataFrame:
    """Adds shift_ms by anchors given as 1-based chapter numbers, held to the list; 0 as the second is the last; swapped if reversed."""
    w = Window.partitionBy(key)
    rows = chapters.withColumn("_i", F.row_number().over(_window(key, order))).withColumn("_n", F.count("*").over(w))
    hold = lambda i: F.greatest(F.lit(1), F.least(i, F.col("_n")))
    a, b = hold(from_idx), F.when(to_idx == 0, F.col("_n")).otherwise(hold(to_idx))
    swap = a > b
    rows = rows.withColumn("_a", F.when(swap, b).otherwise(a)).withColumn("_b", F.when(swap, a).otherwise(b))
    rows = rows.withColumn("_am", F.when(swap, to_ms).otherwise(from_ms)).withColumn("_bm", F.when(swap, from_ms).otherwise(to_ms))
    at = lambda i: F.max(F.when(F.col("_i") == F.col(i), F.col("start_ms"))).over(w)
    rows = rows.withColumn("_t0", at("_a")).withColumn("_t1", at("_b"))
    shift = interpolated_shift(F.col("start_ms"), F.col("_t0"), F.col("_t1"), F.col("_am"), F.col("_bm"))
    return rows.withColumn("shift_ms", shift).drop("_i", "_n", "_a", "_b", "_am", "_bm", "_t0", "_t1")


def shift_is_zero(mode: Column, fixed: Column, from_ms: Column, to_ms: Column) -> Column:
    return F.when(mode == "fixed", fixed == 0).when(mode == "interp", (from_ms == 0) & (to_ms == 0)).otherwise(F.lit(True))


def shift_text(mode: Column, fixed: Column, from_ms: Column, from_idx: Column, to_ms: Column, to_idx: Column) -> Column:
    last = F.when(to_idx == 0, "last").otherwise(to_idx.cast("string"))
    return F.when(mode == "fixed", F.format_string("fixed %+d ms", fixed)).when(mode == "interp", F.format_string("%+d ms at %d to %+d ms at %s", from_ms, from_idx, to_ms, last)).otherwise("none")


def validity(chapters: DataFrame, key: str, order: list[str], duration: Column) -> DataFrame:
    """Adds valid (of the whole list): starts in order and before the end; and end_ms: the next start, or the duration."""
    w = _window(key, order)
    ok = (F.col("start_ms") >= F.coalesce(F.lag("start_ms").over(w), F.lit(0))) & ((duration <= 0) | (F.col("start_ms") < duration))
    rows = chapters.withColumn("_ok", ok).withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), duration))
    return rows.withColumn("valid", F.min("_ok").over(Window.partitionBy(key))).drop("_ok")


def extended_last(chapters: Column, header: Column, duration: Column) -> Column:
    """Probed chapters (title, start_ms, end_ms) whose last ends with a cut-off header, taken to the real end."""
    n = F.size(chapters)
    near = (header > 0) & (n > 0) & (F.abs(F.try_element_at(chapters, F.lit(-1))["end_ms"] - header) <= 1000)
    return F.when(near, F.transform(chapters, lambda c, i: F.when(i == n - 1, c.withField("end_ms", duration)).otherwise(c))).otherwise(chapters)


def with_lengths(probed: Column) -> Column:
    return F.transform(probed, lambda c: F.struct(c["title"].alias("title"), c["start_ms"].alias("start_ms"), (c["end_ms"] - c["start_ms"]).alias("length_ms")))


def own_chapters(embedded: Column, truncated: Column, sidecar: Column) -> Column:
    """struct(chapters, source): embedded ones unless cut off, then a sidecar's, then cut-off ones; null for none."""
    some, side = F.size(embedded) > 0, F.size(sidecar) > 0
    pick = lambda c, s: F.struct(c.alias("chapters"), F.lit(s).alias("source"))
    return F.when(some & ~truncated, pick(embedded, "existing")).when(side, pick(sidecar, "sidecar")).when(some, pick(embedded, "existing"))


def file_titles(paths: Column) -> Column:
    """Chapter titles from file names, where every one says something of its own; else numbered."""

    def clean(p: Column) -> Column:
        s = F.regexp_replace(text.stem(p), "(?i)^[\\t\\n\\f\\r ]*(?:track|chapter|part|ch|pt)?[\\t\\n\\f\\r ._-]*[0-9]+[\\t\\n\\f\\r ._-]*", "")
        return F.regexp_replace(F.replace(s, F.lit("_"), F.lit(" ")), "^[ \\-–.]+|[ \\-–.]+$", "")

    def chosen_titles(titles: Column) -> Column:
        useful = F.forall(titles, lambda t: (F.length(t) >= 3) & text.has_letter(t)) & (F.size(F.array_distinct(titles)) == F.size(titles))
        return F.when(useful, titles).otherwise(F.transform(titles, lambda p, i: F.format_string("Chapter %02d", i + 1)))

    return text.let(F.transform(paths, clean), chosen_titles)


def from_files(paths: Column, durations: Column) -> Column:
    """One chapter a file, at the running sum of durations."""
    start = lambda i: F.aggregate(F.slice(durations, F.lit(1), i), F.lit(0).cast("long"), lambda a, d: a + d)
    return text.let(file_titles(paths), lambda titles: F.transform(durations, lambda d, i: F.struct(F.get(titles, i).alias("title"), start(i).alias("start_ms"), d.cast("long").alias("length_ms"))))


def aligned_titles(chapters: Column, n: Column, intro: Column, outro: Column) -> Column:
    """Titles for ``n`` local chapters: up to two short chapters at the ends are left out; null where they can't line up."""
    have = F.size(chapters)
    extra = have - n
    limit = lambda brand: F.greatest(F.lit(40_000).cast("long"), brand + 5_000)
    short = lambda i, brand: (F.try_element_at(chapters, i)["length_ms"] > 0) & (F.try_element_at(chapters, i)["length_ms"] <= limit(brand))
    first, second = short(F.lit(1), intro), short(F.lit(2), intro)
    last, before = short(F.lit(-1), outro), short(F.lit(-2), outro)
    # how many go at the front, null where too few can: the front is tried before the back
    front = (
        F.when((n <= 0) | (extra < 0) | (extra > 2), None)
        .when(extra == 0, 0)
        .when(extra == 1, F.when(first, 1).when(last, 0))
        .otherwise(F.when(first & second, 2).when(first & last, 1).when(~first & last & before, 0))
    )
    return F.when(front.isNotNull(), F.transform(F.slice(chapters, front + 1, F.greatest(n, F.lit(0))), lambda c: c["title"]))


def chosen(books: DataFrame, out: str = "plan") -> DataFrame:
    """Adds struct(source, chapters, warnings): where a book's chapters come from.

    Rows have mode, title, actual (the audio's ms), files: array of struct(path, duration_ms, chapters, truncated,
    sidecar) with start_ms and end_ms, and the provider's provider (a list, empty for none), runtime, accurate, intro
    and outro. First match wins: provider titles on local timings where asked for and alignable, the provider's where
    its runtime fits or it is forced, a single file's own, file boundaries, one chapter for the whole book. Each step
    is a projection of its own, so none is computed twice.
    """
    c = F.col
    one = F.try_element_at("files", F.lit(1))
    single, several, has = F.size("files") == 1, F.size("files") > 1, F.size("provider") > 0
    wants_titles = c("mode").isin("titles-files", "titles-existing")
    rows = books.withColumn("_own", F.when(single, own_chapters(one["chapters"], one["truncated"], one["sidecar"])))
    rows = rows.withColumn("_bounds", from_files(F.transform("files", lambda f: f["path"]), F.transform("files", lambda f: f["duration_ms"])))
    rows = rows.withColumn("_local", F.when(c("mode") == "titles-files", F.when(several, c("_bounds"))).when(c("mode") == "titles-existing", with_lengths(c("_own.chapters"))))
    rows = rows.withColumn("_titles", F.when(has & c("_local").isNotNull(), aligned_titles(c("provider"), F.size("_local"), c("intro"), c("outro"))))
    no_sidecar = (c("mode") == "sidecar") & ~(single & (F.coalesce(F.size(one["sidecar"]), F.lit(0)) > 0))
    rows = rows.withColumn("_mode", F.when((c("mode") == "") | no_sidecar | wants_titles, "auto").otherwise(c("mode")))
    local_only = c("_mode").isin("existing", "sidecar")
    fits = F.abs(c("runtime") - c("actual")) <= tolerance_ms(c("actual"))
    rows = rows.withColumn("_fits", fits).withColumn("_use", ~local_only & has & (fits | (c("_mode") == "provider")))
    mine = (
        F.when((c("_mode") == "existing") & single & (F.size(one["chapters"]) > 0), F.struct(one["chapters"].alias("chapters"), F.lit("existing").alias("source")))
        .when((c("_mode") == "sidecar") & single, F.struct(one["sidecar"].alias("chapters"), F.lit("sidecar").alias("source")))
        .otherwise(c("_own"))
    )
    warnings = F.array_compact(
        F.array(
            F.when(wants_titles, F.when(has, "titles do not line up").otherwise("no titles available")),
            F.when(no_sidecar, "no usable sidecar"),
            F.when(c("_use") & ~c("_fits"), "provider forced against its runtime"),
            F.when(c("_use") & ~c("accurate"), "provider timings possibly inaccurate"),
            F.when(~local_only & has & ~c("_use"), "provider runtime does not fit"),
            F.when((c("_mode") == "provider") & ~has, "no provider chapters available"),
        )
    )
    rows = rows.withColumn("_mine", mine).withColumn("_warnings", warnings)
    whole = F.array(F.struct(F.when(c("title") == "", "Chapter 01").otherwise(c("title")).alias("title"), F.lit(0).cast("long").alias("start_ms"), c("actual").alias("length_ms")))
    skipped = F.array_compact(F.array(F.when(F.size("provider") > F.size("_titles"), "short provider chapters skipped")))
    titled = wants_titles & c("_titles").isNotNull()
    own = single & c("_mine").isNotNull()
    source = F.when(titled, c("mode")).when(c("_use"), "provider").when(own, c("_mine.source")).when(several, "files").otherwise("single")
    rows = rows.withColumn("_source", source)
    pick = c("_source")
    chapters = (
        F.when(pick == "provider", c("provider"))
        .when(pick.isin("titles-files", "titles-existing"), F.transform("_local", lambda x, i: x.withField("title", F.get("_titles", i))))
        .when(pick == "files", c("_bounds"))
        .when(pick == "single", whole)
        .otherwise(with_lengths(c("_mine.chapters")))
    )
    plan = F.struct(pick.alias("source"), chapters.alias("chapters"), F.when(titled, skipped).otherwise(c("_warnings")).alias("warnings"))
    return rows.withColumn(out, plan).drop("_own", "_bounds", "_local", "_titles", "_mode", "_fits", "_use", "_mine", "_warnings", "_source")


def text_file(chapters: Column) -> Column:
    """The chapter text format: a line each, and the whole length."""
    lines = F.transform(chapters, lambda c: F.concat_ws(" ", timestamp_text(c["start_ms"]), text.trimmed(c["title"])))
    end = F.coalesce(F.array_max(F.transform(chapters, lambda c: c["start_ms"] + c["length_ms"])), F.lit(0).cast("long"))
    total = F.when(end > 0, F.array(F.concat(F.lit("## total-duration: "), timestamp_text(end)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(F.concat(lines, total), lambda s: F.concat(s, F.lit("\n"))), "")


def verified_conversion(planned: Column, made: Column, files: Column, chapters: Column) -> Column:
    """Whether output is as long as its sources, and a merge of several files has chapters."""
    return (F.abs(made - planned) <= tolerance_ms(planned)) & ~((files > 1) & (chapters == 0))


def retag_problem(before: Column, after: Column, wanted: Column, got: Column, title: Column) -> Column:
    """Why a retagged copy must not replace its original; null where it may."""
    return (
        F.when(F.abs(after - before) > tolerance_ms(before), F.concat(F.lit("length changed to "), duration_text(after)))
        .when(got != wanted, F.lit("chapter count differs"))
        .when(text.trimmed(F.coalesce(title, F.lit(""))) == "", F.lit("no title"))
    )


RESOLVED = "struct<source:string,chapters:array<struct<title:string,start_ms:bigint,length_ms:bigint>>>"


def as_json(resolved: Column) -> Column:
    """Resolved chapters (source, chapters) as a job stores them."""
    return F.to_json(resolved)


def from_json(stored: Column) -> Column:
    """The same read back; null where the text cannot be read."""
    read = F.from_json(stored, RESOLVED)
    return F.when(read["source"].isNotNull(), read)
