"""Records entered by hand: the form, what is wrong with it, the record it makes, and the text that asks for one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from . import fuse, genres

FIELDS = ("title", "subtitle", "authors", "narrators", "series_name", "series_position", "release", "publisher", "language", "genres", "description", "asin")
SEPARATOR = "; "


def form_of(b: Column) -> Column:
    """A record as a form's texts: lists parted by "; ", the date or else the year, genres and sub-genres as one list."""
    joined = lambda c: F.array_join(c, SEPARATOR)
    return F.struct(
        b["title"].alias("title"),
        b["subtitle"].alias("subtitle"),
        joined(b["authors"]).alias("authors"),
        joined(b["narrators"]).alias("narrators"),
        b["series_name"].alias("series_name"),
        b["series_position"].alias("series_position"),
        F.coalesce(text.known(b["release_date"]), b["year"]).alias("release"),
        b["publisher"].alias("publisher"),
        b["language"].alias("language"),
        joined(F.concat(b["genres"], b["sub_genres"])).alias("genres"),
        fuse.blurb(b).alias("description"),
        b["asin"].alias("asin"),
    )


def split_list(c: Column) -> Column:
    """Items parted by ';', trimmed, once each."""
    return text.distinct_in_order(F.split(c, ";"))


def form_problems(f: Column) -> Column:
    """All that is wrong with a form."""
    release, asin = text.trimmed(f["release"]), F.upper(text.trimmed(f["asin"]))
    return F.array_compact(
        F.array(
            F.when(text.trimmed(f["title"]) == "", "title: missing"),
            F.when(F.size(split_list(f["authors"])) == 0, "authors: missing"),
            F.when((text.trimmed(f["series_position"]) != "") & (text.trimmed(f["series_name"]) == ""), "series_position: without a series"),
            F.when(~release.rlike("^([0-9]{4}(-[0-9]{2}-[0-9]{2})?)?\\z"), F.concat(F.lit("release: "), release)),
            F.when((asin != "") & ~text.catalog_id(asin), F.concat(F.lit("asin: "), asin)),
        )
    )


def book_of(f: Column, local_id: Column) -> Column:
    """The record a form makes; every field's source is the hand that wrote it."""
    t = lambda k: text.trimmed(f[k])
    release = t("release")
    dated = release.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z")
    return F.struct(
        F.upper(t("asin")).alias("asin"),
        t("title").alias("title"),
        t("subtitle").alias("subtitle"),
        split_list(f["authors"]).alias("authors"),
        split_list(f["narrators"]).alias("narrators"),
        t("series_name").alias("series_name"),
        t("series_position").alias("series_position"),
        F.when(dated, F.left(release, F.lit(4))).when(release.rlike("^[0-9]{4}\\z"), release).otherwise("").alias("year"),
        F.when(dated, release).otherwise("").alias("release_date"),
        t("publisher").alias("publisher"),
        F.lower(t("language")).alias("language"),
        split_list(f["genres"]).alias("genres"),
        F.array().cast("array<string>").alias("sub_genres"),
        text.trimmed(F.replace(f["description"], F.lit("\r\n"), F.lit("\n"))).alias("summary"),
        F.lit("").alias("description"),
        local_id.alias("local_id"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in SOURCED]), F.array(*[F.lit("manual")] * len(SOURCED))).alias("sources"),
    )


# The fields whose source a record names.
SOURCED = ("title", "subtitle", "authors", "narrators", "series", "release", "publisher", "language", "genres", "description")


def panel_form(b: Column) -> Column:
    """The form a page starts with: a record's, without genres that only stand in for one."""
    return form_of(b).withField("genres", F.array_join(genres.without_placeholders(split_list(form_of(b)["genres"])), SEPARATOR))


def panel_cover(file_cover: Column, edition_url: Column) -> Column:
    """Which cover is chosen at first: the file's, the nearest edition's, or one to be uploaded."""
    return F.when(file_cover.isNotNull(), "file").when(text.known(edition_url).isNotNull(), F.concat(F.lit("edition:"), edition_url)).otherwise("upload")


def cover_problem(choice: Column, uploaded: Column) -> Column:
    """What is wrong with a chosen cover; ''."""
    url = F.regexp_replace(choice, "^edition:", "")
    return (
        F.when(F.startswith(choice, F.lit("edition:")), F.when(url.rlike("^https?://"), "").otherwise("cover: no web address"))
        .when(choice == "upload", F.when(uploaded.rlike("^[0-9a-f]{32}\\.(jpg|png)\\z"), "").otherwise("cover: nothing uploaded"))
        .otherwise("")
    )


def hours(minutes: Column) -> Column:
    return F.format_string("%dh %02dm", (minutes / 60).cast("int"), (minutes % 60).cast("int"))


def prompt(path: Column, files: Column, minutes: Column, b: Column, chapters: Column, editions: Column) -> Column:
    """The text that asks a person or program for a record: what is known of the files, their tags, and near editions.

    ``editions`` are structs of title, authors, narrators, runtime_min, year and asin.
    """
    n = F.size(files)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    shown = F.array_join(F.slice(files, 1, 6), ", ")
    file_line = F.when(n == 1, F.concat(F.lit("- File: "), files[0])).when(n > 1, F.concat(F.lit("- Files ("), n.cast("string"), F.lit("): "), shown, F.when(n > 6, ", …").otherwise("")))
    tag = lambda label, v: F.when(text.trimmed(v) != "", F.concat(F.lit(f"{label} "), quoted(text.trimmed(v))))
    series = F.when(b["series_name"] != "", F.concat_ws(" ", b["series_name"], text.known(b["series_position"]))).otherwise("")
    known = F.concat_ws(
        "; ",
        tag("title", b["title"]),
        tag("author", F.array_join(b["authors"], ", ")),
        tag("narrator", F.array_join(b["narrators"], ", ")),
        tag("series", series),
        tag("publisher", b["publisher"]),
        F.when(b["release_date"] != "", tag("date", b["release_date"])).otherwise(tag("year", b["year"])),
        tag("genre", F.array_join(b["genres"], ", ")),
    )
    edition = lambda e: F.concat(
        F.lit("- "),
        quoted(e["title"]),
        F.lit(" by "),
        F.array_join(e["authors"], ", "),
        F.when(F.size(e["narrators"]) > 0, F.concat(F.lit(", read by "), F.array_join(e["narrators"], ", "))).otherwise(""),
        F.when(e["runtime_min"] > 0, F.concat(F.lit(", "), hours(e["runtime_min"]))).otherwise(""),
        F.when(e["year"] != "", F.concat(F.lit(", "), e["year"])).otherwise(""),
        F.lit(" ["),
        e["asin"],
        F.lit("]"),
    )
    chapter_line = F.when(F.size(chapters) > 0, F.concat(F.lit("- Chapters ("), F.size(chapters).cast("string"), F.lit("): "), F.array_join(F.transform(F.slice(chapters, 1, 5), quoted), ", ")))
    return F.concat_ws(
        "\n",
        F.lit("Fill in the record of this audio book. Leave null what is not certain."),
        F.concat(F.lit("- Location: "), path),
        file_line,
        F.when(minutes > 0, F.concat(F.lit("- Length: "), hours(minutes), F.lit(" ("), minutes.cast("string"), F.lit(" minutes)"))),
        F.when(known != "", F.concat(F.lit("- Present tags: "), known)),
        chapter_line,
        F.when(F.size(editions) > 0, F.concat(F.lit("Other editions, for facts about the work alone:\n"), F.array_join(F.transform(editions, edition), "\n"))),
        F.concat(F.lit("Keys: "), F.lit(", ".join(FIELDS))),
        F.concat(F.lit("Genres: "), F.lit("; ".join(name for name, _ in genres.CATEGORIES))),
    )
