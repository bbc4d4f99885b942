"""What a media server's agent gathers about a book, and the rows and records it answers with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, tags, text
from . import fuse, genres, match, paths, requests

# Artist names that name nobody, the fields a tagged file decides, and the containers that can be read.
BAD_ARTISTS = ("", "[unknown artist]", "unknown artist", "various artists", "various")
FILE_FIELDS = (("title", "title"), ("subtitle", "subtitle"), ("authors", "authors"), ("narrators", "narrators"), ("series_name", "series"), ("release_date", "release"), ("year", "release"), ("publisher", "publisher"), ("language", "language"), ("summary", "description"))
READABLE = (".m4b", ".m4a", ".mp4")
LONGEST_TITLE = 40
BOOK_COLUMNS = tuple(k for columns in fuse.FIELDS.values() for k in columns)


def real_artist(c: Column) -> Column:
    """An artist hint; '' where it names nobody."""
    s = text.trimmed(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin(*BAD_ARTISTS), "").otherwise(s)


def evidence(files: DataFrame, hints: DataFrame, key: str = "book") -> DataFrame:
    """All that files (key, pos, path, duration_ms, tags) and hints (key, album, artist) say of each book.

    Tags are those of the first readable file. A running time counts where every file's is known. The name to search
    by is the only file's, or its folder's.
    """
    base = text.base_name(F.col("path"))
    readable = F.lower(text.extension(base)).isin(*READABLE)
    first_readable = F.min_by("tags", F.when(readable, F.col("pos")))
    first_path = F.min_by("path", "pos")
    rows = files.groupBy(key).agg(
        F.count("*").alias("files"),
        first_readable.alias("tags"),
        first_path.alias("first_path"),
        F.when(F.count_if(F.coalesce(F.col("duration_ms") <= 0, F.lit(True))) == 0, F.sum("duration_ms")).otherwise(0).cast("long").alias("total_ms"),
    )
    rows = rows.withColumn("first_path", F.replace("first_path", F.lit("\\"), F.lit("/")))
    rows = rows.withColumn("tokens", paths.path_tokens(F.col("first_path")))
    first, tokens = F.col("first_path"), F.col("tokens")
    folder = text.base_name(paths.parent(first))
    name = F.when(F.col("files") == 1, text.base_name(first)).when(F.contains(first, F.lit("/")), folder).otherwise(first)
    out = rows.join(hints, key, "left")
    return out.select(
        key,
        F.col("files").cast("long").alias("files"),
        text.trimmed(F.coalesce("album", F.lit(""))).alias("hint_title"),
        real_artist(F.col("artist")).alias("hint_author"),
        "tags",
        clock.runtime_minutes(F.col("total_ms")).alias("runtime_min"),
        tokens["id"].alias("path_asin"),
        tokens["region"].alias("path_region"),
        name.alias("name"),
    )


def default_sort(b: Column) -> Column:
    """"Series 1 - Title", so that books sort within their series."""
    return F.when((b["series_name"] != "") & (b["series_position"] != ""), F.concat(b["series_name"], F.lit(" "), b["series_position"], F.lit(" - "), b["title"])).otherwise(b["title"])


def display_name(title: Column, authors: Column, narrators: Column, minutes: Column, band: Column) -> Column:
    """"Title · F.Author · F.Narrator · 1h02m ✓", short enough for a list."""
    short = F.when(F.length(title) > LONGEST_TITLE, F.concat(F.rtrim(F.left(title, F.lit(LONGEST_TITLE - 2))), F.lit("…"))).otherwise(title)
    sign = F.when(band == "exact", " ✓").when(band == "close", " ≈").when(band == "near", " ~").when(band == "off", " ≠").otherwise("")
    length = F.when(minutes > 0, F.concat(F.format_string("%dh%02dm", (minutes / 60).cast("int"), (minutes % 60).cast("int")), sign))
    person = lambda c: F.when(F.size(c) > 0, text.initials(F.try_element_at(c, F.lit(1))))
    return F.concat_ws(" · ", short, person(authors), person(narrators), length)


def result_row(r: Column, local_min: Column, score: Column) -> Column:
    """struct(id, asin, name, year, score) of a candidate record."""
    band = match.runtime_band(r["runtime_min"], local_min)["band"]
    region = F.coalesce(text.known(r["region"]), F.lit("us"))
    return F.struct(
        F.concat(r["asin"], F.lit("_"), region).alias("id"),
        r["asin"].alias("asin"),
        display_name(r["title"], r["authors"], r["narrators"], r["runtime_min"], band).alias("name"),
        F.left(r["year"], F.lit(4)).try_cast("int").alias("year"),
        score.alias("score"),
    )


def manual_row(b: Column, local_id: Column, hint_title: Column, local_min: Column) -> Column:
    """The row of a book tagged by hand: its own id, its file's words."""
    title = F.coalesce(text.known(b["title"]), hint_title)
    name = display_name(title, b["authors"], b["narrators"], local_min, F.lit(""))
    return F.struct(local_id.alias("id"), local_id.alias("asin"), F.concat(name, F.lit(" (tagged by hand)")).alias("name"), F.left(b["year"], F.lit(4)).try_cast("int").alias("year"), F.lit(match.SURE).alias("score"))


def moods(authors: Column, series_name: Column, authors_as_moods: Column) -> Column:
    """Authors who are no contributors of another kind, then the series."""
    own = F.filter(authors, lambda a: ~a.rlike("^.+? -"))
    series = F.when(series_name != "", F.array(F.concat(F.lit("Series: "), series_name))).otherwise(F.array().cast("array<string>"))
    return text.distinct_in_order(F.concat(F.when(authors_as_moods, own).otherwise(F.array().cast("array<string>")), series))


def file_overlay(book: Column, file: Column, same: Column) -> Column:
    """struct(book, from_file): a catalog's record under its file's own values, and the fields that came from the file, in order."""
    given = lambda k: same & F.coalesce((F.size(file[k]) > 0) if k in fuse.LISTS else (file[k] != ""), F.lit(False))
    takes: dict[str, list[Column]] = {}
    for check, field in FILE_FIELDS:
        takes.setdefault(field, []).append(given(check))
    take = {field: reduce(lambda x, y: x | y, conditions) for field, conditions in takes.items()}
    columns = {k: book[k] for columns in fuse.FIELDS.values() for k in columns}
    for field, condition in take.items():
        for k in fuse.FIELDS[field]:
            columns[k] = F.when(condition, file[k] if k != "description" else F.lit("")).otherwise(book[k])
    return F.struct(F.struct(*[c.alias(k) for k, c in columns.items()]).alias("book"), F.array_compact(F.array(*[F.when(c, F.lit(field)) for field, c in take.items()])).alias("from_file"))


def album_row(book: Column, file: Column, same: Column, sort_title: Column, rating: Column, authors_as_moods: Column, series_collections: Column) -> Column:
    """What an agent stores of an album: a catalog's record, its tagged file's values where the file is of that record."""
    own = F.when(same, F.coalesce(F.try_element_at(file["genres"], F.lit(1)), F.lit(""))).otherwise("")

    def row(merged: Column) -> Column:
        b, from_file = merged["book"], merged["from_file"]
        sort = F.when(F.size(from_file) > 0, F.coalesce(text.known(sort_title), default_sort(b))).otherwise(default_sort(b))
        top = genres.file_genre_leads(b["genres"], own, b["literature_type"], b["genre_paths"])
        return F.struct(
            b["title"].alias("title"),
            sort.alias("title_sort"),
            fuse.blurb(b).alias("summary"),
            b["publisher"].alias("studio"),
            clock.release_date(b["release_date"], b["year"]).alias("originally_available_at"),
            text.distinct_in_order(F.concat(top, b["sub_genres"])).alias("genres"),
            text.distinct_in_order(b["narrators"]).alias("styles"),
            moods(b["authors"], b["series_name"], authors_as_moods).alias("moods"),
            clock.doubled_rating(rating).alias("rating"),
            b["cover_url"].alias("poster"),
            from_file.alias("from_file"),
            F.when(series_collections, b["series_name"]).otherwise("").alias("collection"),
        )

    return text.let(file_overlay(book, file, same), row)


def manual_album_row(file: Column, sort_title: Column, cover: Column, authors_as_moods: Column, series_collections: Column) -> Column:
    """The same of a book tagged by hand, from its file alone; null without a title."""
    row = F.struct(
        file["title"].alias("title"),
        F.coalesce(text.known(sort_title), default_sort(file)).alias("title_sort"),
        file["summary"].alias("summary"),
        file["publisher"].alias("studio"),
        clock.release_date(file["release_date"], file["year"]).alias("originally_available_at"),
        text.distinct_in_order(file["genres"]).alias("genres"),
        text.distinct_in_order(file["narrators"]).alias("styles"),
        moods(file["authors"], file["series_name"], authors_as_moods).alias("moods"),
        F.when(cover.isNotNull(), F.concat(F.lit("embedded-"), F.sha1(cover))).otherwise("").alias("cover_key"),
        F.when(series_collections, file["series_name"]).otherwise("").alias("collection"),
    )
    return F.when(file["title"] != "", row)


def artist_row(name: Column, description: Column, genre_names: Column, image: Column, by_last_name: Column) -> Column:
    return F.struct(name.alias("title"), F.when(by_last_name, text.sort_name(name)).otherwise(name).alias("title_sort"), description.alias("summary"), text.distinct_in_order(genre_names).alias("genres"), image.alias("poster"))


def listing(rows: DataFrame, key: str) -> DataFrame:
    """One list from rows (key, source, pos, asin, score) of several sources: a book's own claims first (source 0), then ranked ones; no id twice, scores that fall strictly."""
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy(key, "asin").orderBy("source", "pos"))
    once = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    wanted = F.when(F.col("source") == 0, F.lit(match.SURE)).otherwise(clock.clamped(F.col("score"), 1, 99))
    return match.strictly_decreasing(once.withColumn("wanted", wanted), key, [F.col("source"), F.col("pos")])


def collection_url(base: str, section: Column, rating_key: Column, existing: Column, wanted: Column) -> Column:
    """The address that puts an album into a collection beside those it is in; null where there is nothing to do."""
    name = text.trimmed(F.coalesce(wanted, F.lit("")))
    done = F.exists(existing, lambda e: F.lower(e) == F.lower(name))
    names = F.concat(existing, F.array(name))
    param = lambda k, v: F.concat(requests.path_escape(k), F.lit("="), requests.path_escape(v))
    members = F.transform(names, lambda n, i: param(F.concat(F.lit("collection["), i.cast("string"), F.lit("].tag.tag")), n))
    query = F.array_join(F.concat(F.array(param(F.lit("type"), F.lit("9")), param(F.lit("id"), rating_key)), members, F.array(F.lit("collection.locked=1"))), "&")
    address = F.concat(F.lit(f"{base}/library/sections/"), requests.path_escape(section), F.lit("/all?"), query)
    return F.when((name != "") & (section != "") & ~done, address)


def empty_book() -> Column:
    """A record of which nothing is known."""
    return F.from_json(F.lit('{"title":"","subtitle":"","authors":[],"narrators":[],"series_name":"","series_position":"","year":"","release_date":"","publisher":"","language":"","genres":[],"sub_genres":[],"genre_paths":[],"literature_type":"","description":"","summary":"","runtime_min":0,"cover_url":""}'), fuse.BOOK)


def claimed(book_tags: Column, path_asin: Column) -> Column:
    """The catalog ids a book claims: its tags', then its path's, once each."""
    return text.distinct_in_order(F.array(tags.book_id(book_tags), path_asin))
