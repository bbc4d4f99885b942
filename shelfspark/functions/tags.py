"""Media tags: key folding, first and longest values, and the record a file's tags describe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clock, text


def folded(tags: Column) -> Column:
    """Keys trimmed, lower case, after the last colon, with underscores; blank values dropped.

    Keys that fold alike: the smallest raw key's value stays.
    """
    raw = F.array_sort(F.map_entries(tags))
    key = lambda k: F.replace(F.regexp_replace(F.lower(text.trimmed(k)), "^.*:", ""), F.lit("-"), F.lit("_"))
    entries = F.filter(F.transform(raw, lambda e: F.struct(key(e["key"]).alias("key"), text.trimmed(e["value"]).alias("value"))), lambda e: e["value"] != "")

    def deduped(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), 1)["value"]))

    return text.let(entries, deduped)


def first(tags: Column, *keys: str) -> Column:
    """The first known value of the keys; ''."""
    return F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in keys], F.lit(""))


def longest(tags: Column, *keys: str) -> Column:
    """The value with the most bytes, the first of equals; ''."""
    values = F.array(*[F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")) for k in keys])
    ranked = F.transform(values, lambda v, i: F.struct((-F.octet_length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return F.array_min(ranked)["v"]


def book_id(tags: Column) -> Column:
    """A catalog id in folded tags: two preferred keys, then the first key by name that ends in "asin"; ''."""
    valid = lambda v: F.when(text.catalog_id(v), F.upper(v))
    other = F.filter(F.array_sort(F.map_entries(tags)), lambda e: F.endswith(e["key"], F.lit("asin")) & text.catalog_id(e["value"]))
    return F.coalesce(valid(F.try_element_at(tags, F.lit("audible_asin"))), valid(F.try_element_at(tags, F.lit("asin"))), F.upper(F.try_element_at(other, F.lit(1))["value"]), F.lit(""))


def hand_tagged_id(tags: Column, prefix: str) -> Column:
    """The id of a record tagged by hand, where ``<prefix>_source`` says so; ''."""
    by_hand = F.lower(F.coalesce(F.try_element_at(tags, F.lit(f"{prefix}_source")), F.lit(""))) == "manual"
    return F.when(by_hand, F.coalesce(F.try_element_at(tags, F.lit(f"{prefix}_id")), F.lit(""))).otherwise("")


def book(tags: Column) -> Column:
    """The record that a file's raw tags describe."""
    return text.let(folded(tags), _book)


def _book(t: Column) -> Column:
    date = first(t, "date", "releasetime", "originaldate", "recording_date", "year")
    genres = text.listed(first(t, "genres"))
    one = first(t, "genre")
    return F.struct(
        book_id(t).alias("asin"),
        first(t, "title", "album").alias("title"),
        first(t, "subtitle").alias("subtitle"),
        text.people(first(t, "artist", "album_artist", "author")).alias("authors"),
        text.people(first(t, "narrator", "composer")).alias("narrators"),
        first(t, "series", "movement_name", "show").alias("series_name"),
        first(t, "part", "series_part", "movement", "episode_id").alias("series_position"),
        clock.leading_year(date).alias("year"),
        F.when(date.rlike("^....-..-.."), F.left(date, F.lit(10))).otherwise("").alias("release_date"),
        first(t, "publisher", "label").alias("publisher"),
        first(t, "language").alias("language"),
        F.when(F.size(genres) > 0, genres).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>")).alias("genres"),
        longest(t, "synopsis", "long_description", "description", "comment").alias("summary"),
    )


def without(tags: Column, *keys: str) -> Column:
    """Tags less those of some keys, in any case."""
    return F.map_filter(tags, lambda k, v: ~F.lower(k).isin(*[x.lower() for x in keys]))


def all_genres(genres: Column, sub_genres: Column) -> Column:
    """Genres, then sub-genres, once each; the separator of a list inside a name becomes a comma."""
    return text.distinct_in_order(F.transform(F.concat(genres, sub_genres), lambda g: F.replace(g, F.lit(";"), F.lit(","))))


def written(b: Column, local_id: Column | None = None) -> Column:
    """The tags a record is written as, by the key a reader finds them under; fields that are unknown are left out.

    The genre key holds one genre; where there are several, ``genres`` holds them all. A record with a ``local_id`` was tagged by hand.
    """
    several = all_genres(b["genres"], b["sub_genres"])
    blurb = F.replace(F.when(b["summary"] != "", b["summary"]).otherwise(b["description"]), F.lit("\r"), F.lit(""))
    authors, narrators = F.array_join(b["authors"], ", "), F.array_join(b["narrators"], ", ")
    by_hand = F.coalesce(local_id, F.lit("")) if local_id is not None else F.lit("")
    pairs = {
        "title": b["title"],
        "album": b["title"],
        "media_type": F.lit("Audiobook"),
        "artist": authors,
        "album_artist": authors,
        "narrator": narrators,
        "composer": narrators,
        "subtitle": b["subtitle"],
        "description": blurb,
        "long_description": blurb,
        "genre": F.coalesce(F.try_element_at(b["genres"], F.lit(1)), F.lit("")),
        "recording_date": F.when(b["release_date"] != "", b["release_date"]).when(b["year"] != "", F.concat(b["year"], F.lit("-01-01"))).otherwise(""),
        "publisher": b["publisher"],
        "movement_name": b["series_name"],
        "part": F.when(b["series_name"] != "", b["series_position"]).otherwise(""),
        "audible_asin": b["asin"],
        "genres": F.when(F.size(several) > 1, F.array_join(several, "; ")).otherwise(""),
        "manual_source": F.when(by_hand != "", "manual").otherwise(""),
        "manual_id": by_hand,
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))
