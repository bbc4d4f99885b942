"""Record fusion: one record from several sources, field by field, with where each value came from.

Sources meet in one full outer join on the record's key, or one pivoting aggregation for
any number of them; fields are then coalesced over structs, so values that belong together
(a series and its position, a description and its summary) come from one source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import genres

PRIMARY, SECONDARY = "primary", "secondary"
ORDER = (PRIMARY, SECONDARY)
# Fields in their order, the columns that move together, and a preference other than ORDER.
FIELDS: dict[str, tuple[str, ...]] = {
    "title": ("title",),
    "subtitle": ("subtitle",),
    "authors": ("authors",),
    "narrators": ("narrators",),
    "series": ("series_name", "series_position"),
    "release": ("year", "release_date"),
    "publisher": ("publisher",),
    "language": ("language",),
    "genres": ("genres", "sub_genres", "genre_paths"),
    "description": ("description", "summary"),
    "runtime_min": ("runtime_min",),
    "cover_url": ("cover_url",),
    "literature_type": ("literature_type",),
}
PREFERRED = {"genres": (SECONDARY, PRIMARY)}
LABELS = {f: f.capitalize() for f in FIELDS} | {"release": "Release date", "runtime_min": "Runtime", "cover_url": "Cover", "literature_type": "Kind"}
LISTS = {"authors", "narrators", "genres", "sub_genres"}

BOOK = (
    "struct<title:string,subtitle:string,authors:array<string>,narrators:array<string>,series_name:string,series_position:string,"
    "year:string,release_date:string,publisher:string,language:string,genres:array<string>,sub_genres:array<string>,"
    "genre_paths:array<array<string>>,literature_type:string,description:string,summary:string,runtime_min:int,cover_url:string>"
)


def blurb(b: Column) -> Column:
    return F.coalesce(F.when(b["summary"] != "", b["summary"]), b["description"])


def present(b: Column, field: str) -> Column:
    """Whether a record has a value for a field."""
    if field in LISTS:
        known = F.size(b[field]) > 0
    elif field == "runtime_min":
        known = b[field] != 0
    elif field == "series":
        known = b["series_name"] != ""
    elif field == "release":
        known = (b["year"] != "") | (b["release_date"] != "")
    elif field == "description":
        known = blurb(b) != ""
    else:
        known = b[field] != ""
    return b.isNotNull() & F.coalesce(known, F.lit(False))


def picked(sources: dict[str, Column], field: str, override: Column | None = None) -> Column:
    """The name of the source that a field comes from, null for none: an override that has a value, then by preference.

    A description prefers a source with a full summary.
    """
    order = [s for s in PREFERRED.get(field, ORDER) if s in sources] + [s for s in sources if s not in ORDER]
    choice = [F.when((override == s) & present(b, field), F.lit(s)) for s, b in sources.items()] if override is not None else []
    if field == "description":
        choice += [F.when(sources[s].isNotNull() & (sources[s]["summary"] != ""), F.lit(s)) for s in order]
    choice += [F.when(present(sources[s], field), F.lit(s)) for s in order]
    return F.coalesce(*choice)


def merged(records: DataFrame, sources: tuple[str, ...] = ORDER, overrides: Column | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """Adds book (the fused record with cleaned categories) and sources (field -> source of the known fields).

    ``records`` has a struct column for each source. Choices, values and categories are separate projections, so each
    is computed once.
    """
    sides = {s: F.col(s) for s in sources}
    names = [F.coalesce(picked(sides, f, F.try_element_at(overrides, F.lit(f)) if overrides is not None else None), F.lit("")).alias(f) for f in FIELDS]
    chosen = records.withColumn("_from", F.struct(*names))

    def value(field: str, column: str) -> Column:
        v = reduce(lambda c, s: c.when(F.col("_from")[field] == s, sides[s][column]), sides, F.when(F.lit(False), F.lit(None)))
        if column == "genre_paths":
            return F.coalesce(v, F.array().cast("array<array<string>>"))
        if column in LISTS:
            return F.coalesce(v, F.array().cast("array<string>"))
        return F.coalesce(v, F.lit(0) if column == "runtime_min" else F.lit(""))

    raw = chosen.withColumn("book", F.struct(*[value(f, c).alias(c) for f, cs in FIELDS.items() for c in cs]))
    b = F.col("book")
    cleaned = raw.withColumn("_clean", genres.cleaned(b["literature_type"], b["genres"], b["sub_genres"], b["genre_paths"], kinds))
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col("_from")[f].alias("value")) for f in FIELDS if f != "literature_type"])
    origin = F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))
    out = cleaned.withColumn("book", b.withField("genres", F.col("_clean.genres")).withField("sub_genres", F.col("_clean.sub_genres")))
    return out.withColumn("sources", origin).drop("_from", "_clean")


def by_source(records: DataFrame, key: list[str], names: tuple[str, ...] = ORDER) -> DataFrame:
    """One row a key with a struct column for each source, from rows (key, source, book); one exchange."""
    return records.groupBy(*key).agg(*[F.max(F.when(F.col("source") == n, F.col("book"))).alias(n) for n in names])


def joined(primary: DataFrame, secondary: DataFrame, key: list[str]) -> DataFrame:
    """Two sources side by side: a full outer join on the key."""
    return primary.join(secondary, key, "full_outer")


def fetch_status(primary: Column, secondary: Column) -> Column:
    """struct(status, notes) of 'ok', 'not_found' and 'error': a primary error fails, any other lack is noted, nothing anywhere is not found."""
    note = lambda c, name: F.when(c == "error", F.lit(f"{name} unavailable")).when(c == "not_found", F.lit(f"not in {name}"))
    status = F.when(primary == "error", "error").when((primary == "ok") | (secondary == "ok"), "ok").when(secondary == "error", "error").otherwise("not_found")
    notes = F.when(status == "ok", F.array_compact(F.array(note(primary, "primary"), note(secondary, "secondary")))).otherwise(F.array().cast("array<string>"))
    return F.struct(status.alias("status"), notes.alias("notes"))


def display_value(b: Column, field: str) -> Column:
    """A field as one text; '' for unknown."""
    v = {
        "authors": lambda: F.array_join(b["authors"], ", "),
        "narrators": lambda: F.array_join(b["narrators"], ", "),
        "genres": lambda: F.array_join(b["genres"], ", "),
        "series": lambda: F.when(b["series_name"] == "", "").when(b["series_position"] == "", b["series_name"]).otherwise(F.concat(b["series_name"], F.lit(" #"), b["series_position"])),
        "release": lambda: F.when(b["release_date"] != "", b["release_date"]).otherwise(b["year"]),
        "description": lambda: blurb(b),
        "runtime_min": lambda: F.when(b["runtime_min"] == 0, "").otherwise(F.concat(b["runtime_min"].cast("string"), F.lit(" min"))),
    }.get(field, lambda: b[field])()
    return F.coalesce(v, F.lit(""))


def comparison(books: DataFrame, key: str, sources: dict[str, Column], winner: Column) -> DataFrame:
    """(key, field, value of each source, winner, differs): a row for each field any source knows."""
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    out = books.select(key, winner.alias("_winners"), *[b.alias(f"_{s}") for s, b in sources.items()], F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))

    def value(source: str) -> Column:
        b = F.col(f"_{source}")
        return F.coalesce(reduce(lambda c, f: c.when(F.col("field") == f, display_value(b, f)), FIELDS, F.when(F.lit(False), F.lit(""))), F.lit("")).alias(source)

    out = out.select(key, "field", labels[F.col("field")].alias("label"), *[value(s) for s in sources], F.try_element_at("_winners", F.col("field")).alias("winner"))
    known = [F.when(F.col(s) != "", F.col(s)) for s in sources]
    differs = F.size(F.array_distinct(F.array_compact(F.array(*known)))) > 1
    return out.withColumn("differs", differs).where(F.coalesce(*known).isNotNull())


def overlaid(book: Column, file: Column, same: Column, fields: tuple[str, ...]) -> Column:
    """The book with the file's known values over the catalog's, where the file claims the same id."""
    out = book
    for f in fields:
        known = (F.size(file[f]) > 0) if f in LISTS else (file[f] != "")
        out = out.withField(f, F.when(same & F.coalesce(known, F.lit(False)), file[f]).otherwise(book[f]))
    return out
