"""Requests: values parsed from forms and queries, and the rows that composed requests answer with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clock, tags, text
from . import fuse, match, paths

MANUAL = "manual"
SHIFT = "struct<mode:string,fixed_ms:bigint,from_idx:int,from_ms:bigint,to_idx:int,to_ms:bigint>"


def value(params: Column, key: str) -> Column:
    """A request value; '' where it was not sent."""
    return F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(""))


def whole_number(c: Column, otherwise: int = 0) -> Column:
    s = text.trimmed(c)
    return F.coalesce(F.when(s.rlike("^[+-]?[0-9]+\\z"), s.try_cast("int")), F.lit(otherwise))


def overrides(params: Column, prefix: str = "msrc:") -> Column:
    """Which source each field shall come from: a map of the known fields that name one."""
    wanted = F.map_filter(params, lambda k, v: k.isin(*[prefix + f for f in fuse.FIELDS]) & (v != ""))
    return F.transform_keys(wanted, lambda k, v: F.substring(k, len(prefix) + 1, 1 << 30))


def shift_spec(params: Column) -> Column:
    """A chapter shift: two anchors, or one offset; all zero where none is asked for."""
    number = lambda k: whole_number(value(params, k))
    offset = lambda k: F.coalesce(clock.shift_input_ms(value(params, k)), F.lit(0)).cast("long")
    none, fixed = F.lit(0).cast("long"), offset("shift")
    anchored = F.struct(F.lit("interp").alias("mode"), none.alias("fixed_ms"), number("shift_from_idx").alias("from_idx"), offset("shift_from_ms").alias("from_ms"), number("shift_to_idx").alias("to_idx"), offset("shift_to_ms").alias("to_ms"))
    plain = F.struct(F.when(fixed != 0, "fixed").otherwise("").alias("mode"), fixed.alias("fixed_ms"), F.lit(0).alias("from_idx"), none.alias("from_ms"), F.lit(0).alias("to_idx"), none.alias("to_ms"))
    return F.when(value(params, "shift_mode") == "interp", anchored).otherwise(plain)


def choice(chosen: Column, manual_id: Column, default_region: Column) -> Column:
    """struct(asin, region, ok): "id|region", or the id of a form in the default region."""
    own = F.upper(text.trimmed(F.coalesce(manual_id, F.lit(""))))
    by_hand = chosen == MANUAL
    split = F.regexp_extract(chosen, "^([^|]+)\\|(.*)$", 1)
    region = F.regexp_extract(chosen, "^([^|]+)\\|(.*)$", 2)
    asin = F.when(by_hand, F.when(text.catalog_id(own), own).otherwise("")).otherwise(split)
    return F.struct(asin.alias("asin"), F.when(asin == "", "").when(by_hand, default_region).otherwise(region).alias("region"), (asin != "").alias("ok"))


def split_id(metadata_id: Column, regions: tuple[str, ...], default_region: Column) -> Column:
    """struct(asin, region) of "id_region"; a region that is unknown or missing is the default one."""
    region = F.lower(F.regexp_extract(metadata_id, "^[^_]*_(.*)$", 1))
    return F.struct(F.regexp_extract(metadata_id, "^[^_]*", 0).alias("asin"), F.when(region.isin(*regions), region).otherwise(default_region).alias("region"))


def query_escape(c: Column) -> Column:
    """As in a query: all but letters, digits and -_.~ escaped, spaces as '+'."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def path_escape(c: Column) -> Column:
    return F.replace(query_escape(c), F.lit("+"), F.lit("%20"))


def unquoted(c: Column) -> Column:
    """Percent escapes decoded; a '+' stays."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def encoded(params: dict[str, Column]) -> Column:
    """Parameters by key, those that are '' or null left out, so equal requests have equal addresses."""
    pairs = [F.when(v != "", F.concat(F.lit(f"{k}="), query_escape(v))) for k, v in sorted(params.items())]
    return F.concat_ws("&", *pairs)


# Top-level domains of regions, and what a catalog is asked for.
DOMAINS = {"us": ".com", "ca": ".ca", "uk": ".co.uk", "au": ".com.au", "fr": ".fr", "de": ".de", "jp": ".co.jp", "it": ".it", "in": ".in", "es": ".es"}
SEARCH_PARAMS = {"num_results": "25", "products_sort_by": "Relevance", "response_groups": "contributors,product_desc,media,product_attrs", "image_sizes": "500,1000"}
PRODUCT_PARAMS = {"response_groups": "contributors,product_desc,media,product_attrs,product_extended_attrs,series,category_ladders", "image_sizes": "500,1000"}


def _catalog(region: Column) -> Column:
    """Null for an unknown region."""
    table = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    return F.concat(F.lit("https://api.audible"), F.try_element_at(table, region), F.lit("/1.0/catalog/products"))


def search_url(region: Column, keywords: Column, title: Column, author: Column) -> Column:
    fixed = {k: F.lit(v) for k, v in SEARCH_PARAMS.items()}
    return F.concat(_catalog(region), F.lit("?"), encoded(fixed | {"keywords": keywords, "title": title, "author": author}))


def product_url(region: Column, asin: Column) -> Column:
    return F.concat(_catalog(region), F.lit("/"), path_escape(asin), F.lit("?"), encoded({k: F.lit(v) for k, v in PRODUCT_PARAMS.items()}))


def named_parts(path: Column) -> Column:
    """struct(keywords, author, title) guessed from a name; a name that is nothing but digits or junk stands for itself."""
    base = text.base_name(path)
    parts = lambda k, g: F.struct(k.alias("keywords"), g["author"].alias("author"), g["title"].alias("title"))
    return text.let(F.coalesce(text.known(text.normalized_name(base)), base), lambda k: text.let(text.author_title(k), lambda g: parts(k, g)))


def import_items(selection: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Selected paths (key, path) as items to match: files below each, whether its only file has a chapter text, and guesses from its name."""
    chosen = paths.deduped_selection(selection, key)
    audio = files.select("rel_path").where(paths.is_audio(text.base_name(F.col("rel_path"))) & ~paths.in_junk(F.col("rel_path")))
    reach = audio.withColumn("path", F.explode(F.array_distinct(F.concat(paths.ancestors(F.col("rel_path")), F.array("rel_path")))))
    texts = files.select(F.col("rel_path").alias("_text"))
    one = chosen.select(key, "path").join(reach, "path").groupBy(key, "path").agg(F.count("*").alias("files"), F.min("rel_path").alias("first_file"))
    with_text = one.join(texts, paths.sidecar_path(F.col("first_file")) == F.col("_text"), "left")
    items = chosen.select(key, "path").join(with_text.select(F.col(key).alias("_k"), F.col("path").alias("_p"), "files", "_text"), (F.col(key) == F.col("_k")) & (F.col("path") == F.col("_p")), "left")
    n = F.coalesce("files", F.lit(0))
    return items.select(key, "path", n.cast("long").alias("files"), ((n == 1) & F.col("_text").isNotNull()).alias("has_sidecar"), named_parts(F.col("path")).alias("guess"))


def retag_items(files: DataFrame) -> DataFrame:
    """Library files (rel_path, tags; null tags where a file cannot be read) as items: what their tags claim, else what their name says."""
    book = tags.book(F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>")))
    base = text.base_name(F.col("rel_path"))
    stem = text.without_extension(base)
    keywords = F.coalesce(text.known(text.normalized_name(stem)), base)
    out = files.where(F.lower(F.col("rel_path")).endswith(".m4b")).withColumn("_b", book).withColumn("_g", text.author_title(keywords))
    titled = F.col("_b.title") != ""
    author = F.when(titled, F.coalesce(F.try_element_at("_b.authors", F.lit(1)), F.lit(""))).otherwise(F.col("_g.author"))
    title = F.when(titled, F.col("_b.title")).otherwise(F.col("_g.title"))
    return out.select("rel_path", F.col("_b.asin").alias("asin"), author.alias("author"), title.alias("title"), text.trimmed(F.concat_ws(" ", author, title)).alias("keywords"))


def looked_up(typed: DataFrame, records: DataFrame, default_region: str) -> DataFrame:
    """Typed ids (asin, region) with their record (asin, region, title) or what is wrong."""
    asked = typed.withColumn("region", F.coalesce(text.known(F.col("region")), F.lit(default_region))).withColumn("_shape", text.catalog_id(F.col("asin")))
    side = records.select(F.col("asin").alias("_a"), F.col("region").alias("_r"), "title")
    out = asked.join(side, (F.col("asin") == F.col("_a")) & (F.col("region") == F.col("_r")) & F.col("_shape"), "left")
    problem = F.when(~F.col("_shape"), "not ten letters or digits").when(F.col("_a").isNull(), F.concat(F.lit("no record "), F.col("asin"), F.lit(" in region "), F.col("region"))).otherwise("")
    return out.withColumn("problem", problem).drop("_a", "_r", "_shape")


def series_line(b: Column) -> Column:
    return F.when(b["series_name"] == "", "").when(b["series_position"] != "", F.concat(b["series_name"], F.lit(", Book "), b["series_position"])).otherwise(b["series_name"])


def runtime_badge(official_ms: Column, local_ms: Column) -> Column:
    """struct(badge, note): how an official running time compares with the local files'."""
    known = (official_ms > 0) & (local_ms > 0)

    def noted(band: Column) -> Column:
        delta = clock.delta_text(band["delta"])
        note = F.when(band["band"] == "exact", "same running time").when(band["band"] == "off", F.concat(delta, F.lit(", likely another edition"))).otherwise(F.concat(delta, F.lit(" than the files")))
        return F.struct(F.when(known, band["band"]).otherwise("").alias("badge"), F.when(known, note).otherwise("").alias("note"))

    return text.let(match.runtime_band(clock.runtime_minutes(official_ms).cast("int"), clock.runtime_minutes(local_ms).cast("int")), noted)


def row_summary(b: Column, chapter_ms: Column, local_ms: Column) -> Column:
    """struct(authors, series, official_ms, badge, note): the chapters' running time goes before the record's minutes."""
    official = F.coalesce(F.when(chapter_ms > 0, chapter_ms), b["runtime_min"].cast("long") * 60_000)
    row = lambda badge: F.struct(F.array_join(b["authors"], ", ").alias("authors"), series_line(b).alias("series"), official.alias("official_ms"), badge["badge"].alias("badge"), badge["note"].alias("note"))
    return text.let(runtime_badge(official, local_ms), row)


def file_preview(files: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Files with start and end on their book's timeline, stamps, and where to listen to the end: six seconds before it."""
    earlier = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = files.withColumn("start_ms", F.coalesce(F.sum("duration_ms").over(earlier), F.lit(0)).cast("long"))
    out = out.withColumn("end_ms", F.col("start_ms") + F.col("duration_ms")).withColumn("end_seek_ms", F.greatest(F.col("start_ms"), F.col("end_ms") - 6000))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return out.withColumn("place", place).withColumn("stamp", clock.clock_text(F.col("start_ms"))).withColumn("length", clock.clock_text(F.col("duration_ms")))


def chapter_listing(chapters: Column) -> Column:
    """Chapters as shown: title, start and its stamp."""
    return F.transform(chapters, lambda c: F.struct(c["title"].alias("title"), c["start_ms"].alias("start_ms"), clock.clock_text(c["start_ms"]).alias("stamp")))


def overflow(files: DataFrame, key: str) -> DataFrame:
    """(key, overflowed, header_ms): files whose header's length is wrong, and what the first one's says."""
    wrong = F.col("header_ms") > 0
    return files.groupBy(key).agg(F.count_if(wrong).alias("overflowed"), F.min_by("header_ms", F.when(wrong, F.col("pos"))).alias("first_header_ms"))


def pages(n: Column, size: int) -> Column:
    """Pages of ``size`` rows, one at least."""
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("long")


def library_entries(entries: DataFrame) -> DataFrame:
    """What a library lists: folders and the one kind of file that can be tagged again."""
    return entries.where(F.col("is_dir") | F.lower(F.col("name")).endswith(".m4b"))


def writes_sidecar(setting: Column, files: Column, has_sidecar: Column) -> Column:
    """Whether a finished record gets a chapter text: where settings ask for it, or its only file had one."""
    return setting | ((files == 1) & has_sidecar)


def provider_chapters(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Jobs (asin, region, chapter_mode) with a catalog's chapters: none for jobs that keep their own or have no id; missing ones are no error."""
    side = chapters.select(F.col("asin").alias("_a"), F.col("region").alias("_r"), "chapters")
    asked = (F.col("chapter_mode") != "existing") & (F.col("asin") != "")
    out = jobs.join(side, (F.col("asin") == F.col("_a")) & (F.col("region") == F.col("_r")) & asked, "left").drop("_a", "_r")
    return out.withColumn("note", F.when(~asked, "").when(F.col("chapters").isNull(), F.concat(F.lit("no chapters for "), F.col("asin"))).otherwise(""))


def cover_choice(by_hand: Column, catalog_url: Column, embedded: Column) -> Column:
    """struct(source, value): a cover chosen by hand, else the catalog's at its best size, else the file's own."""
    from ..sources.payloads import cover_at

    hand, url = text.known(by_hand), text.known(catalog_url)
    source = F.when(hand.isNotNull(), "hand").when(url.isNotNull(), "catalog").when(embedded.isNotNull(), "embedded").otherwise("")
    return F.struct(source.alias("source"), F.coalesce(hand, cover_at(url, 2000), F.lit("")).alias("value"))


def memo(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Wanted rows (key, signature) with the stored value (key, signature, value) of that very signature; null where it is stale or missing."""
    return wanted.join(stored.select(*key, "signature", "value"), [*key, "signature"], "left")
