"""Captured JSON and XML payloads to records, by declared schemas; unknown fields are never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, entities, text

_NAMES = "array<struct<name:string>>"
SEARCH = (
    f"struct<products:array<struct<asin:string,title:string,subtitle:string,authors:{_NAMES},narrators:{_NAMES},release_date:string,"
    "runtime_length_min:int,language:string,product_images:map<string,string>,content_type:string,content_delivery_type:string>>>"
)
PRODUCT = (
    f"struct<product:struct<asin:string,title:string,subtitle:string,authors:{_NAMES},narrators:{_NAMES},release_date:string,"
    "runtime_length_min:int,language:string,product_images:map<string,string>,content_type:string,content_delivery_type:string,"
    "publisher_name:string,publisher_summary:string,merchandising_summary:string,series:array<struct<title:string,sequence:string>>,"
    "category_ladders:array<struct<ladder:array<struct<name:string>>>>>>"
)
SECONDARY = (
    "struct<asin:string,title:string,subtitle:string,authors:array<struct<asin:string,name:string>>,narrators:array<struct<name:string>>,"
    "publisherName:string,releaseDate:string,runtimeLengthMin:int,language:string,image:string,description:string,summary:string,"
    "seriesPrimary:struct<name:string,position:string>,genres:array<struct<name:string,type:string>>,literatureType:string,rating:string>"
)
CHAPTERS = "struct<asin:string,brandIntroDurationMs:bigint,brandOutroDurationMs:bigint,isAccurate:boolean,runtimeLengthMs:bigint,chapters:array<struct<title:string,startOffsetMs:bigint,lengthMs:bigint>>>"
PROBE = (
    "struct<format:struct<format_name:string,duration:string,bit_rate:string,size:string,tags:map<string,string>>,"
    "streams:array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,bit_rate:string,time_base:string,duration_ts:bigint,nb_frames:string>>,"
    "chapters:array<struct<start_time:string,end_time:string,tags:struct<title:string>>>>"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def names(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(c, lambda a: _text(a["name"])), lambda n: n != ""), F.array().cast("array<string>"))


def is_podcast(content_type: Column, delivery: Column) -> Column:
    return (F.lower(_text(content_type)) == "podcast") | F.startswith(F.lower(_text(delivery)), F.lit("podcast"))


def cover(images: Column) -> Column:
    """The largest of a map of sizes; ''."""
    return F.coalesce(text.known(F.try_element_at(images, F.lit("1000"))), F.try_element_at(images, F.lit("500")), F.lit(""))


def cover_at(url: Column, px: int) -> Column:
    """An image address of the catalog's store at another size, whether it names one or not; others stay."""
    return F.regexp_replace(url, r"^(https://[^/]*(?:media-amazon|images-amazon)\.com/images/I/[^./]+)(?:\._[A-Za-z0-9,_]+_)?\.jpg$", f"$1._SL{px}_.jpg")


def search_results(rows: DataFrame, body: str = "body") -> DataFrame:
    """Candidates of search answers (q_id, region, body): pos is the place in the answer among those kept."""
    exploded = rows.select("q_id", "region", F.posexplode(F.from_json(F.col(body), SEARCH)["products"]).alias("_at", "p"))
    p = F.col("p")
    kept = exploded.where((_text(p["asin"]) != "") & (_text(p["title"]) != "") & ~is_podcast(p["content_type"], p["content_delivery_type"]))
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("q_id", "region").orderBy("_at")) - 1
    return kept.select(
        "q_id",
        "region",
        pos.alias("pos"),
        p["asin"].alias("asin"),
        p["title"].alias("title"),
        _text(p["subtitle"]).alias("subtitle"),
        names(p["authors"]).alias("authors"),
        names(p["narrators"]).alias("narrators"),
        clock.year_before_dash(_text(p["release_date"])).alias("year"),
        _text(p["language"]).alias("language"),
        F.coalesce(p["runtime_length_min"], F.lit(0)).alias("runtime_min"),
        cover(p["product_images"]).alias("cover_url"),
    )


def ladders(c: Column) -> Column:
    """Category ladders as paths of names."""
    paths = F.transform(F.coalesce(c, F.array().cast("array<struct<ladder:array<struct<name:string>>>>")), lambda x: names(x["ladder"]))
    return F.filter(paths, lambda p: F.size(p) > 0)


def primary_series(series: Column) -> Column:
    """struct(name, position): the first numbered series, else the first, whose position is then unknown."""
    numbered = F.try_element_at(F.filter(series, lambda s: _text(s["sequence"]) != ""), F.lit(1))
    return F.struct(_text(F.coalesce(numbered["title"], F.try_element_at(series, F.lit(1))["title"])).alias("name"), _text(numbered["sequence"]).alias("position"))


def product_book(body: Column) -> Column:
    """A product answer as a record; null where it has no title (not found)."""
    return text.let(F.from_json(body, PRODUCT)["product"], _product_book)


def _product_book(p: Column) -> Column:
    paths = ladders(p["category_ladders"])
    series = primary_series(p["series"])
    firsts = F.array_distinct(F.transform(paths, lambda x: F.element_at(x, 1)))
    below = F.array_distinct(F.flatten(F.transform(paths, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))))
    book = F.struct(
        _text(p["title"]).alias("title"),
        _text(p["subtitle"]).alias("subtitle"),
        names(p["authors"]).alias("authors"),
        names(p["narrators"]).alias("narrators"),
        series["name"].alias("series_name"),
        series["position"].alias("series_position"),
        clock.year_before_dash(_text(p["release_date"])).alias("year"),
        _text(p["release_date"]).alias("release_date"),
        _text(p["publisher_name"]).alias("publisher"),
        _text(p["language"]).alias("language"),
        firsts.alias("genres"),
        below.alias("sub_genres"),
        paths.alias("genre_paths"),
        F.lit("").alias("literature_type"),
        text.html_text(_text(p["merchandising_summary"])).alias("description"),
        text.html_text(_text(p["publisher_summary"])).alias("summary"),
        F.coalesce(p["runtime_length_min"], F.lit(0)).alias("runtime_min"),
        cover(p["product_images"]).alias("cover_url"),
    )
    return F.when(_text(p["title"]) != "", book)


def secondary_book(body: Column) -> Column:
    """A secondary catalog's record; null where it has no title."""
    return text.let(F.from_json(body, SECONDARY), _secondary_book)


def _secondary_book(b: Column) -> Column:
    typed = lambda kind: F.coalesce(F.transform(F.filter(b["genres"], lambda g: g["type"] == kind), lambda g: g["name"]), F.array().cast("array<string>"))
    date = F.left(_text(b["releaseDate"]), F.lit(10))
    book = F.struct(
        _text(b["title"]).alias("title"),
        _text(b["subtitle"]).alias("subtitle"),
        names(b["authors"]).alias("authors"),
        names(b["narrators"]).alias("narrators"),
        _text(b["seriesPrimary"]["name"]).alias("series_name"),
        _text(b["seriesPrimary"]["position"]).alias("series_position"),
        F.left(date, F.lit(4)).alias("year"),
        date.alias("release_date"),
        _text(b["publisherName"]).alias("publisher"),
        _text(b["language"]).alias("language"),
        typed("genre").alias("genres"),
        typed("tag").alias("sub_genres"),
        F.array().cast("array<array<string>>").alias("genre_paths"),
        _text(b["literatureType"]).alias("literature_type"),
        text.html_text(_text(b["description"])).alias("description"),
        text.html_text(_text(b["summary"])).alias("summary"),
        F.coalesce(b["runtimeLengthMin"], F.lit(0)).alias("runtime_min"),
        _text(b["image"]).alias("cover_url"),
    )
    return F.when(_text(b["title"]) != "", book)


def chapter_list(body: Column) -> Column:
    """struct(chapters, runtime_ms, accurate, intro_ms, outro_ms) of a chapters answer."""
    b = F.from_json(body, CHAPTERS)
    return F.struct(
        F.transform(b["chapters"], lambda c: F.struct(c["title"].alias("title"), c["startOffsetMs"].alias("start_ms"), c["lengthMs"].alias("length_ms"))).alias("chapters"),
        b["runtimeLengthMs"].alias("runtime_ms"),
        F.coalesce(b["isAccurate"], F.lit(False)).alias("accurate"),
        F.coalesce(b["brandIntroDurationMs"], F.lit(0)).alias("intro_ms"),
        F.coalesce(b["brandOutroDurationMs"], F.lit(0)).alias("outro_ms"),
    )


def authors(body: Column) -> Column:
    """Author answers, an object or a list of them, as a list of those with an id and a name."""
    one = "struct<asin:string,name:string,image:string,description:string>"
    many = F.coalesce(F.from_json(body, f"array<{one}>"), F.array(F.from_json(body, one)))
    return F.filter(many, lambda a: (_text(a["asin"]) != "") & (_text(a["name"]) != ""))


def probe(body: Column) -> Column:
    """struct of a probe's answer: duration, rates, codec, container, chapters, tags, and whether the header was cut off."""
    return text.let(F.from_json(body, PROBE), _probe)


def _probe(b: Column) -> Column:
    audio = F.try_element_at(F.filter(b["streams"], lambda s: s["codec_type"] == "audio"), F.lit(1))
    header = clock.seconds_ms(_text(b["format"]["duration"]))
    real = clock.unwrapped_ms(audio["codec_name"], audio["time_base"], audio["duration_ts"], audio["nb_frames"].try_cast("long"))
    duration = F.coalesce(real, header)
    rate = F.coalesce(F.nullif(clock.rate_kbps(_text(audio["bit_rate"])), F.lit(0)), clock.rate_kbps(_text(b["format"]["bit_rate"])))
    raw = F.transform(b["chapters"], lambda c: F.struct(_text(c["tags"]["title"]).alias("title"), clock.seconds_ms(c["start_time"]).alias("start_ms"), clock.seconds_ms(c["end_time"]).alias("end_ms")))
    from ..operators.chapters import extended_last

    return F.struct(
        duration.alias("duration_ms"),
        rate.alias("bitrate_kbps"),
        F.coalesce(audio["sample_rate"].try_cast("int"), F.lit(0)).alias("sample_rate"),
        F.coalesce(audio["channels"], F.lit(0)).alias("channels"),
        _text(audio["codec_name"]).alias("codec"),
        _text(b["format"]["format_name"]).alias("container"),
        F.when(real.isNotNull(), header).otherwise(F.lit(0).cast("long")).alias("header_ms"),
        real.isNotNull().alias("chapters_truncated"),
        F.when(real.isNotNull(), extended_last(raw, header, duration)).otherwise(raw).alias("chapters"),
        F.coalesce(b["format"]["tags"], F.create_map().cast("map<string,string>")).alias("tags"),
    )


def _chapter_lines(body: Column) -> Column:
    """Start times and titles of a chapter file's lines, in order: plain and numbered forms."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(body, "^\\x{FEFF}", ""), "\n"), text.trimmed), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    plain = "^([0-9]+):([0-9]{1,2}):([0-9]{1,2})(?:[.,]([0-9]+))?(?:[\\t\\n\\f\\r ]+(.*))?$"
    timed = "(?i)^CHAPTER([0-9]+)=([0-9]+):([0-9]{1,2}):([0-9]{1,2})(?:[.,]([0-9]+))?$"
    named = "(?i)^CHAPTER([0-9]+)NAME=(.*)$"
    group = F.regexp_extract

    def row(x: Column) -> Column:
        is_plain, is_timed = x.rlike(plain), x.rlike(timed)
        start = F.when(is_plain, clock.clock_ms(group(x, plain, 1), group(x, plain, 2), group(x, plain, 3), group(x, plain, 4))).when(is_timed, clock.clock_ms(group(x, timed, 2), group(x, timed, 3), group(x, timed, 4), group(x, timed, 5)))
        label = F.when(is_timed, group(x, timed, 1))
        names_it = F.when(~is_plain & ~is_timed & x.rlike(named), group(x, named, 1))
        title = F.when(is_plain, text.trimmed(group(x, plain, 5))).when(names_it.isNotNull(), text.trimmed(group(x, named, 2)))
        return F.struct(start.alias("start"), label.alias("label"), names_it.alias("names"), title.alias("title"))

    return F.transform(lines, row)


def sidecar(body: Column, duration: Column) -> Column:
    """struct(chapters, reason) of a chapter text file; none and why, where its starts are out of order or past the end."""

    def judged(named: Column) -> Column:
        n = F.size(named)
        chapters = F.transform(named, lambda c, i: F.struct(F.when(c["title"] == "", F.format_string("Chapter %02d", i + 1)).otherwise(c["title"]).alias("title"), c["start"].alias("start_ms"), F.when(i + 1 < n, F.get(named, i + 1)["start"]).otherwise(duration).alias("end_ms")))
        late = F.exists(named, lambda c: (duration > 0) & (c["start"] >= duration))
        mixed = F.exists(F.transform(named, lambda c, i: F.coalesce(c["start"] < F.get(named, i - 1)["start"], F.lit(False))), lambda x: x)
        reason = F.when(mixed, "starts out of order").when(late, "starts after the audio ends")
        return F.struct(F.when(reason.isNull(), chapters).alias("chapters"), reason.alias("reason"))

    def joined(rows: Column) -> Column:
        titles = F.filter(rows, lambda r: r["names"].isNotNull())
        return F.transform(F.filter(rows, lambda r: r["start"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), F.coalesce(s["title"], F.try_element_at(F.filter(titles, lambda t: t["names"] == s["label"]), F.lit(-1))["title"], F.lit("")).alias("title")))

    return text.let(_chapter_lines(body), lambda rows: text.let(joined(rows), judged))


def tree_entries(body: Column) -> Column:
    """A media server's nested items (index, parts) as one ordered list of (path, duration_ms): unnumbered last."""
    item = "struct<index:int,media:array<struct<parts:array<struct<file:string,duration:bigint>>>>>"
    items = F.from_json(body, f"array<{item}>")
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(x["index"].isNull().alias("n"), x["index"].alias("x"), i.alias("i"), x["media"].alias("m"))))
    return F.flatten(F.transform(keyed, lambda k: F.flatten(F.transform(k["m"], lambda m: F.transform(m["parts"], lambda p: F.struct(p["file"].alias("path"), F.coalesce(p["duration"], F.lit(0)).alias("duration_ms")))))))


def library_item(xml: Column) -> Column:
    """struct(section, key, collections) of a server's item answer."""
    return F.struct(
        F.coalesce(F.call_function("xpath_string", xml, F.lit("/MediaContainer/@librarySectionID")), F.lit("")).alias("section"),
        F.coalesce(F.call_function("xpath_string", xml, F.lit("/MediaContainer/*[1]/@ratingKey")), F.lit("")).alias("key"),
        F.call_function("xpath", xml, F.lit("/MediaContainer/*[1]/Collection/@tag")).alias("collections"),
    )


def with_collection(existing: Column, wanted: Column) -> Column:
    """The collections with one more, unless it is there in any case."""
    return F.when(F.exists(existing, lambda e: F.lower(e) == F.lower(wanted)), existing).otherwise(F.concat(existing, F.array(wanted)))


def query_string(params: Column) -> Column:
    """A map as sorted, encoded parameters; empty values are left out."""
    kept = F.array_sort(F.filter(F.map_entries(params), lambda e: _text(e["value"]) != ""))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def lenient_reply(reply: Column) -> Column:
    """struct(book, warnings) of a written answer that holds JSON: fenced or between the outermost braces; numbers
    as texts, texts as lists, "unknown" as nothing."""
    fenced = F.regexp_extract(reply, "(?s)```(?:json)?[\\t\\n\\f\\r ]*(\\{.*?\\})[\\t\\n\\f\\r ]*```", 1)
    outer = F.regexp_extract(reply, "(?s)(\\{.*\\})", 1)
    return text.let(F.coalesce(text.known(fenced), outer), lambda raw: text.let(F.from_json(raw, "map<string,string>"), lambda parsed: _reply(raw, parsed)))


def _reply(raw: Column, parsed: Column) -> Column:
    unknown = lambda v: F.lower(text.trimmed(v)).isin("", "unknown", "n/a", "null", "none")
    value = lambda k: F.coalesce(F.when(~unknown(F.try_element_at(parsed, F.lit(k))), text.trimmed(F.try_element_at(parsed, F.lit(k)))), F.lit(""))

    def items(k: str) -> Column:
        v = value(k)
        return F.filter(text.distinct_in_order(F.coalesce(F.from_json(v, "array<string>"), F.split(v, "[;,]"))), lambda x: ~unknown(x))

    fields = ("title", "subtitle", "series_name", "series_position", "publisher", "language", "summary")
    bad = F.when(raw == "", "no JSON").when(parsed.isNull() | (F.size(parsed) == 0), "broken JSON").when((value("title") == "") & (F.size(items("authors")) == 0), "not about a book")
    book = F.struct(*[value(k).alias(k) for k in fields], clock.leading_year(value("year")).alias("year"), *[items(k).alias(k) for k in ("authors", "narrators", "genres")])
    return F.struct(F.when(bad.isNull(), book).alias("book"), F.array_compact(F.array(bad)).alias("warnings"))


def unescaped(c: Column) -> Column:
    """All character references, over the full table."""
    return entities.unescape(c)
