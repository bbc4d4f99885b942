"""File trees as tables: junk and audio filters, grouping by folder, orders, selections, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

# Audio extensions, and names that are no content.
AUDIO = (".mp3", ".m4a", ".m4b", ".aac", ".flac", ".ogg", ".opus", ".wma", ".wav")
JUNK = ("@eaDir", ".DS_Store", "Thumbs.db", "desktop.ini", "$RECYCLE.BIN", "#recycle", ".Trash")
SEARCH_CAP = 200


def is_audio(name: Column) -> Column:
    return F.lower(text.extension(name)).isin(*AUDIO)


def is_junk(name: Column) -> Column:
    return name.isin(*JUNK) | F.startswith(name, F.lit("."))


def in_junk(rel_path: Column) -> Column:
    """Whether any component of a path is junk, which hides all below it."""
    return F.exists(F.split(rel_path, "/"), is_junk)


def parent(rel_path: Column) -> Column:
    return F.regexp_extract(rel_path, "^(.*)/[^/]*$", 1)


def cleaned_path(path: Column) -> Column:
    """Lexically clean: no empty, '.' or inner '..' components; '.' for nothing left; '..' may lead a relative path."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))
    none = F.array().cast("array<string>")

    def step(acc: Column, c: Column) -> Column:
        up = (c == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((c == "..") & rooted, acc).otherwise(F.concat(acc, F.array(c)))

    joined = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def confined(rel: Column) -> Column:
    """A request path cleaned, null where it is absolute, has a backslash or leaves its root."""
    s = text.trimmed(rel)
    clean = cleaned_path(s)
    bad = F.startswith(s, F.lit("/")) | F.contains(s, F.lit("\\")) | s.rlike("^[A-Za-z]:") | (clean == "..") | F.startswith(clean, F.lit("../"))
    return F.when((s == "") | (s == "."), F.lit(".")).when(~bad, clean)


def disc_number(name: Column) -> Column:
    """The number of a disc folder, null for another name."""
    return F.regexp_extract(text.trimmed(name), "(?i)^(?:cd|disc|disk|part)[\\t\\n\\f\\r _.-]*([0-9]+)\\z", 1).try_cast("long")


def children(entries: DataFrame) -> DataFrame:
    """(parent, audio_files, sub_dirs) of every folder with any, junk left out; one partial aggregation."""
    seen = entries.where(~in_junk(F.col("rel_path"))).withColumn("parent", parent(F.col("rel_path")))
    return seen.groupBy("parent").agg(F.count_if(~F.col("is_dir") & is_audio(F.col("rel_path"))).cast("int").alias("audio_files"), F.count_if(F.col("is_dir")).cast("int").alias("sub_dirs"))


def listing(entries: DataFrame, folder: str, newest_first: bool) -> DataFrame:
    """One level of a tree: audio files and folders that hold any or more folders; folders first.

    A top level lists folders by time, newest first; all else is in natural order.
    """
    own = entries.where((parent(F.col("rel_path")) == folder) & ~in_junk(F.col("rel_path")))
    counts = children(entries).withColumnRenamed("parent", "_p")
    rows = own.join(counts, F.col("rel_path") == F.col("_p"), "left").drop("_p").na.fill(0, ["audio_files", "sub_dirs"])
    kept = rows.where((F.col("is_dir") & (F.col("audio_files") + F.col("sub_dirs") > 0)) | (~F.col("is_dir") & is_audio(F.col("rel_path"))))
    name = text.base_name(F.col("rel_path"))
    order = [F.desc("is_dir"), F.when(F.col("is_dir") & F.lit(newest_first), F.col("mtime")).desc(), text.natural_key(name), name]
    return kept.withColumn("name", name).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(folder)).orderBy(*order)))


def merge_order(files: DataFrame, key: str = "root") -> DataFrame:
    """Adds place: the order in which a book's audio files are merged: plain folders, then discs by number, then natural."""
    folder = parent(F.col("rel_path"))
    disc = disc_number(text.base_name(folder))
    base = text.base_name(F.col("rel_path"))
    order = [disc.isNotNull(), F.coalesce(disc, F.lit(0)), text.natural_key(folder), folder, text.natural_key(base), base]
    kept = files.where(is_audio(F.col("rel_path")) & ~in_junk(F.col("rel_path")))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def by_folder(files: DataFrame, key: str = "root") -> DataFrame:
    """(key, folder, files in natural order)"""
    base = text.base_name(F.col("rel_path"))
    item = F.struct(text.natural_key(base).alias("k"), base.alias("b"), F.col("rel_path").alias("p"))
    grouped = files.where(is_audio(F.col("rel_path"))).groupBy(key, parent(F.col("rel_path")).alias("folder")).agg(F.array_sort(F.collect_list(item)).alias("f"))
    return grouped.select(key, "folder", F.transform("f", lambda x: x["p"]).alias("files"))


def ancestors(path: Column) -> Column:
    """All proper prefixes of a slash path, longest last; the path itself is not among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def deduped_selection(selection: DataFrame, key: str = "id") -> DataFrame:
    """(key, path, pos): a selection in its order without repeats and without what another selected folder holds.

    An equality anti-join on exploded ancestors, not a range join.
    """
    clean = selection.withColumn("path", cleaned_path(F.replace("path", F.lit("\\"), F.lit("/"))))
    once = clean.groupBy(key, "path").agg(F.min("pos").alias("pos"))
    up = once.withColumn("up", F.explode(ancestors(F.col("path")))).where("up <> path and up <> ''")
    covered = up.join(once.select(F.col(key), F.col("path").alias("up")), [key, "up"], "left_semi").select(key, "path").distinct()
    return once.join(covered, [key, "path"], "left_anti")


def selected_files(files: DataFrame, selection: DataFrame, key: str = "id") -> DataFrame:
    """(key, rel_path): audio files that a selection names or that lie in a folder it names, once each."""
    reach = files.where(is_audio(F.col("rel_path")) & ~in_junk(F.col("rel_path"))).withColumn("path", F.explode(F.array_distinct(F.concat(ancestors(F.col("rel_path")), F.array("rel_path")))))
    return reach.join(selection.select(key, "path"), "path").select(key, "rel_path").distinct()


def matching(rel_path: Column, query: str) -> Column:
    """Every term of a query somewhere in the path, without case; no terms match nothing."""
    terms = query.lower().split()
    if not terms:
        return F.lit(False)
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(F.lower(rel_path), F.lit(t))
    return out


def search(entries: DataFrame, query: str, cap: int = SEARCH_CAP) -> DataFrame:
    """Folders and books that match, natural order, with the total: the first ``cap`` in walk order are shown."""
    books = F.col("is_dir") | (F.lower(text.extension(F.col("rel_path"))) == ".m4b")
    hits = entries.where(~in_junk(F.col("rel_path")) & books & matching(F.col("rel_path"), query))
    total = hits.agg(F.count("*").alias("total"))
    shown = hits.withColumn("_walk", F.split("rel_path", "/")).orderBy("_walk").limit(cap)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("is_dir"), text.natural_key(F.col("rel_path")), "rel_path")
    return shown.withColumn("place", F.row_number().over(w)).drop("_walk").crossJoin(F.broadcast(total))  # one row


def path_tokens(path: Column) -> Column:
    """struct(id, region): the bracketed catalog id and region nearest the file."""
    inner = F.reverse(F.split(path, "/"))
    found = F.flatten(F.transform(inner, lambda c: F.regexp_extract_all(c, F.lit("\\[([A-Za-z0-9]+)\\]"), F.lit(1))))

    def told(found: Column) -> Column:
        ident = F.try_element_at(F.filter(found, text.catalog_id_token), F.lit(1))
        region = F.try_element_at(F.filter(F.transform(found, F.lower), lambda t: t.isin("us", "uk", "au", "ca", "in", "de", "fr", "es", "it", "jp")), F.lit(1))
        return F.struct(F.coalesce(ident, F.lit("")).alias("id"), F.coalesce(region, F.lit("")).alias("region"))

    return text.let(found, told)


def typed_tokens(typed: Column) -> Column:
    """struct(id, region, rest) of a typed search."""
    regions = F.filter(F.transform(F.regexp_extract_all(typed, F.lit("\\[([A-Za-z]{2})\\]"), F.lit(1)), F.lower), lambda t: t.isin("us", "uk", "au", "ca", "in", "de", "fr", "es", "it", "jp"))
    bare = F.regexp_replace(typed, "\\[[A-Za-z]{2}\\]", " ")
    words = F.filter(F.transform(F.regexp_extract_all(bare, F.lit("(?<![A-Za-z0-9_])([A-Za-z0-9]{10})(?![A-Za-z0-9_])"), F.lit(1)), F.upper), text.catalog_id_token)
    return F.struct(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("id"), F.coalesce(F.try_element_at(regions, F.lit(1)), F.lit("")).alias("region"), text.trimmed(F.regexp_replace(bare, f"{text.WS}+", " ")).alias("rest"))


def sidecar_path(path: Column) -> Column:
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(text.extension(path))), F.lit(".chapters.txt"))


def signature(files: DataFrame, key: str) -> DataFrame:
    """(key, signature): a fingerprint of a group's paths, sizes and times."""
    part = F.concat_ws(":", "rel_path", F.col("size").cast("string"), F.unix_millis("mtime").cast("string"))
    return files.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256).alias("signature"))


def guarded_sum(rows: DataFrame, key: str, duration: str = "duration_ms") -> DataFrame:
    """(key, total): the sum of durations, 0 where any is unknown."""
    known = F.when(F.col(duration) > 0, F.col(duration))
    return rows.groupBy(key).agg(F.when(F.count("*") == F.count(known), F.sum(known)).otherwise(0).cast("long").alias("total"))
