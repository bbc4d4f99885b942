"""Path search by a trigram index instead of a scan of all paths.

``build`` stores two tables: the entries, numbered in walk order and laid out by blocks of their numbers, and
the lists of entries of each trigram of the lower-case path, a row a trigram and block, so that no row grows with the
library. Lists lie in folders by a hash of their trigram and are sorted by it, so a search reads only the row groups
of the trigrams it asks for. Both searches intersect lists block by block, from the shortest, read only the blocks that
are left, and verify what they hold by ``paths.matching``. Terms under three characters have no trigram: they
are only verified, and a search made of such terms alone scans.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import paths
from .similar import grams

SIZE = 3
BLOCK = 1 << 16
FOLDERS = 64
#: Lists that one search intersects, the shortest ones; verification sees to the rest.
LISTS = 8


#: Blocks that a search names to the reader; one that leaves more reads all, and joins.
MANY_BLOCKS = 1000


@dataclass(frozen=True)
class PathIndex:
    spark: SparkSession
    root: str
    columns: str
    folders: int = FOLDERS

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, entry long, block long").parquet(f"{self.root}/entries")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema("gram string, block long, n int, held array<long>, folder int").parquet(f"{self.root}/lists")


def _folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(folders)).cast("int")


def build(entries: DataFrame, root: str, block: int = BLOCK, folders: int = FOLDERS) -> PathIndex:
    """An index of entries (rel_path, is_dir, ...) under ``root``, which must not exist."""
    spark = entries.sparkSession
    index = PathIndex(spark, root, ", ".join(f"`{n}` {t}" for n, t in entries.dtypes), folders)
    ordered = entries.withColumn("_walk", F.split("rel_path", "/")).repartitionByRange("_walk").sortWithinPartitions("_walk", "rel_path").drop("_walk")
    # numbers ascend in walk order; they hold once they are written, as lists are made of the written rows
    ordered.withColumn("entry", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("entry") / block)).write.partitionBy("block").parquet(f"{root}/entries")
    own = F.array_distinct(grams(F.lower("rel_path"), SIZE))
    lists = index.entries.select(F.explode(own).alias("gram"), "entry", "block").groupBy("gram", "block").agg(F.array_sort(F.collect_list("entry")).alias("held"))  # ``block`` numbers at most
    lists = lists.select("gram", "block", F.size("held").alias("n"), "held", _folder(F.col("gram"), folders).alias("folder"))
    lists.repartition("folder").sortWithinPartitions("folder", "gram", "block").write.partitionBy("folder").parquet(f"{root}/lists")
    return index


def query_grams(query: str) -> list[str]:
    """The distinct trigrams of a query's terms."""
    return list(dict.fromkeys(t[i : i + SIZE] for t in query.lower().split() for i in range(len(t) - SIZE + 1)))


def asked(index: PathIndex, wanted: list[str]) -> DataFrame:
    """The rows of the given trigrams' lists: their folders, and of these the row groups that may hold them."""
    folders = sorted({zlib.crc32(g.encode()) % index.folders for g in wanted})
    return index.lists.where(F.col("folder").isin(folders) & F.col("gram").isin(wanted))


def candidates(index: PathIndex, query: str) -> DataFrame:
    """Entries whose path has the query's rarest trigrams; all entries for a query without any."""
    wanted = query_grams(query)
    if not wanted:
        return index.entries if query.split() else index.entries.where(F.lit(False))
    if len(wanted) > LISTS:  # a row a trigram of the query
        sizes = {r["gram"]: r["n"] for r in asked(index, wanted).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        wanted = sorted(wanted, key=lambda g: (sizes.get(g, 0), g))[:LISTS]
    both = asked(index, wanted).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "held"))).alias("found")).where(F.size("found") == len(wanted))
    left = both.select("block", F.explode(_intersected(F.col("found"))).alias("entry"))
    blocks = [r["block"] for r in left.select("block").distinct().limit(MANY_BLOCKS + 1).collect()]
    entries = index.entries.where(F.col("block").isin(blocks)) if len(blocks) <= MANY_BLOCKS else index.entries
    return entries.join(left, ["block", "entry"], "left_semi")


def _intersected(found: Column) -> Column:
    """What all lists of an array hold, from the shortest: (n, gram, held) structs in order."""
    return F.aggregate(F.slice(found, F.lit(2), F.size(found)), found[0]["held"], lambda acc, x: F.array_intersect(acc, x["held"]))


def search(index: PathIndex, query: str, cap: int = paths.SEARCH_CAP) -> DataFrame:
    """As ``paths.search``, by the index."""
    return paths.search(candidates(index, query).drop("entry", "block"), query, cap)


def search_many(index: PathIndex, queries: DataFrame, lists: int = LISTS) -> DataFrame:
    """(query, entry columns): all entries that match each of the queries (query); junk and plain files too.

    Each query looks up its ``lists`` rarest trigrams; a trigram that many queries share is read once. Lists and entries
    compress so well that the sizes of their files and shuffles say little, so joins are told to merge, never to broadcast them.
    """
    terms = lambda q: F.filter(F.split(F.lower(F.trim(q)), "[\\t\\n\\x0B\\f\\r ]+"), lambda t: t != "")
    q = queries.select("query").where(F.col("query").isNotNull()).distinct().withColumn("terms", terms("query")).where(F.size("terms") > 0)
    q = q.withColumn("grams", F.array_distinct(F.flatten(F.transform("terms", lambda t: grams(t, SIZE)))))
    wanted = q.where(F.size("grams") > 0).select("query", F.explode("grams").alias("gram")).withColumn("folder", _folder(F.col("gram"), index.folders))
    sizes = index.lists.groupBy("folder", "gram").agg(F.sum("n").alias("total"))
    known = wanted.join(sizes.hint("merge"), ["folder", "gram"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    own = Window.partitionBy("query")
    rarest = known.withColumn("_r", F.row_number().over(own.orderBy("total", "gram"))).where(F.col("_r") <= lists).withColumn("need", F.count("*").over(own))
    met = rarest.select("query", "need", "gram", "folder").join(index.lists.hint("merge"), ["folder", "gram"]).groupBy("query", "need", "block").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "held"))).alias("found"))  # ``lists`` rows at most
    left = met.where(F.size("found") == F.col("need")).select("query", "block", F.explode(_intersected(F.col("found"))).alias("entry"))
    # queries without a trigram meet entries by their longest term, of one or two characters; entries show only such terms as are asked for
    short = q.where(F.size("grams") == 0).select("query", F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"].alias("gram"))
    asked_for = short.agg(F.collect_set("gram").alias("_asked"))  # one row, of terms of one or two characters
    path = F.lower("rel_path")
    shown = F.when(F.size("_asked") > 0, F.array_intersect(F.concat(grams(path, 1), grams(path, 2)), F.col("_asked")))
    every = index.entries.crossJoin(F.broadcast(asked_for)).withColumn("gram", F.explode(shown)).drop("_asked").join(short.hint("merge"), "gram").drop("gram", "entry", "block")
    hits = left.join(index.entries.hint("merge"), ["block", "entry"]).drop("entry", "block").unionByName(every)
    return hits.where(F.forall(terms("query"), lambda t: F.contains(F.lower("rel_path"), t)))
