"""Stored tables that are replaced, never changed: each write is a new version, read by its pointer.

A reader sees a whole version or the one before it, and a lost writer leaves the pointer
where it was. Formats and connectors beyond this are Spark's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all machines share; where that is unset, on this machine if all runs here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{n}/_SUCCESS")))


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The last whole version; empty before the first."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/versions/v{versions[-1]}")


def replace(df: DataFrame, root: str) -> int:
    """Write a new version; the old ones stay for readers until ``prune``."""
    n = ([0, *_versions(df.sparkSession, root)])[-1] + 1
    df.write.mode("overwrite").parquet(f"{root}/versions/v{n}")
    return n


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    for n in _versions(spark, root)[:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/v{n}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, is_dir, size, mtime) of a folder, recursively, empty folders too; contents are not read."""
    from .listing import folder_tree

    return folder_tree(spark, root, junk=True)


def tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` lines of a text file, in order, with their numbers from 0; blank lines at its end do not count.

    Lines are read by blocks and told apart by block start and place in it; only the last ones are sorted.
    """
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")).alias("at"), F.col("value").alias("line"))
    last = lines.where("line <> ''").agg(F.max("at").alias("last"))
    kept = lines.crossJoin(F.broadcast(last)).where("at <= last").drop("last")  # one row
    total = kept.agg(F.count("*").alias("total"))
    ends = kept.orderBy(F.desc("at")).limit(n).crossJoin(F.broadcast(total))  # one row
    back = F.row_number().over(Window.orderBy(F.desc("at")))  # of n rows
    return ends.select((F.col("total") - back).alias("line_no"), "line").orderBy("line_no")


def concat_list(paths):
    """Lines of a list file for a joiner, quotes escaped, in order."""
    return F.array_join(F.transform(paths, lambda p: F.concat(F.lit("file '"), F.replace(p, F.lit("'"), F.lit("'\\''")), F.lit("'\n"))), "")
