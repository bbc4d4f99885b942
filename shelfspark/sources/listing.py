"""Folder trees listed by tasks, level by level, empty folders included.

The folders of a level are dealt among tasks, each of which lists its folders through a file system of its own (any
that Arrow knows by the root's address) and hands rows on as it finds them. A level is stored before the next is
listed, so the driver knows of none but how many folders there are, and a lost task lists its folders again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths
from . import tables

SCHEMA = "rel_path string, is_dir boolean, size long, mtime timestamp"
#: Folders that one task lists; deeper trees than DEPTH are taken for a loop of links.
FOLDERS, DEPTH, ROWS = 200, 200, 10_000
#: Hadoop's one-slash form of local addresses.
_LOCAL = "file:/"


def _address(root: str) -> str:
    if "://" in root:
        return root.rstrip("/") or root
    return "file://" + "/" + root.removeprefix(_LOCAL).strip("/")


def _listed(root: str):
    def run(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root)
        top = top.rstrip("/")
        for batch in batches:
            for folder in batch.column("rel_path").to_pylist():
                try:
                    found = system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/") or "/"))
                except FileNotFoundError:
                    continue  # gone since its parent was listed
                for a in range(0, len(found), ROWS):
                    rows = [(x.path.removeprefix(top).lstrip("/"), x.type == fs.FileType.Directory, x.size if x.type == fs.FileType.File else 0, x.mtime) for x in found[a : a + ROWS] if x.type in (fs.FileType.File, fs.FileType.Directory)]
                    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")), strict=True)], ["rel_path", "is_dir", "size", "mtime"])

    return run


def folder_tree(spark: SparkSession, root: str, junk: bool = False, folders: int = FOLDERS) -> DataFrame:
    """(rel_path, is_dir, size, mtime) of all that ``root`` holds; what junk folders hold is only listed with ``junk``."""
    address, stored = _address(root), tables.scratch(spark, "tree")
    level = spark.createDataFrame([("",)], "rel_path string")
    for depth in range(DEPTH):
        n = level.count()
        if not n:
            break
        dealt = level.repartition(max(1, -(-n // folders)), "rel_path")
        dealt.mapInArrow(_listed(address), SCHEMA).write.parquet(f"{stored}/level={depth}")
        found = spark.read.schema(SCHEMA).parquet(f"{stored}/level={depth}").where("is_dir")
        level = (found if junk else found.where(~paths.in_junk(F.col("rel_path")))).select("rel_path")
    else:
        raise RecursionError(f"folders are more than {DEPTH} levels deep")
    return spark.read.schema(SCHEMA).parquet(*[f"{stored}/level={i}" for i in range(depth)])
