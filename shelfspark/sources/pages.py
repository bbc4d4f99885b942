"""A table laid out in the order of its pages, so that any page reads the few files that hold it.

Files are cut from one global order (newest first) and described by a small table: rows, first and last key of each file.
A page by number finds its files from running sums of the counts, a page after a key from the keys; neither
sorts or skips the rows before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS = 100_000


@dataclass(frozen=True)
class Pages:
    spark: SparkSession
    root: str
    order: tuple[str, ...]

    def _files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/files")

    def _key(self):
        return F.struct(*self.order)

    def _rows(self, files: list[str]) -> DataFrame:
        whole = self.spark.read.parquet(f"{self.root}/rows")
        return self.spark.read.schema(whole.schema).parquet(*files) if files else whole.where(F.lit(False))

    def _newest(self) -> list:
        return [F.desc(c) for c in self.order]

    def count(self) -> int:
        return int(self._files().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1), newest first."""
        first = (number - 1) * size
        files = self._files().where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).orderBy("before").collect()  # those of one page
        skip = first - files[0]["before"] if files else 0
        return self._rows([r["file"] for r in files]).orderBy(*self._newest()).offset(skip).limit(size)

    def after(self, key: tuple, size: int) -> DataFrame:
        """The ``size`` rows after a key (values of the order's columns), newest first."""
        last = F.struct(*[F.lit(v).alias(c) for c, v in zip(self.order, key, strict=True)])
        # files in order until they hold enough rows; the first may hold fewer than it counts
        reached = self._files().where(F.col("least") < last).withColumn("_k", F.row_number().over(Window.orderBy("before")))
        w = Window.orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
        files = reached.withColumn("_held", F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("n")).otherwise(0)).over(w), F.lit(0))).where(F.col("_held") < size).collect()  # those of one page
        return self._rows([r["file"] for r in files]).where(self._key() < last).orderBy(*self._newest()).limit(size)


def write_pages(rows: DataFrame, root: str, order: tuple[str, ...], rows_a_file: int = ROWS) -> Pages:
    """Lay out rows by ``order`` (together unique), newest first."""
    spark = rows.sparkSession
    files = max(1, -(-rows.count() // rows_a_file))
    newest = [F.desc(c) for c in order]
    rows.repartitionByRange(files, *newest).sortWithinPartitions(*newest).write.option("maxRecordsPerFile", 2 * rows_a_file).parquet(f"{root}/rows")
    key = F.struct(*order)
    found = spark.read.parquet(f"{root}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.max(key).alias("most"), F.min(key).alias("least"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("most")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    found.withColumn("before", before).write.parquet(f"{root}/files")
    return Pages(spark, root, order)
