"""Tables that are changed by key, a few buckets at a time.

Rows lie in folders by a hash of their key. A change reads and writes only the buckets that its keys fall into
(dynamic partition overwrite), so what is written follows the batch and not the table. Columns that a
batch does not give, or gives as null, keep their stored values; a batch that runs again changes nothing. The new files of a bucket take the
place of its old ones when the job commits; one writer at a time.

Rows with a null in a key column are no rows of the table and are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import upserted

BUCKETS = 64


@dataclass(frozen=True)
class KeyedTable:
    """A table under ``root`` with the columns of ``schema`` (DDL), which hold those of ``key``."""

    spark: SparkSession
    root: str
    schema: str
    key: tuple[str, ...]
    buckets: int = BUCKETS

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = f"{self.schema}, bucket int"
        return self.spark.read.schema(schema).parquet(self.root) if self._exists() else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; only their buckets are read."""
        wanted = keys.select(*self.key).distinct()
        return self._stored().where(F.col("bucket").isin(self._touched(wanted))).join(wanted, list(self.key), "left_semi").drop("bucket")

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: ``buckets`` numbers at most."""
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def change(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``merge(stored rows of them, batch)``; returns the buckets."""
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.key])
        batch = batch.where(whole)
        touched = self._touched(batch)
        if touched:
            stored = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
            columns = [c.name for c in self._stored().schema if c.name != "bucket"]
            out = merge(stored, batch).select(*columns).withColumn("bucket", self.bucket())
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
        return touched

    def upsert(self, batch: DataFrame, order: list[str]) -> list[int]:
        """New values over stored ones, column by column; of a key's rows in the batch each column's last known value by ``order``."""
        return self.change(batch, lambda stored, new: upserted(stored, last_known(new, list(self.key), order), list(self.key)))

    def insert(self, batch: DataFrame, order: list[str]) -> list[int]:
        """Rows of keys that the table lacks, the first by ``order`` of each; stored rows stay as they are."""

        def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
            values = [c for c in new.columns if c not in self.key]
            first = new.groupBy(*self.key).agg(F.min_by(F.struct(*values), F.struct(*order, *values)).alias("_v")).select(*self.key, "_v.*")
            return stored.unionByName(first.join(stored, list(self.key), "left_anti"), allowMissingColumns=True)

        return self.change(batch, merge)


def last_known(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: of each column the last value that is not null; rows of the same place in ``order`` by value, so that reruns agree."""
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(c) for c in values])
