"""Connected components of an edge table by alternating large-star and small-star steps.

Each step groups by a node and takes a minimum, which combines before the shuffle, so a
node with a third of all edges costs a group one row a task. Every step's edges are
written to the shared folder; the labels never leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes but each component's smallest, from edges (a, b)."""
    edges = corpus.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = _mark(edges)
    while True:
        before, edges = edges, corpus.table(_small_star(_large_star(edges)), "edges")
        corpus.drop(before)
        if (now := _mark(edges)) == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = now
