"""Interval joins by bins of several widths: spans meet only where they can overlap.

A span is put into bins of its own level, the first whose width is at least its length (so it reaches two bins at most), and of
every coarser level. Two spans meet at the coarser of their levels, where one of them is at home, in the first bin that both reach, and so once. A
span of any length takes at most two rows a level; a key's spans are dealt by bin too, so a key
with very many spans is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Widths of bins: WIDTH, WIDTH * FACTOR, ... LEVELS of them; spans longer than the last take the last.
WIDTH, FACTOR, LEVELS = 1 << 10, 8, 14


def _level(length: Column) -> Column:
    """The first level whose bins are as wide as a length."""
    out = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        out = F.when(length <= WIDTH * FACTOR**i, F.lit(i)).otherwise(out)
    return out


def _binned(spans: DataFrame, start: str, end: str, prefix: str) -> DataFrame:
    width = F.expr(f"element_at(array({', '.join(f'{WIDTH * FACTOR**i}L' for i in range(LEVELS))}), _level + 1)")
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    out = spans.where(e > s).withColumn(f"{prefix}own", _level(e - s))
    out = out.withColumn("_level", F.explode(F.sequence(F.col(f"{prefix}own"), F.lit(LEVELS - 1))))
    bins = F.sequence(F.floor(s / width), F.floor((e - 1) / width))
    return out.withColumn(f"{prefix}width", width).withColumn("_bin", F.explode(bins))


def overlapping(left: DataFrame, right: DataFrame, key: list[str], span: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """All pairs of rows of equal keys whose half-open spans overlap, with overlap (its length). Column names but the keys' differ; empty spans and null keys meet nothing."""
    a, b = _binned(left, *span, "_l"), _binned(right, *other, "_r")
    # at a coarse level only the few long spans of either side meet what is there, never short ones each other
    own = F.col("_level") == F.col("_lown")
    pairs = a.where(own).join(b, [*key, "_level", "_bin"]).unionByName(a.where(~own).join(b.where(F.col("_level") == F.col("_rown")), [*key, "_level", "_bin"]))
    at = F.greatest(F.col(span[0]), F.col(other[0])).cast("long")
    once = F.col("_bin") == F.floor(at / F.col("_lwidth"))
    overlap = F.least(F.col(span[1]), F.col(other[1])) - F.greatest(F.col(span[0]), F.col(other[0]))
    return pairs.where(once & (overlap > 0)).withColumn("overlap", overlap).drop("_level", "_bin", "_lown", "_rown", "_lwidth", "_rwidth")


def nearest_span(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str, span: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Each left row's right row with the longest overlap, the earliest of equal ones: (keys, left_id, right_id, overlap); rows that nothing overlaps are left out."""
    met = overlapping(left, right, key, span, other)
    best = met.groupBy(*key, left_id).agg(F.min_by(F.struct(right_id, "overlap"), F.struct(-F.col("overlap"), F.col(other[0]), F.col(right_id))).alias("_b"))
    return best.select(*key, left_id, f"_b.{right_id}", "_b.overlap")


def nearest_laid(spans: DataFrame, key: list[str], left_id: str, right_id: str) -> DataFrame:
    """As ``nearest_span`` where no two spans of one side overlap, as those laid end to end: (keys, left_id, right_id, overlap).

    ``spans`` holds both sides: (keys, left, id, start, end), left telling whose a row is. One sort by key and start instead of bins: where
    a span starts, the only one of the other side that it can have met already is the last that started. A key is
    one group; spans that overlap others of their side are refused.
    """
    rows = spans.dropna(subset=key).where(F.col("end") > F.col("start"))
    w = Window.partitionBy(*key).orderBy("start", "left")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    mine, other = F.struct("id", "start", "end"), lambda left: F.col("left") == F.lit(left)
    last = {left: F.last(F.when(other(left), mine), ignorenulls=True).over(upto) for left in (True, False)}
    ended = {left: F.max(F.when(other(left), F.col("end"))).over(before) for left in (True, False)}
    clear = F.coalesce(F.when(F.col("left"), ended[True]).otherwise(ended[False]) <= F.col("start"), F.lit(True))
    met = rows.select(*key, last[True].alias("l"), last[False].alias("r"), clear.alias("clear"))
    overlap = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.least("l.end", "r.end") - F.greatest("l.start", "r.start"))
    met = met.withColumn("overlap", F.when(F.col("clear"), overlap).otherwise(F.raise_error(F.lit("spans of one side overlap"))))
    best = met.where("overlap > 0").groupBy(*key, F.col("l.id").alias(left_id)).agg(F.min_by(F.struct(F.col("r.id").alias(right_id), "overlap"), F.struct(-F.col("overlap"), F.col("r.start"), F.col("r.id"))).alias("_b"))
    return best.select(*key, left_id, f"_b.{right_id}", "_b.overlap")
