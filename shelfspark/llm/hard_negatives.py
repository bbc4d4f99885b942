"""Hard negatives by a two-dimensional block matrix multiply.

The score matrix (anchors x rows) is cut into tiles, and each tile's sum over the dimensions
into chunks. Anchor panels (row shard, chunk) go to every tile of their row, row panels to
every tile of their column; a task multiplies one pair of panels into a partial tile, and a
shuffle by tile adds the partial tiles in 64-bit integers. The added tiles are read twice
from the same exchange: once for each anchor's first positives, then, with the windows that
these open, for the first negatives of every anchor and positive. Both are reduced tile by
tile before rows of different tiles meet.

Products run in floating point where no sum can pass 2**53, so they are exact, and in 64-bit
integers elsewhere.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part; a vector shorter than the longest counts 0 in the places it lacks; an empty vector scores
0; a null vec_id is no anchor and orders last; rows of the anchor's own vec_id are not its
positives; rows equal in every column used are one entry with a count, listed as often as it
says, and give their lists once as anchors; other columns are ignored; an empty table gives an empty
result. A component so large that a score times 100 could pass 64 bits is an error that says so.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import corpus

#: Anchors and rows of a tile, and dimensions of a chunk.
TILE_ANCHORS, TILE_ROWS, CHUNK = 256, 4096, 32
SCALE = 256
NO_ID = 2**63 - 1

_PANEL = "at int, chunk int, rows int, ids binary, labels binary, counts binary, body binary"
_PARTIAL = "ti int, tj int, chunk int, anchors binary, anchor_labels binary, ids binary, labels binary, counts binary, body binary"
_POSITIVE = "ti int, place int, anchor_id long, anchor_label int, positive_id long, positive_score long"
_NEGATIVE = "anchor_id long, anchor_label int, place int, positive_id long, positive_score long, positive_rank int, negative_id long, negative_score long, ti int"


def limit(dimensions: int) -> int:
    """The largest component for which no score times 100 passes 64 bits."""
    return math.isqrt((2**63 - 1) // (100 * max(1, dimensions)))


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q: usable rows, their components floor(scale * x) as little-endian 64-bit integers."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            v = t.column("embedding").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten().cast(pa.float64())
            missing = flat.is_null().to_numpy(zero_copy_only=False)
            x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(x))])
            fine = (bad[at[1:]] == bad[at[:-1]]) & v.is_valid().to_numpy(zero_copy_only=False) & t.column("label").is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.floor(np.where(np.isfinite(x), x, 0) * scale)
            most = np.abs(q[np.repeat(fine, sizes)]).max(initial=0)
            if most > limit(int(sizes.max(initial=1))):
                raise ValueError(f"a component of {most:g} is too large: scores would pass 64 bits")
            q = np.where(np.abs(q) < 2**62, q, 0).astype("<i8")
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at * 8), pa.py_buffer(q)])
            yield from pa.table({"vec_id": t.column("vec_id").cast(pa.int64()), "label": t.column("label").cast(pa.int32()), "q": body.cast(pa.binary())}).filter(pa.array(fine)).to_batches()

    return rows.select("vec_id", "label", "embedding").mapInArrow(corpus.trimmed(run), "vec_id long, label int, q binary")


def _panels(rows: DataFrame, chunk: int, dimensions: int) -> DataFrame:
    """_PANEL: the rows of a shard, ordered by id, one panel a chunk of dimensions."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("label", "ascending"), ("q", "ascending")])
        m = np.zeros((t.num_rows, dimensions), np.int64)
        for i, b in enumerate(t.column("q").to_pylist()):
            v = np.frombuffer(b, "<i8")
            m[i, : len(v)] = v
        ids = pc.fill_null(t.column("vec_id"), NO_ID).to_numpy().astype("<i8").tobytes()
        labels = t.column("label").to_numpy().astype("<i4").tobytes()
        counts = t.column("n").to_numpy().astype("<i4").tobytes()
        starts = range(0, max(1, dimensions), chunk)
        return pa.table(
            [
                pa.array([key[0].as_py()] * len(starts), pa.int32()),
                pa.array(range(len(starts)), pa.int32()),
                pa.array([t.num_rows] * len(starts), pa.int32()),
                *(pa.array([x] + [b""] * (len(starts) - 1), pa.binary()) for x in (ids, labels, counts)),
                pa.array([_packed(m[:, a : a + chunk]) for a in starts], pa.binary()),
            ],
            ["at", "chunk", "rows", "ids", "labels", "counts", "body"],
        )

    return rows.groupBy("at").applyInArrow(run, _PANEL)


def _packed(m: np.ndarray) -> bytes:
    """Integers in the least of 16, 32 or 64 bits that holds them all; the first byte says which."""
    most = int(np.abs(m).max(initial=0))
    size = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes([size]) + m.astype(f"<i{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of 64-bit integers, exact."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**53 else a @ b.T


def _partial(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One partial tile: the product of an anchor panel and a row panel."""
    out = []
    if left.num_rows and right.num_rows:
        a, b = left.to_pylist()[0], right.to_pylist()[0]
        n, m = a["rows"], b["rows"]
        tile = product(_unpacked(a["body"]).reshape(n, -1), _unpacked(b["body"]).reshape(m, -1))
        out.append((*(k.as_py() for k in key), a["ids"], a["labels"], b["ids"], b["labels"], b["counts"], _packed(tile)))
    return corpus.rows(out, ["ti", "tj", "chunk", "anchors", "anchor_labels", "ids", "labels", "counts", "body"], [pa.int32()] * 3 + [pa.binary()] * 6)


class _Tile:
    """The added tile of a group of partial ones, each anchor's scores in descending order, ties by smaller id."""

    def __init__(self, t: pa.Table):
        parts = sorted(t.to_pylist(), key=lambda r: r["chunk"])
        head = parts[0]
        read = lambda k, kind: np.frombuffer(head[k], kind)
        self.anchors, self.anchor_labels = read("anchors", "<i8"), read("anchor_labels", "<i4")
        self.ids, self.labels, self.counts = read("ids", "<i8"), read("labels", "<i4"), read("counts", "<i4")
        self.ti = head["ti"]
        self.scores = np.zeros((len(self.anchors), len(self.ids)), np.int64)
        for p in parts:
            self.scores += _unpacked(p["body"]).reshape(self.scores.shape)

    def ordered(self, i: int, of: np.ndarray) -> np.ndarray:
        """Places of the mask ``of`` by descending score, then id: the rows of a tile are ordered by id already."""
        at = np.flatnonzero(of)
        return at[np.argsort(-self.scores[i, at], kind="stable")]


def _ids(values) -> pa.Array:
    a = pa.array(np.asarray(values, np.int64))
    return pc.if_else(pc.equal(a, NO_ID), pa.scalar(None, pa.int64()), a)


def _positives(first: int):
    """Each anchor's first rows of its label in one tile."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        tile = _Tile(t)
        place, at = [], []
        for i in range(len(tile.anchors)):
            same = (tile.labels == tile.anchor_labels[i]) & (tile.ids != tile.anchors[i])
            if same.sum() > 4 * first:  # only what can be among the first is sorted
                cut = np.partition(tile.scores[i, same], -first)[-first]
                same &= tile.scores[i] >= cut
            best = tile.ordered(i, same)[:first]
            best = np.repeat(best, np.minimum(tile.counts[best], first))[:first]
            place += [i] * len(best)
            at += best.tolist()
        place, at = np.array(place, np.int64), np.array(at, np.int64)
        return pa.table(
            [pa.array(np.full(len(place), tile.ti), pa.int32()), pa.array(place, pa.int32()), pa.array(tile.anchors[place]), pa.array(tile.anchor_labels[place]), _ids(tile.ids[at]), pa.array(tile.scores[place, at])],
            ["ti", "place", "anchor_id", "anchor_label", "positive_id", "positive_score"],
        )

    return run


def _negatives(first: int, low: int, high: int):
    """The first rows of other labels within each window of one tile."""

    def run(key: tuple, t: pa.Table, windows: pa.Table) -> pa.Table:
        got = [[] for _ in range(4)]  # window, row, score, anchor's place
        w = windows.select(["place", "anchor_id", "anchor_label", "positive_id", "positive_score", "positive_rank"]).to_pydict()
        if t.num_rows and windows.num_rows:
            tile = _Tile(t)
            places, scores = np.array(w["place"], np.int64), np.array(w["positive_score"], np.int64)
            for i in np.unique(places).tolist():
                mine = np.flatnonzero(places == i)
                floor, top = -(-low * scores[mine] // 100), high * scores[mine] // 100
                if not (floor <= top).any():
                    continue
                other = (tile.labels != tile.anchor_labels[i]) & (tile.scores[i] <= top.max()) & (tile.scores[i] >= floor.min())
                at = tile.ordered(i, other)
                s = tile.scores[i, at]
                for k, a, b in zip(mine.tolist(), np.searchsorted(-s, -top, "left").tolist(), np.searchsorted(-s, -floor, "right").tolist(), strict=True):
                    best = at[a : min(b, a + first)]
                    best = np.repeat(best, np.minimum(tile.counts[best], first))[:first]
                    got[0] += [k] * len(best)
                    got[1] += tile.ids[best].tolist()
                    got[2] += tile.scores[i, best].tolist()
        k = pa.array(got[0], pa.int64())
        take = lambda name, kind: pa.array(w[name], kind).take(k)
        return pa.table(
            [take("anchor_id", pa.int64()), take("anchor_label", pa.int32()), take("place", pa.int32()), take("positive_id", pa.int64()), take("positive_score", pa.int64()), take("positive_rank", pa.int32()), _ids(got[1]), pa.array(got[2], pa.int64()), pa.array([key[0].as_py()] * len(k), pa.int32())],
            ["anchor_id", "anchor_label", "place", "positive_id", "positive_score", "positive_rank", "negative_id", "negative_score", "ti"],
        )

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, tile: tuple[int, int, int] = (TILE_ANCHORS, TILE_ROWS, CHUNK)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank for rows of (vec_id, embedding, label).

    ``anchors`` selects the anchor rows (default: vec_id divisible by 100); ``low`` and ``high`` are percents of a positive's
    score between which its negatives lie. Equal positives of an anchor keep their own lists, told apart by positive_rank.
    """
    if min(positives, negatives, *tile) < 1:
        raise ValueError("positives, negatives and the sides of a tile must be 1 or more")
    corpus.small_batches(rows.sparkSession)
    chosen = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    rows = rows.select("vec_id", "embedding", "label")
    n, n_anchors, dimensions = rows.agg(F.count("*"), F.count(F.when(chosen, 1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    dimensions = max(1, dimensions)
    down, across = corpus.part_count(n_anchors, tile[0]), corpus.part_count(n, tile[1])
    # equal rows meet as one before they are dealt, so that none can fill a shard
    most = max(positives, negatives)
    entries = quantised(rows).groupBy("vec_id", "label", "q").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("n"))
    dealt = lambda df, shards: df.withColumn("at", F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).cast("int"))
    spread = lambda df, mine, other, count: df.withColumnRenamed("at", mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    left = spread(_panels(dealt(entries.where(chosen), down), tile[2], dimensions), "ti", "tj", across)
    right = spread(_panels(dealt(entries, across), tile[2], dimensions), "tj", "ti", down)
    by = ["ti", "tj", "chunk"]
    partial = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_partial, _PARTIAL)
    tiles = partial.groupBy("ti", "tj")
    order = [F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last()]
    best = tiles.applyInArrow(_positives(positives), _POSITIVE)
    best = best.withColumn("positive_rank", F.row_number().over(Window.partitionBy("ti", "place").orderBy(*order))).where(F.col("positive_rank") <= positives)
    windows = best.withColumn("tj", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    found = tiles.cogroup(windows.groupBy("ti", "tj")).applyInArrow(_negatives(negatives, low, high), _NEGATIVE)
    w = Window.partitionBy("ti", "place", "positive_rank").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def relabelled(rows: DataFrame) -> DataFrame:
    """The contract's labels: (label + 1) % 10 where vec_id is divisible by 7."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"))


def query(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).drop("positive_rank")
