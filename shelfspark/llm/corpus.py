"""How the operators move data: document parts, shared tables, and a keyed request and reply.

Several operators need, for every key of every document (a window, an n-gram, a text
anchor), one fact about that key over the whole corpus. Shipping a row for each
occurrence would move many times the text. Here documents are dealt by their id into
parts of bounded size; a part sends each *distinct* key once, sorted and difference
coded, to the bucket that owns the key's hash range; the bucket answers in the same
order. A key that fills a third of the corpus costs a bucket one entry a part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 8 << 20
#: Text from which on parts grow with the square root of the input, so that messages between parts and buckets grow in proportion to it.
KNEE_BYTES = 16 << 30
BATCH_BYTES = 8 << 20
REPLY_SCHEMA = "part int, kind int, bucket int, body binary"
REQUEST_SCHEMA = "bucket int, part int, body binary, extra binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, so that a worker's memory does not follow the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(run: Callable) -> Callable:
    """An Arrow map that gives its freed memory back when its task ends: workers outlive tasks and share a machine."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return wrapped


#: Folders of tables stored and not yet dropped, in order.
_stored: list[str] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/shelfspark/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored() -> int:
    """How many tables there are, a mark for ``sweep``."""
    return len(_stored)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, mark: int, keep: int = 1) -> None:
    """Remove the tables stored since ``mark`` but for the last ``keep``: for callers that have stored what was made of them."""
    gone = _stored[mark : len(_stored) - keep]
    for path in gone:
        _delete(spark, path)
    del _stored[mark : len(_stored) - keep]


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            path = f.rsplit("/", 1)[0]
            _delete(df.sparkSession, path)
            _stored[:] = [p for p in _stored if p.rsplit("/", 1)[1] != path.rsplit("/", 1)[1]]


def text_bytes(df: DataFrame, text: str = "text") -> int:
    small_batches(df.sparkSession)
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0])


def part_count(total: int, size: int = PART_BYTES) -> int:
    return max(1, -(-total // size))


def exchange_parts(total: int, size: int = PART_BYTES, knee: int = KNEE_BYTES) -> int:
    """Parts of a keyed request and reply, in which every part may send to twice as many buckets as there are parts.

    Parts of ``size`` bytes up to ``knee`` bytes of text, then of sqrt(total / knee) times that: 2 P^2 messages are in
    proportion to the text, and a task's memory (about ten times its part) grows with the root.
    """
    return part_count(total, max(size, int(size * (total / knee) ** 0.5)))


def part_of(key: Column, parts: int, otherwise: Column | None = None) -> Column:
    """The part of a key; a null key's rows are dealt by ``otherwise``, so that they do not meet in one part."""
    dealt = F.xxhash64(key) if otherwise is None else F.when(key.isNull(), F.xxhash64(otherwise)).otherwise(F.xxhash64(key))
    return F.pmod(dealt, F.lit(parts)).cast("int")


def parted(docs: DataFrame, size: int = PART_BYTES, *more: str) -> tuple[DataFrame, int]:
    """(part, doc_id, text, more...) and the number of parts, from the whole texts' length."""
    parts = exchange_parts(text_bytes(docs), size)
    return docs.select(part_of(F.col("doc_id"), parts, F.col("text")).alias("part"), "doc_id", "text", *more), parts


def by_id(t: pa.Table) -> pa.Table:
    """Rows in ascending doc_id order, null last; rows of the same id by text, so reruns agree."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start in ascending 64-bit keys; one longer than the buckets."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def requests(part: int, keys: np.ndarray, buckets: int, encode: Callable[[slice], bytes] | None = None) -> Iterator[tuple]:
    """Rows of REQUEST_SCHEMA for ascending distinct keys; ``encode`` gives what goes along with a slice."""
    from .textops import pack_sorted

    at = slices(keys, buckets)
    for b in range(buckets):
        if at[b + 1] > at[b]:
            cut = slice(int(at[b]), int(at[b + 1]))
            yield b, part, pack_sorted(keys[cut]), encode(cut) if encode else b""


def rows(out: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def request_table(out: list[tuple]) -> pa.Table:
    return rows(out, ["bucket", "part", "body", "extra"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def reply_table(out: list[tuple]) -> pa.Table:
    return rows(out, ["part", "kind", "bucket", "body"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])


def replied(t: pa.Table, kind: int) -> bytes:
    """A part's replies of one kind, joined in the order of its keys."""
    t = t.select(["kind", "bucket", "body"]).to_pydict()
    return b"".join(body for _, body in sorted((b, body) for k, b, body in zip(t["kind"], t["bucket"], t["body"], strict=True) if k == kind))


def answer(requests_df: DataFrame, kind: int, reply: Callable[[list[np.ndarray], list[bytes]], list[bytes]]) -> DataFrame:
    """One reply row for each request row; ``reply`` sees all of a bucket's key lists and what came along."""
    from .textops import unpack_sorted

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        bodies = reply([unpack_sorted(x) for x in t.column("body").to_pylist()], t.column("extra").to_pylist())
        bucket = key[0].as_py()
        return reply_table([(p, kind, bucket, b) for p, b in zip(t.column("part").to_pylist(), bodies, strict=True)])

    return requests_df.groupBy("bucket").applyInArrow(run, REPLY_SCHEMA)


def split_like(values: np.ndarray, lists: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in lists])[:-1]) if lists else []
