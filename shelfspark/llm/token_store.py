"""Token ids in binary shards with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id, encoded in that order and cut into shards of
whole documents. A shard is one self-contained byte string: a header, the concatenated
ids at the narrowest fixed width, the doc_ids, and the documents' end offsets in
Elias-Fano form, n * (2 + log2(ids / n)) bits in place of 64 n. ``EliasFano.select``
finds an offset from counted words of the upper bits without decoding the rest.

A store is two tables in one folder: ``shards`` (range, seq, base: ids of its range before
the shard, shard) and ``index`` (range, before: ids before the range, by sums over groups of
``GROUP_RANGES`` ranges and then over groups). Readers join them; nothing is gathered.

Defined cases: a null or empty text is the end id alone; null doc_ids come last; rows that
share a doc_id are kept, in the order of a hash of their texts; a text longer than a shard is a
shard of its own; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import corpus, textops

MAGIC = b"EFTS"
HEADER = struct.Struct("<4sHHQQII")  # magic, version, id bytes, documents, ids, lower bits, upper bytes
SHARD_IDS = 1 << 20
SHARD_SCHEMA = "range int, seq int, base long, n_ids long, shard binary"
#: Ranges whose sums are added up by one task.
GROUP_RANGES = 4096
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
END_ID = 2
#: Distinct pieces of at most so many bytes that a worker keeps encoded; those met once it is full are encoded each time.
CACHE_PIECES, CACHE_BYTES = 400_000, 64
#: Bytes of new pieces that are encoded as one text.
RUN_BYTES = 1 << 10


#: Words of 64 bits of the upper part that share a count of what is before them.
RANK_WORDS = 8


class EliasFano:
    """An ascending sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        words = np.frombuffer(high.ljust(-(-len(high) // (8 * RANK_WORDS)) * 8 * RANK_WORDS, b"\0"), "<u8")
        self._words = words.reshape(-1, RANK_WORDS)
        # ones before each run of RANK_WORDS words: an eighth of a bit a bit
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words).sum(axis=1, dtype=np.int64))])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0  # noqa: E741
        bits = (v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        up = np.zeros(n + (top >> l) + 1, np.uint8)
        up[(v >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, l, low, np.packbits(up, bitorder="little").tobytes())

    def _lows(self, index: np.ndarray) -> np.ndarray:
        bit = index[:, None] * self.low_bits + np.arange(self.low_bits)
        low = np.frombuffer(self.low, np.uint8)
        return ((low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def selects(self, index: np.ndarray) -> np.ndarray:
        """The values at some places: the run of the upper bits from the counts, its word, and the bit in it."""
        index = np.asarray(index, np.int64)
        if len(index) and not (0 <= index.min() and index.max() < self.n):
            raise IndexError("no such place")
        run = np.searchsorted(self._before, index, "right") - 1
        words = self._words[run]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rest = index - self._before[run]
        at = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(index))
        rest -= np.where(at > 0, upto[row, at - 1], 0)
        word = words[row, np.minimum(at, RANK_WORDS - 1)].copy()
        for k in range(int(rest.max(initial=0))):  # 63 at most
            more = rest > k
            word[more] &= word[more] - np.uint64(1)
        bit = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        high = (run * RANK_WORDS + at) * 64 + bit - index
        return high << self.low_bits | (self._lows(index) if self.low_bits else 0)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.selects(np.array([i]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            out |= bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def write_shard(doc_ids: np.ndarray, known: np.ndarray, ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """doc_ids with a mask of the known ones, end offsets in ids, and the ids' bytes."""
    ef = EliasFano.of(ends)
    head = HEADER.pack(MAGIC, 1, width, len(ends), len(ids) // width, ef.low_bits, len(ef.high))
    return b"".join([head, ids, doc_ids.astype("<i8").tobytes(), np.packbits(known, bitorder="little").tobytes(), ef.high, ef.low])


class Shard:
    """A reader over a shard's bytes; documents are found by selects, ids are views."""

    def __init__(self, raw: bytes):
        magic, version, self.width, self.n, self.n_ids, low_bits, n_high = HEADER.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = HEADER.size
        self._ids = np.frombuffer(raw, f"<u{self.width}", self.n_ids, at)
        at += self.n_ids * self.width
        self.doc_ids = np.frombuffer(raw, "<i8", self.n, at)
        at += self.n * 8
        size = -(-self.n // 8)
        self.known = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), bitorder="little")[: self.n].astype(bool)
        at += size
        self.ends = EliasFano(self.n, low_bits, raw[at + n_high :], raw[at : at + n_high])

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self._ids[a:b]


def _splits_at_spaces(spec: dict) -> bool:
    """Whether a text's encoding is that of its pieces, cut before single spaces.

    True of byte-level tokenizers that cut words by the usual pattern, where a space
    belongs to what follows it, without normaliser or added tokens that swallow spaces.
    """
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens", []))
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain


#: Last bytes of white space characters beyond ASCII.
_WIDE_ENDS = np.zeros(256, bool)
_WIDE_ENDS[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_SPACES = np.zeros(256, bool)
_SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Document starts, and spaces that follow anything but white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    before = data[at - 1]
    ok = ~_SPACES[before]
    wide = np.flatnonzero(ok & _WIDE_ENDS[before] & (at > 1))
    p, q, r = data[at[wide] - 1], data[at[wide] - 2], data[np.maximum(at[wide] - 3, 0)]
    space = (q == 0xC2) & ((p == 0x85) | (p == 0xA0))
    space |= (r == 0xE2) & (q == 0x80) & ((p <= 0x8A) | (p == 0xA8) | (p == 0xA9) | (p == 0xAF))
    space |= (r == 0xE2) & (q == 0x81) & (p == 0x9F)
    space |= (p == 0x80) & ((r == 0xE1) & (q == 0x9A) | (r == 0xE3) & (q == 0x80))
    ok[wide[space]] = False
    starts = np.sort(np.concatenate([at[ok], offsets[:-1][np.diff(offsets) > 0]]), kind="stable")  # merges two runs
    return starts[np.append(True, starts[1:] != starts[:-1])] if len(starts) else starts


class Encoder:
    """Ids of texts. Distinct pieces between spaces are encoded once and kept by their bytes, with their ids in one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_piece = _splits_at_spaces(json.load(f))
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        # of a byte-level token each character is a byte; added ones are as they stand in a text
        lengths = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = np.zeros(max(lengths, default=-1) + 1, np.int64)
        self.bytes_of[list(lengths)] = list(lengths.values())
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has. Pieces go in runs, where a text that holds them is cut between them; their ids are told apart by their bytes."""
        data, offsets = textops.flat(pieces)
        raw, inner = data.tobytes(), offsets[1:-1]
        apart = ~np.isin(inner, piece_starts(data, offsets[[0, -1]]), assume_unique=True) | (inner // RUN_BYTES != offsets[:-2] // RUN_BYTES)
        edges = [0, *inner[apart].tolist(), len(raw)]
        texts = [raw[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(self.bytes_of[ids])
        upto = np.searchsorted(ends, offsets[1:], "right")
        if len(ids) and upto[0] and ends[-1] == len(raw) and (ends[upto - 1] == offsets[1:]).all():
            return ids, np.diff(upto, prepend=0)
        return self._whole([x.decode() for x in pieces.to_pylist()])  # a vocabulary without all bytes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a flat buffer, and where each text's ids end."""
        raw = data.tobytes()
        if not self.by_piece:
            ids, n = self._whole([raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)])
            return ids, np.cumsum(n)
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        edges = np.append(starts, len(data)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        which, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        spot = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(spot < 0)
        long = np.array([len(pieces[i]) > CACHE_BYTES for i in new.tolist()], bool)
        keep, new = [pieces[i] for i in new[~long].tolist()], np.concatenate([new[~long], new[long]])  # those to keep come first
        ids, n = self._pieces(coded.dictionary.take(pa.array(new))) if len(new) else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        flat = np.concatenate([self.flat, ids])
        at, size = self.at[spot] if len(self.at) else np.zeros(len(spot), np.int64), self.size[spot] if len(self.size) else np.zeros(len(spot), np.int64)
        at[new], size[new] = len(self.flat) + np.cumsum(n) - n, n
        if keep and len(self.known) + len(keep) <= CACHE_PIECES:
            self.known.update(zip(keep, range(len(self.at), len(self.at) + len(keep)), strict=True))
            kept = new[: len(keep)]
            self.at, self.size, self.flat = np.concatenate([self.at, at[kept]]), np.concatenate([self.size, size[kept]]), flat[: at[kept[-1]] + size[kept[-1]]].copy()
        counts = size[which]
        upto = np.cumsum(counts)
        out = flat[np.repeat(at[which] - (upto - counts), counts) + np.arange(int(upto[-1]))]
        return out, np.append(0, upto)[np.searchsorted(starts, offsets[1:], "left")]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, end_id: int, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.kind).tobytes()
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids, known, bodies, size = [], [], [], 0

        def flush():
            nonlocal ids, known, bodies, size, seq, base
            ends = np.cumsum([len(b) // enc.width for b in bodies])
            row = (part, seq, base, int(ends[-1]), write_shard(np.array(ids, np.int64), np.array(known, bool), ends, b"".join(bodies), enc.width))
            ids, known, bodies, size, seq, base = [], [], [], 0, seq + 1, base + int(ends[-1])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "seq", "base", "n_ids", "shard"])

        for batch in batches:
            data, offsets = textops.flat(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in textops.blocks(offsets, 4 << 20):
                flat, stops = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i, x, y in zip(names[a:b], np.append(0, stops).tolist(), stops.tolist(), strict=False):
                    if bodies and size + y - x + 1 > shard_ids:
                        yield flush()
                    ids.append(i or 0)
                    known.append(i is not None)
                    bodies.append(flat[x:y].tobytes() + end)
                    size += y - x + 1
        if bodies:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, part_bytes: int = corpus.PART_BYTES) -> None:
    """Encode whole texts in ascending doc_id order into a store at ``path`` (a folder that all machines share)."""
    parts = corpus.part_count(corpus.text_bytes(docs), part_bytes)
    # rows of one id, and rows without one, are spread by a hash of their texts
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, key).sortWithinPartitions(key, "text")
    ordered.mapInArrow(corpus.trimmed(_encode(tokenizer, end_id, shard_ids)), SHARD_SCHEMA).write.mode("overwrite").parquet(f"{path}/shards")
    spark = docs.sparkSession
    sizes = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").select("range", "n_ids")
    by_range = sizes.groupBy("range").agg(F.sum("n_ids").alias("n")).withColumn("group", F.expr(f"range div {GROUP_RANGES}"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = by_range.groupBy("group").agg(F.sum("n").alias("n"))  # a row for GROUP_RANGES ranges of part_bytes each
    groups = groups.select(F.col("group").alias("_group"), earlier(Window.orderBy("group")).alias("_before"))
    inside = by_range.withColumn("_in", earlier(Window.partitionBy("group").orderBy("range")))
    index = inside.join(groups, F.col("group") == F.col("_group")).select("range", (F.col("_before") + F.col("_in")).alias("before"))
    index.write.mode("overwrite").parquet(f"{path}/index")


def _read(with_ids: bool):
    def run(batches):
        for batch in batches:
            for part, base, raw in zip(batch.column("range").to_pylist(), batch.column("base").to_pylist(), batch.column("shard"), strict=True):
                shard = Shard(raw.as_py())
                ends = shard.ends.selects(np.arange(shard.n))
                starts = np.concatenate([[0], ends[:-1]])
                tokens = (shard._ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True))
                body = pa.array(list(tokens), pa.binary()) if with_ids else pa.array([zlib.crc32(t) for t in tokens], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(shard.n, part, np.int32)), pa.array(shard.doc_ids, mask=~shard.known), pa.array(starts + base), pa.array(ends - starts), body], ["range", "doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, path: str, crc: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids as little-endian 32-bit bytes or their crc32.

    Digests meet the index once they are made, so shards are never shuffled for it.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").select("range", "base", "shard")
    index = spark.read.schema("range int, before long").parquet(f"{path}/index").withColumnRenamed("range", "_range")
    schema = f"range int, {READ_SCHEMA if not crc else 'doc_id long, start long, n_tokens long, ids_crc32 long'}"
    found = shards.mapInArrow(corpus.trimmed(_read(not crc)), schema).join(index, F.col("range") == F.col("_range"))
    return found.withColumn("start", F.col("before") + F.col("start")).drop("range", "_range", "before")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write a store in the shared folder, read it back, and digest each document's ids."""
    import uuid

    path = f"{corpus.shared_dir(spark).rstrip('/')}/shelfspark/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer or default_tokenizer(), path)
    return read_tokens(spark, path, crc=True)


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(spark, docs)
