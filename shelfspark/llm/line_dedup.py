"""Line dedup: sharded cuckoo filters before exact reference counts, reversible.

A line's key is the digest of the line without white space at its ends, A-Z in lower case;
keys of ``min_chars`` code points that two documents hold lose their lines everywhere but in the
smallest doc_id. Documents are dealt by id into parts (see ``corpus``); a part sends each
distinct key once to the shard of its hash range, with the number of its documents that
hold it and the smallest of them. These rows are the exact reference counts: a line that a
third of all documents hold costs a shard one entry a part.

A shard streams its parts' keys through a cuckoo filter. A key that the filter has not seen
is new and needs no look-up; only keys that it may have seen are looked up in the
reference counts, whose sums say how many documents hold them and which is the first. Keys
that the counts prove new after all (another key's fingerprint) are inserted then, so
the filter holds each live key exactly once and keys can be deleted from it.

``LineIndex`` keeps documents, reference counts and filters as tables. Inserting documents
adds parts; deleting documents counts the touched parts anew and takes the keys that no
document holds any more out of the filters, so lines dropped on account of a deleted
document come back.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code points never go; rows of one doc_id are one
document; each row without an id is a document, after all others, in an order by their
texts' hashes; repeated lines inside the first holder all stay; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus, textops
from .cuckoo import CuckooFilter, filled

MIN_CHARS = 10
OUT_SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_text string"
#: Keys that go through a filter at a time.
STEP = 1 << 16
NO_ID = 2**63 - 1
#: Kinds of a shard's rows.
REPLY, FILTER = 0, 1


class _Part:
    """The lines of one part's documents, in document order, and the keys of those long enough."""

    def __init__(self, t: pa.Table, min_chars: int):
        self.ids = t.column("doc_id").cast(pa.int64())
        self.data, self.offsets = textops.flat(t.column("text"))
        self.n_docs = len(self.offsets) - 1
        starts, ends, docs, long, digests = [], [], [], [], []
        for a, b in textops.blocks(self.offsets, textops.BLOCK_BYTES):
            lo = int(self.offsets[a])
            data, offsets = self.data[lo : self.offsets[b]], self.offsets[a : b + 1] - lo
            s, e, d = _lines(data, offsets)
            x, y = _stripped(data, s, e)
            keep = np.flatnonzero(_code_points(data, x, y) >= min_chars)
            raw = textops.LOWER[data].tobytes()
            digests += [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True)]
            long.append(keep + sum(map(len, starts)))
            starts.append(s + lo)
            ends.append(e + lo)
            docs.append(d + a)
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        self.starts, self.ends, self.docs, self.long = cat(starts), cat(ends), cat(docs), cat(long)
        key = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        self.keys, self.checks = key[:, 0].copy(), key[:, 1].copy()
        # rows of one id are one document; each row without an id is its own, after all others
        raw = self.ids.fill_null(NO_ID).to_numpy()
        same = np.zeros(self.n_docs, bool)
        same[1:] = (raw[1:] == raw[:-1]) & ~self.ids.is_null().to_numpy()[1:]
        self.document = np.cumsum(~same) - 1
        self.order = raw.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)

    def distinct(self):
        """First place of each distinct key, which one each place has, documents that hold it, and its first document's row."""
        first, which = textops.distinct(self.keys, self.checks)
        at = self.docs[self.long]
        holders = np.full(len(first), self.n_docs, np.int64)
        np.minimum.at(holders, which, at)
        pairs = np.unique(which * np.int64(self.n_docs + 1) + self.document[at])
        return first, which, np.bincount(pairs // (self.n_docs + 1), minlength=len(first)), holders


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the lines between line feeds; each document has one at least."""
    breaks = np.flatnonzero(data == 0x0A)
    n = len(offsets) - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc_of_break = np.searchsorted(offsets, breaks, "right") - 1
    docs = np.sort(np.concatenate([np.arange(n), doc_of_break]), kind="stable")
    ends = np.empty(len(starts), np.int64)
    last = np.ones(len(starts), bool)
    last[:-1] = docs[1:] != docs[:-1]
    ends[last] = offsets[1:]
    ends[~last] = breaks
    return starts, ends, docs


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line bounds without white space at either end; equal ones where nothing is left."""
    solid = np.flatnonzero(textops.SPACE_WORD[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    if not len(solid):
        return starts, starts.copy()
    x = np.where(some, solid[np.minimum(a, len(solid) - 1)], starts)
    return x, np.where(some, solid[np.maximum(b - 1, 0)] + 1, starts)


def _code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return n[ends] - n[starts]


def references(parts: DataFrame, buckets: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """REQUEST_SCHEMA rows: each part's distinct keys by shard, with check, documents and first document of each."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        p = _Part(corpus.by_id(t), min_chars)
        first, _, count, holders = p.distinct()
        check, order = p.checks[first], p.order[holders] if len(first) else np.zeros(0, np.uint64)
        body = lambda c: textops.planes(check[c]) + textops.planes(count[c]) + textops.planes(order[c])
        return corpus.request_table(list(corpus.requests(key[0].as_py(), p.keys[first], buckets, body)))

    return parts.groupBy("part").applyInArrow(run, corpus.REQUEST_SCHEMA)


class _Counts:
    """A shard's reference counts: per part's row the keys, checks, documents and first documents."""

    def __init__(self, t: pa.Table):
        self.parts = t.column("part").to_pylist()
        self.keys = [textops.unpack_sorted(x) for x in t.column("body").to_pylist()]
        rest = [[textops.unplanes(x[i * len(x) // 3 : (i + 1) * len(x) // 3]) for i in range(3)] for x in t.column("extra").to_pylist()]
        self.checks, self.documents, self.orders = ([r[i] for r in rest] for i in range(3))

    def steps(self, rows: list[int]):
        """Runs of rows of about STEP keys."""
        at, size = [], 0
        for i in rows:
            at.append(i)
            size += len(self.keys[i])
            if size >= STEP:
                yield at
                at, size = [], 0
        if at:
            yield at

    def of(self, suspects: np.ndarray):
        """Of all rows the entries whose key is among the sorted suspects: row, place, and the place among the suspects."""
        rows, places, which = [], [], []
        for i, k in enumerate(self.keys):
            at = np.searchsorted(suspects, k)
            hit = np.flatnonzero(suspects[np.minimum(at, len(suspects) - 1)] == k) if len(suspects) else np.zeros(0, np.int64)
            rows.append(np.full(len(hit), i))
            places.append(hit)
            which.append(at[hit])
        cat = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
        return cat(rows), cat(places), cat(which)


def through_filter(counts: _Counts, new: list[int], seen: CuckooFilter | None) -> tuple[np.ndarray, CuckooFilter]:
    """Keys of the new rows that may be held elsewhere too, ascending, and the filter with every key in it once.

    ``seen`` holds the keys of the other rows; without it all rows are new.
    """
    total = sum(len(counts.keys[i]) for i in new)
    if seen is None:
        seen = CuckooFilter(total)
    elif not seen.room(total):
        old = [counts.keys[i] for i in sorted({*range(len(counts.keys))} - {*new})]
        seen = filled(np.unique(np.concatenate(old)) if old else np.zeros(0, np.uint64), total)
    lost, suspects, hits, inserted = False, [], [], []
    for at in counts.steps(new):
        keys, times = np.unique(np.concatenate([counts.keys[i] for i in at]), return_counts=True)
        hit = seen.contains(keys)
        suspects.append(keys[hit | (times > 1)])
        hits.append(keys[hit])
        inserted.append(keys[~hit])
        lost |= not seen.insert(keys[~hit])
    cat = lambda v: np.unique(np.concatenate(v)) if v else np.zeros(0, np.uint64)
    suspects = cat(suspects)
    # hits that no other row explains were another key's fingerprint: they are new, and go in now
    unknown = np.setdiff1d(cat(hits), cat(inserted), assume_unique=True)
    if len(unknown):
        rows, _, which = counts.of(unknown)
        old = np.ones(len(counts.keys), bool)
        old[new] = False
        unknown = np.delete(unknown, np.unique(which[old[rows]]))
        lost |= not seen.insert(unknown)
    if lost:
        every = np.unique(np.concatenate(counts.keys))
        seen = filled(every, len(every))
    return suspects, seen


def verdicts(counts: _Counts, suspects: np.ndarray) -> list[np.ndarray]:
    """For each row's entries: 0 the lines stay, 1 they go, 2 they go but in the part's first holder."""
    out = [np.where(d > 1, 2, 0).astype(np.uint8) for d in counts.documents]
    rows, places, which = counts.of(suspects)
    if not len(rows):
        return out
    pick = lambda lists: np.concatenate([lists[i][places[a:b]] for i, a, b in _runs(rows)])
    check, documents, order = pick(counts.checks), pick(counts.documents), pick(counts.orders)
    by = np.lexsort((rows, order, check, which))
    new = np.ones(len(by), bool)
    new[1:] = (which[by[1:]] != which[by[:-1]]) | (check[by[1:]] != check[by[:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, documents[by].astype(np.int64))  # exact: far under 2**53
    verdict = np.where(total[group] > 1, np.where(new, 2, 1), 0).astype(np.uint8)
    flat = np.empty(len(by), np.uint8)
    flat[by] = verdict
    for i, a, b in _runs(rows):
        out[i][places[a:b]] = flat[a:b]
    return out


def _runs(rows: np.ndarray):
    edges = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
    return [(int(rows[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def answers(refs: DataFrame) -> DataFrame:
    """REPLY_SCHEMA rows: a verdict for each entry, and each shard's filter (kind FILTER, part -1)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        counts = _Counts(t.sort_by("part"))
        suspects, seen = through_filter(counts, list(range(len(counts.parts))), None)
        bucket = key[0].as_py()
        out = [(p, REPLY, bucket, v.tobytes()) for p, v in zip(counts.parts, verdicts(counts, suspects), strict=True)]
        return corpus.reply_table([*out, (-1, FILTER, bucket, seen.dump())])

    return refs.groupBy("bucket").applyInArrow(run, corpus.REPLY_SCHEMA)


def _rewrite(min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])

    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        p = _Part(corpus.by_id(t), min_chars)
        _, which, _, holders = p.distinct()
        verdict = np.frombuffer(corpus.replied(replies, REPLY), np.uint8)[which]
        at = p.docs[p.long]
        gone = np.zeros(len(p.starts), bool)
        gone[p.long] = (verdict == 1) | ((verdict == 2) & (p.document[at] != p.document[holders[which]]))
        kept = np.flatnonzero(~gone)
        first = np.ones(len(kept), bool)
        first[1:] = p.docs[kept[1:]] != p.docs[kept[:-1]]
        begin = p.starts[kept] - ~first  # with the line feed before it, but for a document's first kept line
        mask = np.zeros(len(p.data) + 1, np.int8)
        np.add.at(mask, begin, 1)
        np.subtract.at(mask, p.ends[kept], 1)
        mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
        sizes = np.concatenate([[0], np.cumsum(mask)])[p.offsets]
        count = lambda of: np.bincount(of, minlength=p.n_docs).astype(np.int64)
        return pa.table([p.ids, count(p.docs), count(p.docs[gone]), textops.texts_array(p.data[mask], sizes)], schema=schema)

    return run


def _rewritten(parts: DataFrame, replies: DataFrame, min_chars: int) -> DataFrame:
    return parts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_rewrite(min_chars), OUT_SCHEMA)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, part_bytes: int = corpus.PART_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of all documents at once."""
    split, parts = corpus.parted(docs.select("doc_id", "text"), part_bytes)
    return _rewritten(split, answers(references(split, 2 * parts, min_chars)), min_chars)


@dataclass(frozen=True)
class LineIndex:
    """Documents, reference counts and filters as stored tables; every change gives a new index."""

    docs: DataFrame
    refs: DataFrame
    filters: DataFrame
    parts: int
    buckets: int
    min_chars: int = MIN_CHARS
    part_bytes: int = corpus.PART_BYTES

    @staticmethod
    def of(docs: DataFrame, min_chars: int = MIN_CHARS, part_bytes: int = corpus.PART_BYTES, buckets: int | None = None) -> LineIndex:
        """An index of ``docs`` with ``buckets`` shards (default: two a part)."""
        spark = docs.sparkSession
        parts = corpus.exchange_parts(corpus.text_bytes(docs), part_bytes)
        empty = lambda schema: spark.createDataFrame([], schema)
        kind = docs.schema["doc_id"].dataType.simpleString()
        none = LineIndex(empty(f"part int, doc_id {kind}, text string"), empty(corpus.REQUEST_SCHEMA), empty("bucket int, body binary"), 0, buckets or 2 * parts, min_chars, part_bytes)
        return none.insert(docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents added, as parts of their own. Ids should not be in the index already."""
        parts = corpus.exchange_parts(corpus.text_bytes(docs), self.part_bytes)
        dealt = corpus.part_of(F.col("doc_id"), parts, F.col("text")) + self.parts
        added = corpus.table(docs.select(dealt.cast("int").alias("part"), "doc_id", "text"), "line-docs")
        refs = corpus.table(references(added, self.buckets, self.min_chars), "line-refs")
        filters = self._filters(refs, self.refs, _inserted)
        return replace(self, docs=self.docs.unionByName(added), refs=self.refs.unionByName(refs), filters=filters, parts=self.parts + parts)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents whose doc_id is in ``ids``; only the parts that held one are counted anew."""
        ids = ids.select("doc_id").distinct()
        touched = corpus.table(self.docs.join(ids, "doc_id", "left_semi").select("part").distinct(), "line-touched")
        rest = corpus.table(self.docs.join(touched, "part", "left_semi").join(ids, "doc_id", "left_anti").select(*self.docs.columns), "line-docs")
        refs = corpus.table(references(rest, self.buckets, self.min_chars), "line-refs")
        old = self.refs.join(touched, "part", "left_semi").select(*self.refs.columns)
        others = self.refs.join(touched, "part", "left_anti").select(*self.refs.columns).unionByName(refs)
        filters = self._filters(old, others, _deleted)
        return replace(self, docs=self.docs.join(touched, "part", "left_anti").select(*self.docs.columns).unionByName(rest), refs=others, filters=filters)

    def _filters(self, changed: DataFrame, others: DataFrame, change) -> DataFrame:
        """Each shard's filter after a change of its counts."""
        rows = changed.withColumn("kind", F.lit(0)).unionByName(others.withColumn("kind", F.lit(1)))
        rows = rows.unionByName(self.filters.select("bucket", F.lit(-1).alias("part"), "body", F.lit(b"").alias("extra"), F.lit(2).alias("kind")))

        def run(key: tuple, t: pa.Table) -> pa.Table:
            kind = t.column("kind").to_numpy()
            kept = t.filter(pa.array(kind == 2)).column("body").to_pylist()
            seen = change(_Counts(t.filter(pa.array(kind < 2))), np.flatnonzero(kind[kind < 2] == 0).tolist(), CuckooFilter.load(kept[0]) if kept else None)
            return corpus.rows([(key[0].as_py(), seen.dump())], ["bucket", "body"], [pa.int32(), pa.binary()])

        return corpus.table(rows.groupBy("bucket").applyInArrow(run, "bucket int, body binary"), "line-filters")

    def compact(self) -> LineIndex:
        """The same with each table written as one, so that a long history is not read anew."""
        return replace(self, docs=corpus.table(self.docs, "line-docs"), refs=corpus.table(self.refs, "line-refs"))

    def deduplicated(self) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of the documents in the index."""
        return _rewritten(self.docs, answers(self.refs), self.min_chars)

    def maybe_held(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_keys, n_seen: how many of a document's distinct keys the filters may have seen; no reference count is read."""
        min_chars, buckets = self.min_chars, self.buckets

        def keys(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                p = _Part(t, min_chars)
                for row in range(p.n_docs):
                    mine = np.unique(p.keys[p.docs[p.long] == row])
                    for b, _, body, _ in corpus.requests(0, mine, buckets):
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "doc_id": t.column("doc_id").combine_chunks().slice(row, 1).cast(pa.int64()), "body": pa.array([body], pa.binary())})

        def look(key: tuple, t: pa.Table, filters: pa.Table) -> pa.Table:
            lists = [textops.unpack_sorted(x) for x in t.column("body").to_pylist()]
            seen = [CuckooFilter.load(x) for x in filters.column("body").to_pylist()]
            n = [int(seen[0].contains(k).sum()) if seen else 0 for k in lists]
            return pa.table({"doc_id": t.column("doc_id"), "n": pa.array([len(k) for k in lists], pa.int64()), "s": pa.array(n, pa.int64())})

        asked = docs.select("doc_id", "text").mapInArrow(keys, "bucket int, doc_id long, body binary")
        found = asked.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInArrow(look, "doc_id long, n long, s long")
        return docs.select("doc_id").distinct().join(found.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_keys"), F.coalesce("s", F.lit(0)).alias("n_seen"))


def _inserted(counts: _Counts, new: list[int], seen: CuckooFilter | None) -> CuckooFilter:
    return through_filter(counts, new, seen or CuckooFilter())[1]


def _deleted(counts: _Counts, old: list[int], seen: CuckooFilter | None) -> CuckooFilter:
    """Without the keys of the old rows that no other row has."""
    cat = lambda v: np.unique(np.concatenate(v)) if v else np.zeros(0, np.uint64)
    seen = seen or CuckooFilter()
    gone, rest = cat([counts.keys[i] for i in old]), sorted({*range(len(counts.keys))} - {*old})
    seen.delete(np.setdiff1d(gone, cat([counts.keys[i] for i in rest]), assume_unique=True))
    return seen


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
