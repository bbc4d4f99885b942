"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``window // 2`` words; any
run of ``window`` words of it holds one whole block. All rolling block-long word runs of
the corpus probe that index, so a run that occurs twice has a probe that hits at each
occurrence. Hits extend to every window around them; windows that an earlier place
(smaller doc_id, or same document and earlier start) also holds make up the maximal
repeats, whose words go.

Both exchanges move distinct keys of document parts (see ``corpus``), never occurrences.
Probes use 40-bit keys, where a false hit only costs a window that is judged and kept;
windows have two 64-bit keys of their word sequence, which both must agree.

Defined cases: null or empty texts have no words; texts under ``window`` words lose none;
null doc_ids order last, among each other by a hash of their texts; rows that share a
doc_id are separate documents in the order of their texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus, textops

OUT_SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept_text string"
PROBE_SHIFT = np.uint64(24)


class _Part:
    """The words and window keys of one part's documents, in document order."""

    def __init__(self, t: pa.Table, window: int):
        self.block = window // 2
        self.ids = t.column("doc_id")
        self.data, self.offsets = textops.flat(t.column("text"))
        starts, ends, hashes, counts = [], [], [], []
        for a, b in textops.blocks(self.offsets, textops.BLOCK_BYTES):
            lo = self.offsets[a]
            local = self.data[lo : self.offsets[b]]
            s, e, at = textops.words(local, self.offsets[a : b + 1] - lo, textops.SPACE_WORD)
            hashes.append(textops.word_hashes(local, s, e))
            starts.append(s + lo)
            ends.append(e + lo)
            counts.append(np.diff(at))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.starts, self.ends, self.hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.words = np.concatenate([[0], np.cumsum(cat(counts, np.int64))]).astype(np.int64)
        self.window = window

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of rolling runs, their keys, and whether each is a reference block."""
        keys = textops.gram_hashes(self.hashes, self.block) >> PROBE_SHIFT << PROBE_SHIFT
        # only documents with a whole window take part
        doc = np.repeat(np.arange(len(self.words) - 1), np.diff(self.words))[: len(keys)]
        at = np.flatnonzero(textops.inside_documents(self.words, self.block)[: len(keys)] & (np.diff(self.words)[doc] >= self.window))
        return at, keys[at], (at - self.words[doc[at]]) % self.block == 0

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a run which hit."""
        ok = np.flatnonzero(textops.inside_documents(self.words, self.window))
        n = np.zeros(len(self.hashes) + 1, np.int32)
        n[hits + 1] = 1
        n = np.cumsum(n, dtype=np.int32)
        return ok[n[ok + self.window - self.block + 1] > n[ok]]


def _probe_request(window: int, buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        p = _Part(corpus.by_id(t), window)
        at, keys, block = p.probes()
        distinct, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        flags = (count > 1).astype(np.uint8)
        flags[inverse[block]] |= 2
        return corpus.request_table(list(corpus.requests(key[0].as_py(), distinct, buckets, lambda c: flags[c].tobytes())))

    return run


def _probe_reply(lists, extras):
    """1 where a key is a reference block somewhere and stands in two places or more."""
    keys = np.concatenate(lists)
    flags = np.concatenate([np.frombuffer(x, np.uint8) for x in extras])
    _, inverse, parts = np.unique(keys, return_inverse=True, return_counts=True)
    n = len(parts)
    many = (parts > 1) | (np.bincount(inverse, flags & 1, n) > 0)
    hit = many & (np.bincount(inverse, flags >> 1, n) > 0)
    return [x.tobytes() for x in corpus.split_like(hit[inverse].astype(np.uint8), lists)]


def _windows(part: _Part, replies: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of candidate windows, and both keys of each."""
    at, keys, _ = part.probes()
    _, inverse = np.unique(keys, return_inverse=True)
    hits = at[np.frombuffer(replies, np.uint8)[inverse] > 0] if len(at) else at
    starts = part.candidates(hits)
    return starts, textops.gram_hashes(part.hashes, part.window)[starts], textops.gram_hashes(part.hashes, part.window, 1)[starts]


def _order(part: _Part, starts: np.ndarray) -> np.ndarray:
    """A key of the document of each window that orders as doc_id does, null last, as unsigned 64-bit."""
    ids = part.ids.combine_chunks() if isinstance(part.ids, pa.ChunkedArray) else part.ids
    raw = ids.cast(pa.int64()).fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.searchsorted(part.words, starts, "right") - 1
    return raw[doc].view(np.uint64) ^ np.uint64(1 << 63)


def _window_request(window: int, buckets: int):
    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return corpus.request_table([])
        p = _Part(corpus.by_id(t), window)
        starts, keys, check = _windows(p, corpus.replied(replies, 0))
        first, _ = textops.distinct(keys, check)
        order, check = _order(p, starts[first]), check[first]
        return corpus.request_table(list(corpus.requests(key[0].as_py(), keys[first], buckets, lambda c: textops.planes(order[c]) + textops.planes(check[c]))))

    return run


def first_holder(lists, extras):
    """1 where a list holds the first occurrence of both keys: the smallest order, then the first list."""
    keys = np.concatenate(lists)
    order, check = (np.concatenate([textops.unplanes(x[half]) for x, half in zip(extras, halves, strict=True)]) for halves in ([slice(0, len(x) // 2) for x in extras], [slice(len(x) // 2, None) for x in extras]))
    by = np.lexsort((order, check, keys))
    k, c = keys[by], check[by]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    out = np.zeros(len(k), np.uint8)
    out[by[new]] = 1
    return [x.tobytes() for x in corpus.split_like(out, lists)]


def _remove(window: int):
    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_text", pa.string())])
        if not t.num_rows:
            return schema.empty_table()
        p = _Part(corpus.by_id(t), window)
        starts, keys, check = _windows(p, corpus.replied(replies, 0))
        first, _ = textops.distinct(keys, check)
        holder = np.frombuffer(corpus.replied(replies, 1), np.uint8)
        again = np.ones(len(keys), bool)
        again[first[holder > 0]] = False
        gone = textops.cover(starts[again], window, len(p.hashes))
        n = len(p.words) - 1
        doc = np.repeat(np.arange(n), np.diff(p.words))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
        # kept words with one separator each: the byte after a word is white space or the next document
        limit = p.offsets[1:][doc]
        stop = np.minimum(p.ends + 1, limit)
        keep = ~gone
        mask = np.zeros(len(p.data) + 1, np.int8)
        mask[p.starts[keep]] += 1
        np.subtract.at(mask, stop[keep], 1)
        mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
        text = p.data.copy()
        text[p.ends[p.ends < limit]] = 0x20
        # the last kept word of a document keeps no separator
        last = np.flatnonzero(keep)
        last = last[np.append(doc[last][1:] != doc[last][:-1], True)] if len(last) else last
        drop = p.ends[last]
        drop = drop[drop < limit[last]]
        mask[drop] = False
        sizes = np.concatenate([[0], np.cumsum(mask)])[p.offsets]
        count = lambda m: np.bincount(doc[m], minlength=n).astype(np.int64)
        return pa.table([p.ids.cast(pa.int64()), np.diff(p.words), count(gone), count(edge), textops.texts_array(text[mask], sizes)], schema=schema)

    return run


def block_dedup(docs: DataFrame, window: int = 20, part_bytes: int = corpus.PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs), kept_text (kept words joined by a space)."""
    if window < 2:
        raise ValueError("window must be 2 words or more")
    split, parts = corpus.parted(docs.select("doc_id", "text"), part_bytes)
    buckets = 2 * parts
    probes = split.groupBy("part").applyInArrow(_probe_request(window, buckets), corpus.REQUEST_SCHEMA)
    hits = corpus.answer(probes, 0, _probe_reply)
    asked = split.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_window_request(window, buckets), corpus.REQUEST_SCHEMA)
    firsts = corpus.answer(asked, 1, first_holder)
    replies = hits.unionByName(firsts)
    return split.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_remove(window), OUT_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    out = block_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", "n_spans", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
