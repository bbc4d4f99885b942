"""Cross-entropy difference of two matched n-gram models.

A target model (documents labelled good) and a background model (all documents) share one
vocabulary, the words that occur ``min_count`` times or more in the corpus, all others
being one unknown word, and one form: bigrams smoothed by unigrams,

    p(w | v) = (c(v, w) + mu * p(w)) / (c(v) + mu),  p(w) = (c(w) + 1) / (N + V).

A document's score is its mean per-token loss under the target model less that under the
background model, in bits: the lower, the more like the target. A document's own counts
are taken off both models while it is scored, so labelled documents do not score
themselves.

Counts cover every document. They are summed where keys live and answered to the parts
that asked (see ``corpus``); no model is gathered or broadcast. Word and bigram keys have
48 bits.

Defined cases: null and empty texts have no tokens and null losses and score; without
target documents the target model is its uniform prior; null doc_ids are scored and are
never targets; rows that share a doc_id share their labels; several labels of a document
count as target where any is; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus, textops

MIN_COUNT = 10
MU = 50.0
UNKNOWN = np.uint64(0xFFFFFFFFFFFF0000)
KEY_MASK = np.uint64(0xFFFFFFFFFFFF0000)
#: Half the usual parts: a token's counts in both models and in its own document take more arrays than other operators have.
PART_BYTES = corpus.PART_BYTES // 2
OUT_SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


class _Part:
    """Word keys of a part's documents, and which documents are targets."""

    def __init__(self, t: pa.Table):
        labelled = set(t.filter(pc.equal(t.column("label"), 1)).column("doc_id").to_pylist())
        t = corpus.by_id(t.filter(pc.equal(t.column("label"), 0)))
        self.ids = t.column("doc_id").to_pylist()
        self.target = np.array([i is not None and i in labelled for i in self.ids], bool)
        data, offsets = textops.flat(t.column("text"))
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in textops.blocks(offsets, textops.BLOCK_BYTES):
            local = data[offsets[a] : offsets[b]]
            s, e, at = textops.words(local, offsets[a : b + 1] - offsets[a], textops.SPACE_WORD)
            keys.append(textops.word_hashes(local, s, e, lower=True) & KEY_MASK)
            counts.append(np.diff(at))
        self.n = np.concatenate(counts)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.keys = np.concatenate(keys)

    def bigrams(self, words: np.ndarray) -> np.ndarray:
        """A key for each token with the token before it; a document's first follows a mark of its own."""
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[np.append(True, self.doc[1:] != self.doc[:-1]) if len(words) else np.zeros(0, bool)] = np.uint64(1)
        return textops.mix(words * np.uint64(0x9E3779B97F4A7C15) + textops.mix(before)) & KEY_MASK


def _counted(part: _Part, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, which one each token has, and counts in all and in target documents."""
    distinct, which = np.unique(keys, return_inverse=True)
    every = np.bincount(which, minlength=len(distinct)).astype(np.int64)
    target = np.bincount(which[part.target[part.doc]], minlength=len(distinct)).astype(np.int64)
    return distinct, which, every, target


def _request(part: int, keys: np.ndarray, every: np.ndarray, target: np.ndarray, buckets: int) -> pa.Table:
    """One row to every bucket, so that each answers with its share of the totals."""
    at = corpus.slices(keys, buckets)
    rows = []
    for b in range(buckets):
        cut = slice(int(at[b]), int(at[b + 1]))
        rows.append((b, part, textops.pack_sorted(keys[cut]), textops.planes(every[cut].astype(np.uint64)) + textops.planes(target[cut].astype(np.uint64))))
    return corpus.request_table(rows)


def _totals(min_count: int):
    """Sums of each key's counts; in front, the bucket's sums over its keys (words below ``min_count`` as the unknown one)."""

    def reply(lists, extras):
        keys = np.concatenate(lists)
        halves = [(textops.unplanes(x[: len(x) // 2]), textops.unplanes(x[len(x) // 2 :])) for x in extras]
        every, target = (np.concatenate(c).astype(np.int64) for c in zip(*halves, strict=True))
        distinct, which = np.unique(keys, return_inverse=True)
        n = len(distinct)
        every, target = (np.bincount(which, x, n).astype(np.int64) for x in (every, target))
        rare = every < min_count
        head = np.array([np.count_nonzero(~rare), every.sum(), target.sum(), every[rare].sum(), target[rare].sum()], "<i8").tobytes()
        out = []
        for w in corpus.split_like(which, lists):
            out.append(head + textops.planes(every[w].astype(np.uint64)) + textops.planes(target[w].astype(np.uint64)))
        return out

    return reply


HEAD = 5 * 8


def _replied(t: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The totals over all buckets, and each key's counts in all and in target documents, in key order."""
    d = t.select(["kind", "bucket", "body"]).to_pydict()
    bodies = [body for _, body in sorted((b, body) for k, b, body in zip(d["kind"], d["bucket"], d["body"], strict=True) if k == kind)]
    head = sum((np.frombuffer(b, "<i8", 5) for b in bodies), np.zeros(5, np.int64))
    halves = [(textops.unplanes(b[HEAD : HEAD + (len(b) - HEAD) // 2]), textops.unplanes(b[HEAD + (len(b) - HEAD) // 2 :])) for b in bodies]
    every, target = (np.concatenate(c).astype(np.int64) for c in zip(*halves, strict=True)) if halves else (np.zeros(0, np.int64),) * 2
    return head, every, target


def _words(part: _Part, replies: pa.Table, min_count: int):
    """Each token's word in the shared vocabulary, its counts, and the sizes of both models."""
    distinct, which = np.unique(part.keys, return_inverse=True)
    head, every, target = _replied(replies, 0)
    size, n_all, n_target, rare_all, rare_target = head.tolist()
    known = every >= min_count
    words = np.where(known, distinct, UNKNOWN)
    every, target = np.where(known, every, rare_all), np.where(known, target, rare_target)
    return words[which], every[which], target[which], (size + 1, n_all, n_target)


def _unigrams(buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        p = _Part(t)
        distinct, _, every, target = _counted(p, p.keys)
        return _request(key[0].as_py(), distinct, every, target, buckets)

    return run


def _bigrams(buckets: int, min_count: int):
    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return corpus.request_table([])
        p = _Part(t)
        words = _words(p, replies, min_count)[0]
        distinct, _, every, target = _counted(p, p.bigrams(words))
        return _request(key[0].as_py(), distinct, every, target, buckets)

    return run


def _own(doc: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in the token's own document."""
    if not len(doc):
        return np.zeros(0, np.int64)
    pair = doc.astype(np.int64) * (int(which.max()) + 1) + which
    _, inverse, n = np.unique(pair, return_inverse=True, return_counts=True)
    return n[inverse]


def _score(min_count: int, mu: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])

    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        p = _Part(t)
        words, word_all, word_target, (size, n_all, n_target) = _words(p, replies, min_count)
        _, which = np.unique(p.bigrams(words), return_inverse=True)
        _, pair_all, pair_target = _replied(replies, 1)
        _, word_index = np.unique(words, return_inverse=True)
        own_word, own_pair = _own(p.doc, word_index), _own(p.doc, which)
        first = np.append(True, p.doc[1:] != p.doc[:-1]) if len(p.doc) else np.zeros(0, bool)

        def loss(c_word: np.ndarray, c_pair: np.ndarray, total: int, off: np.ndarray) -> np.ndarray:
            """``off``: 1 where the token's document is part of the model."""
            left = total - p.n[p.doc] * off
            c_word = c_word - own_word * off
            prior = (c_word + 1) / (left + size)
            before = np.empty_like(c_word)
            before[1:] = c_word[:-1]
            c_pair = c_pair - own_pair * off
            # a first word has no word before it: unigrams only
            p_pair = (c_pair + mu * prior) / (before + mu)
            return -np.log2(np.where(first, prior, p_pair))

        every = np.ones(len(p.doc), np.int64)
        target = p.target[p.doc].astype(np.int64)
        background = loss(word_all, pair_all[which], n_all, every) if len(which) else np.zeros(0)
        good = loss(word_target, pair_target[which], n_target, target) if len(which) else np.zeros(0)
        n = len(p.n)
        mean = lambda x: np.bincount(p.doc, x, n) / np.maximum(p.n, 1)
        a, b = mean(good), mean(background)
        empty = p.n == 0
        column = lambda x: pa.array(x, mask=empty)
        return pa.table([pa.array(p.ids, pa.int64()), pa.array(p.n.astype(np.int64)), column(a), column(b), column(a - b)], schema=schema)

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, min_count: int = MIN_COUNT, mu: float = MU, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document; ``targets`` has the doc_ids of the target's documents."""
    split, parts = corpus.parted(docs.select("doc_id", "text"), part_bytes)
    marks = targets.select("doc_id").where("doc_id is not null").distinct()
    rows = split.withColumn("label", F.lit(0)).unionByName(marks.select(corpus.part_of(F.col("doc_id"), parts).alias("part"), "doc_id", F.lit(None).cast("string").alias("text"), F.lit(1).alias("label")))
    buckets = 2 * parts
    asked = rows.groupBy("part").applyInArrow(_unigrams(buckets), corpus.REQUEST_SCHEMA)
    words = corpus.answer(asked, 0, _totals(min_count))
    pairs = rows.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(_bigrams(buckets, min_count), corpus.REQUEST_SCHEMA)
    replies = words.unionByName(corpus.answer(pairs, 1, _totals(0)))
    return rows.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_score(min_count, mu), OUT_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = cross_entropy_difference(docs, labels.where("quality = 1"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])
