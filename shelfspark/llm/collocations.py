"""Phrase collocations: frequent word sequences that hold together better than chance.

Three passes over document parts (see ``corpus``), each shaped by the one before (Apriori: a
phrase found ``min_count`` times has no part found less often):

1. Every part sends its distinct (lang, word) strings with their counts; a shard tells them apart by
   their bytes, adds the counts, and answers with a dense id for each word that is frequent.
2. Pairs of frequent words are keys of two ids, exact without any hashing of text. A shard
   builds a minimal perfect hash over the keys it was sent (its candidates) and stores each key at its
   slot; the parts' counts, added up in numpy arrays by slot and summed pair by pair, give frequencies.
   Frequent pairs get dense ids from their slots.
3. Triples whose two pairs are frequent are keys of a pair's id and a word's, counted likewise.

Ids are slots, so a phrase's cuts are read by joins on them. All products are decimals of 38 digits. Nothing is
broadcast or gathered: a pair that fills a third of the corpus costs its shard one entry a part.

Defined cases: a null or empty text has no words; a null lang is ``und``; rows of one doc_id are separate
documents; phrases do not cross pieces or documents; other columns are ignored; an empty table gives an empty result. More than
2**30 frequent words or 2**34 frequent pairs are an error that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import corpus, textops
from .mphf import PerfectHash, tree_sum

MIN_COUNT, PERCENT, TOP, MAX_WORDS = 10, 50, 2000, 3
WORD_BITS, PAIR_BITS = 30, 34
NONE = 2**64 - 1
NO_LANG = "und"
#: Entries whose slots are counted at a time.
STEP = 1 << 18
#: Kinds of replies: ids of words, and of pairs.
WORD_IDS, PAIR_IDS = 0, 1

SPLITTERS = np.zeros(256, bool)
SPLITTERS[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~SPLITTERS
WORD[[0x20, 0x09]] = False

#: id: of a word or pair; left, right: ids of a phrase's first words and of its last; lang with n alone: all its words.
COUNT_SCHEMA = "level int, id long, left long, right long, lang string, word string, n long"


class _Part:
    """One part's words, in document order, and which follow each other in a piece."""

    def __init__(self, t: pa.Table):
        t = corpus.by_id(t)
        lang = t.column("lang").cast(pa.string()).fill_null(NO_LANG).combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        self.langs, of_doc = [x.encode() for x in lang.dictionary.to_pylist()], lang.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        data, offsets = textops.flat(t.column("text"))
        self.data = textops.LOWER[data]
        hashes, starts, ends, joined, langs = [], [], [], [], []
        for a, b in textops.blocks(offsets, textops.BLOCK_BYTES):
            lo = offsets[a]
            local = self.data[lo : offsets[b]]
            s, e, at = textops.words(local, offsets[a : b + 1] - lo, WORD)
            doc = np.repeat(np.arange(a, b), np.diff(at))
            breaks = np.cumsum(SPLITTERS[local], dtype=np.int32)
            next_to = np.zeros(len(s), bool)
            next_to[:-1] = (breaks[s[1:]] == breaks[s[:-1]]) & (doc[1:] == doc[:-1])
            hashes.append(textops.mix(textops.word_hashes(local, s, e) + seeds[of_doc[doc]]))
            starts.append(s + lo)
            ends.append(e + lo)
            joined.append(next_to)
            langs.append(of_doc[doc])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.starts, self.ends, self.joined, self.lang = cat(starts, np.int64), cat(ends, np.int64), cat(joined, bool), cat(langs, np.int32)
        self.keys, self.first, self.which, self.count = np.unique(cat(hashes, np.uint64), return_index=True, return_inverse=True, return_counts=True)

    def strings(self) -> list[bytes]:
        """The distinct words in the order of their keys: the word, a space, the lang."""
        raw = self.data.tobytes()
        s, e, lang = self.starts[self.first], self.ends[self.first], self.lang[self.first]
        return [raw[a:b] + b" " + self.langs[x] for a, b, x in zip(s.tolist(), e.tolist(), lang.tolist(), strict=True)]

    def ids(self, replies: pa.Table) -> np.ndarray:
        """The id of the word at each place, NONE where it is not frequent."""
        return textops.unplanes(_joined(replies, WORD_IDS))[self.which] if len(self.which) else np.zeros(0, np.uint64)

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of neighbours that are both frequent, and their keys."""
        at = np.flatnonzero(self.joined[:-1] & (ids[:-1] != NONE) & (ids[1:] != NONE)) if len(ids) else np.zeros(0, np.int64)
        return at, ids[at] << np.uint64(WORD_BITS) | ids[at + 1]

    def triples(self, ids: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Keys of three neighbours whose two pairs are frequent; ``pairs`` are the ids of the pairs at ``at``."""
        here = np.full(len(ids) + 1, NONE, np.uint64)
        here[at] = pairs
        at = at[(here[at] != NONE) & (here[at + 1] != NONE)]
        return here[at] << np.uint64(WORD_BITS) | ids[np.minimum(at + 2, len(ids) - 1)]


def _joined(replies: pa.Table, kind: int) -> bytes:
    """A part's replies of one kind as planes over all its keys."""
    t = replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("bucket").column("body").to_pylist()
    return textops.planes(np.concatenate([textops.unplanes(x) for x in t])) if t else b""


def _counted(part: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """REQUEST_SCHEMA rows of the distinct keys, mixed so that all shards get as many, with their counts."""
    distinct, count = np.unique(textops.mix(keys), return_counts=True)
    return corpus.request_table(list(corpus.requests(part, distinct, buckets, lambda c: textops.planes(count[c]))))


def _words(buckets: int):
    """Level 1: strings and counts of a part's distinct words."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        p = _Part(t)
        strings, at, out = p.strings(), corpus.slices(p.keys, buckets), []
        for b in range(buckets):
            mine = strings[at[b] : at[b + 1]]
            if mine:
                sizes = np.array([len(x) for x in mine], np.uint64)
                out.append((b, key[0].as_py(), b"".join(mine), textops.planes(sizes) + textops.planes(p.count[at[b] : at[b + 1]])))
        return corpus.request_table(out)

    return run


def _strings(t: pa.Table) -> tuple[pa.Array, np.ndarray, list[int]]:
    """All strings of a shard's rows, their counts, and how many each row has."""
    half = lambda x, i: textops.unplanes(x[i * len(x) // 2 : (i + 1) * len(x) // 2])
    extras = t.column("extra").to_pylist()
    sizes = [half(x, 0).astype(np.int64) for x in extras]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(t.column("body").to_pylist()))])
    return strings, np.concatenate([half(x, 1) for x in extras]).astype(np.int64), [len(x) for x in sizes]


def _frequent(counts: np.ndarray, min_count: int, bucket: int, buckets: int, bits: int, what: str) -> np.ndarray:
    """A dense id for each slot that is frequent, NONE for others: slots of all shards take turns."""
    ids = np.full(len(counts), NONE, np.uint64)
    at = np.flatnonzero(counts >= min_count)
    if len(at) and (len(at) - 1) * buckets + bucket >= 2**bits:
        raise OverflowError(f"more than 2**{bits} frequent {what}")
    ids[at] = np.arange(len(at), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
    return ids


def _word_ids(min_count: int, buckets: int, rows: bool):
    """Level 1 in a shard: an id a string to each part, or (``rows``) the frequent words and the sums of each lang."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket, t = key[0].as_py(), t.sort_by("part")
        strings, counts, sizes = _strings(t)
        coded = strings.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        total = tree_sum([np.bincount(which[a : a + STEP], counts[a : a + STEP], len(coded.dictionary)).astype(np.int64) for a in range(0, len(which), STEP)])
        ids = _frequent(total, min_count, bucket, buckets, WORD_BITS, "words")
        if not rows:
            bodies = np.split(ids[which], np.cumsum(sizes)[:-1])
            return corpus.reply_table([(p, WORD_IDS, bucket, textops.planes(b)) for p, b in zip(t.column("part").to_pylist(), bodies, strict=True)])
        words = [x.split(b" ", 1) for x in coded.dictionary.to_pylist()]
        langs: dict[bytes, int] = {}
        for (_, lang), n in zip(words, total.tolist(), strict=True):
            langs[lang] = langs.get(lang, 0) + n
        at = np.flatnonzero(ids != NONE)
        out = [(1, int(ids[i]), None, None, words[i][1].decode(), words[i][0].decode(), int(total[i])) for i in at.tolist()]
        return _count_table(out + [(0, None, None, None, lang.decode(), None, n) for lang, n in langs.items()])

    return run


def _count_table(out: list[tuple]) -> pa.Table:
    return corpus.rows(out, ["level", "id", "left", "right", "lang", "word", "n"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])


def slot_counts(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[PerfectHash, np.ndarray]:
    """The perfect hash over the keys of all lists, and the sum of each key's counts by slot."""
    candidates = PerfectHash(np.unique(np.concatenate(lists)))
    arrays: list[np.ndarray] = []
    for at in _steps(lists):
        slots = candidates.slots(np.concatenate([lists[i] for i in at]))
        arrays.append(np.bincount(slots, np.concatenate([counts[i] for i in at]), len(candidates)).astype(np.int64))  # exact: sums stay under 2**53
        if len(arrays) == 8:
            arrays = [tree_sum(arrays)]
    return candidates, tree_sum(arrays)


def _steps(lists: list[np.ndarray]) -> Iterator[list[int]]:
    at, size = [], 0
    for i, x in enumerate(lists):
        at.append(i)
        size += len(x)
        if size >= STEP:
            yield at
            at, size = [], 0
    if at:
        yield at


def _phrases(level: int, min_count: int, buckets: int, rows: bool):
    """Levels 2 and 3 in a shard: the pairs' ids to each part, or (``rows``) the frequent phrases with their parts' ids and counts."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket, t = key[0].as_py(), t.sort_by("part")
        lists = [textops.unpack_sorted(x) for x in t.column("body").to_pylist()]
        candidates, total = slot_counts(lists, [textops.unplanes(x) for x in t.column("extra").to_pylist()])
        ids = _frequent(total, min_count, bucket, buckets, PAIR_BITS if level == 2 else 62, "pairs")
        if not rows:
            return corpus.reply_table([(p, PAIR_IDS, bucket, textops.planes(ids[candidates.slots(k)])) for p, k in zip(t.column("part").to_pylist(), lists, strict=True)])
        at = np.flatnonzero(ids != NONE)
        keys = textops.unmix(candidates.keys[at])
        n = len(at)
        return pa.table(
            [pa.array(np.full(n, level), pa.int32()), pa.array(ids[at].astype(np.int64)), pa.array((keys >> np.uint64(WORD_BITS)).astype(np.int64)), pa.array((keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(total[at])],
            ["level", "id", "left", "right", "lang", "word", "n"],
        )

    return run


def _pairs(buckets: int):
    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return corpus.request_table([])
        p = _Part(t)
        return _counted(key[0].as_py(), p.pairs(p.ids(replies))[1], buckets)

    return run


def _triples(buckets: int):
    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return corpus.request_table([])
        p = _Part(t)
        ids = p.ids(replies)
        at, keys = p.pairs(ids)
        _, which = np.unique(textops.mix(keys), return_inverse=True)
        pairs = textops.unplanes(_joined(replies, PAIR_IDS))[which] if len(at) else keys
        return _counted(key[0].as_py(), p.triples(ids, at, pairs), buckets)

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, part_bytes: int = corpus.PART_BYTES) -> DataFrame:
    """COUNT_SCHEMA rows, stored: level 0 the words of each lang (in pieces), 1 frequent words, 2 frequent pairs of words, 3 frequent triples of a pair and a word."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    split, parts = corpus.parted(docs, part_bytes, "lang")
    buckets = 2 * parts
    texts = split.groupBy("part")
    words = texts.applyInArrow(_words(buckets), corpus.REQUEST_SCHEMA)
    ids = words.groupBy("bucket").applyInArrow(_word_ids(min_count, buckets, False), corpus.REPLY_SCHEMA)
    pairs = texts.cogroup(ids.groupBy("part")).applyInArrow(_pairs(buckets), corpus.REQUEST_SCHEMA)
    out = words.groupBy("bucket").applyInArrow(_word_ids(min_count, buckets, True), COUNT_SCHEMA).unionByName(pairs.groupBy("bucket").applyInArrow(_phrases(2, min_count, buckets, True), COUNT_SCHEMA))
    if max_words > 2:
        pair_ids = pairs.groupBy("bucket").applyInArrow(_phrases(2, min_count, buckets, False), corpus.REPLY_SCHEMA)
        triples = texts.cogroup(ids.unionByName(pair_ids).groupBy("part")).applyInArrow(_triples(buckets), corpus.REQUEST_SCHEMA)
        out = out.unionByName(triples.groupBy("bucket").applyInArrow(_phrases(3, min_count, buckets, True), COUNT_SCHEMA))
    return corpus.table(out, "phrase-counts")


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)), exact: counts have 14 digits at most."""
    exact = lambda c: f"cast({c} as decimal(14,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {exact(a)} * {exact(a)}) div ({exact(left)} * {exact(right)})").cast("long")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, percent: int = PERCENT, top: int = TOP, max_words: int = MAX_WORDS, part_bytes: int = corpus.PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top`` phrases of two to ``max_words`` (2 or 3) words."""
    if max_words not in (2, 3) or min_count < 1 or top < 1:
        raise ValueError("phrases have 2 or 3 words, and min_count and top are 1 or more")
    counts = phrase_counts(docs, min_count, max_words, part_bytes)
    of = lambda level: counts.where(F.col("level") == level)
    word = lambda name: of(1).select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))
    totals = of(0).groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = of(2).select(F.col("id").alias("pair"), F.col("left").alias("x"), F.col("right").alias("y"), F.col("n").alias("a"))
    pairs = pairs.join(word("x").join(of(1).select(F.col("id").alias("x"), "lang"), "x"), "x").join(word("y"), "y")
    scored = pairs.withColumn("score", _score("a", "x_n", "y_n"))
    found = scored.select("pair", "lang", F.concat_ws(" ", "x_word", "y_word").alias("phrase"), "a", F.col("x_n").alias("l"), F.col("y_n").alias("r"), "score")
    if max_words > 2:
        triples = of(3).select(F.col("left").alias("pair"), F.col("right").alias("z"), F.col("n").alias("f"))
        triples = triples.join(scored.select("pair", "lang", "x", "y", "x_word", "y_word", "x_n", F.col("a").alias("pair_n")), "pair")
        second = scored.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("pair").alias("second"), F.col("a").alias("second_n"), F.col("y_word").alias("z_word"), F.col("y_n").alias("z_n"))
        triples = triples.join(second, ["y", "z"]).withColumn("first_cut", _score("f", "x_n", "second_n")).withColumn("second_cut", _score("f", "pair_n", "z_n"))
        first = F.col("first_cut") <= F.col("second_cut")
        held = [triples.where(100 * F.col("f") >= percent * F.col(n)).select(F.col(p).alias("pair")) for p, n in (("pair", "pair_n"), ("second", "second_n"))]
        found = found.join(held[0].unionByName(held[1]).distinct(), "pair", "left_anti").drop("pair").unionByName(
            triples.select("lang", F.concat_ws(" ", "x_word", "y_word", "z_word").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("x_n")).otherwise(F.col("pair_n")).alias("l"), F.when(first, F.col("second_n")).otherwise(F.col("z_n")).alias("r"), F.least("first_cut", "second_cut").alias("score"))
        )
    else:
        found = found.drop("pair")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a lang's first are among the firsts of its slices, so that no task sorts a whole lang
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
