"""Benchmark decontamination over a distributed positional inverted index.

The index stores, for a term and a text, the positions of the term's words. Terms' counts
over the corpus come first; then postings of the terms that probe: for each window of a
test item the two rarest of its terms. Lists are intersected from the rarest: a posting at
``p`` of the term at item offset ``o`` puts the item at ``p - o`` in the text, and a window
is a candidate where both its terms agree on that place. Candidates are confirmed word by
word on the whole text, and confirmed windows give the hit words.

A window that stands in an item several times probes once, at its first place, so repeated words cost
no more than others. Texts are keyed by a 64-bit hash: copies are postings each, but meet as one when
candidates are made distinct; two
texts that share a key share candidates, which confirmation tells apart. Test items are
read in slices of at most ``SLICE_WORDS`` words (an item is never cut), the bound of all
that the driver holds and sends to every machine; each slice runs against all documents and
is stored before the next is read. Rows of one text key are dealt among ``SALTS`` tasks.

Defined cases: null texts have no words; items without words are ignored; an item of
fewer words than a window is one window; a null item_id is written as an empty string;
repeated items count once; repeated documents are reported each; empty tables give no hits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus, textops

WINDOW = 13
SLICE_WORDS = 500_000
SALTS = 16
INDEX_SCHEMA = "term long, doc long, positions array<int>, n_words long, doc_id long"


def _hashed(column, lower: bool = True):
    """Word hashes as signed 64-bit, and words before each row."""
    data, offsets = textops.flat(column)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in textops.blocks(offsets, textops.BLOCK_BYTES):
        local = data[offsets[a] : offsets[b]]
        s, e, at = textops.words(local, offsets[a : b + 1] - offsets[a], textops.ALNUM_WORD)
        hashes.append(textops.word_hashes(local, s, e, lower))
        counts.append(np.diff(at))
    return np.concatenate(hashes).view(np.int64), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _member(h: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose value is among the ascending terms, and which term it is. A bit table sorts most out."""
    bits = max(16, int(len(terms) * 16).bit_length())
    table = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    table[terms.view(np.uint64) >> shift] = True
    at = np.flatnonzero(table[h.view(np.uint64) >> shift])
    which = np.searchsorted(terms, h[at])
    which[which == len(terms)] = 0
    ok = terms[which] == h[at] if len(terms) else np.zeros(len(at), bool)
    return at[ok], which[ok]


def _count(terms: np.ndarray):
    def run(batches):
        n = np.zeros(len(terms), np.int64)
        for batch in batches:
            h, _ = _hashed(batch.column("text"))
            n += np.bincount(_member(h, terms)[1], minlength=len(terms))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some]), pa.array(n[some])], ["term", "n"])

    return run


def _postings(terms: np.ndarray | None, documents: bool):
    """Index rows: one a document (term null) if asked for, and one for each term and document."""
    schema = pa.schema([("term", pa.int64()), ("doc", pa.int64()), ("positions", pa.list_(pa.int32())), ("n_words", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            h, words = _hashed(batch.column("text"))
            key = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(words) - 1
            if documents:
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(key), pa.nulls(n, pa.list_(pa.int32())), pa.array(np.diff(words)), batch.column("doc_id").cast(pa.int64())], schema=schema)
            at, term = (np.arange(len(h)), h) if terms is None else _member(h, terms)
            if terms is not None:
                term = terms[term]
            doc = np.searchsorted(words, at, "right") - 1
            by = np.lexsort((at, term, doc))
            at, term, doc = at[by], term[by], doc[by]
            new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(at) else np.zeros(0, np.int64)
            for a in range(0, len(new), 50_000):
                heads = new[a : a + 50_000]
                end = int(new[a + 50_000]) if a + 50_000 < len(new) else len(at)
                pos = (at[heads[0] : end] - words[doc[heads[0] : end]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, end) - heads[0], pa.int32()), pa.array(pos))
                none = pa.nulls(len(heads), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(term[heads]), pa.array(key[doc[heads]]), lists, none, none], schema=schema)

    return run


def build_index(docs: DataFrame, terms: np.ndarray | None = None, documents: bool = True) -> DataFrame:
    """Postings of the given terms (all terms where None) and, with a null term, each document's length; a stored table."""
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("doc"))
    return corpus.table(source.mapInArrow(corpus.trimmed(_postings(terms, documents)), INDEX_SCHEMA), "postings")


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items with words, in slices of at most ``limit`` words (an item is never cut)."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        h, _ = _hashed(pa.array([r["text"]], pa.string()))
        if not len(h):
            continue
        if held and size + len(h) > limit:
            yield held
            held, size = [], 0
        held.append((r["item_id"], h))
        size += len(h)
    if held:
        yield held


def _probes(items: list[tuple[str, np.ndarray]], terms: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Distinct (item, offset and term of a window's rarest word, then of its next rarest; -1 and 0 where it has one word)."""
    out = []
    for i, (_, h) in enumerate(items):
        n = counts[np.searchsorted(terms, h)]
        width = min(window, len(h))
        # rarest first, ties by place; a window with a word that no document has is left out
        key = (n << 32) + np.arange(len(h))
        views = np.lib.stride_tricks.sliding_window_view(key, width)
        first, _ = textops.distinct(textops.gram_hashes(h.view(np.uint64), width), textops.gram_hashes(h.view(np.uint64), width, 1))
        first = np.sort(first)
        for a in range(0, len(first), 100_000):
            two = views[first[a : a + 100_000]]
            two = np.sort(np.partition(two, min(1, width - 1), axis=1)[:, :2], axis=1)
            two = np.unique(two[two[:, 0] >> 32 > 0], axis=0)
            o1 = two[:, 0] & 0xFFFFFFFF
            o2 = two[:, 1] & 0xFFFFFFFF if width > 1 else np.full(len(two), -1)
            out.append(np.stack([np.full(len(two), i), o1, h[o1], o2, h[o2] if width > 1 else np.zeros(len(two), np.int64)], axis=1))
    rows = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 5), np.int64)
    return tuple(rows.T)


def _candidates(index: DataFrame, probes: tuple[np.ndarray, ...]) -> DataFrame:
    """(doc, places: item and where its first word would stand), from offset-adjusted lists, rarest first."""
    spark = index.sparkSession
    i, o1, t1, o2, t2 = probes
    table = lambda names, *columns: spark.createDataFrame(pa.table(list(columns), names))
    first = table(["item", "o1", "term", "o2"], i.astype(np.int32), o1.astype(np.int32), t1, o2.astype(np.int32))
    pairs = np.unique(np.stack([i, o2, t2], axis=1)[o2 >= 0], axis=0)
    second = table(["item", "o2", "term"], pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), pairs[:, 2])
    lists = index.where("term is not null").select("term", "doc", "positions")
    place = lambda df, o: df.withColumn("at", F.explode(F.transform("positions", lambda p: p - F.col(o)))).drop("positions", "term")
    # probes are at most a slice's words
    one = place(lists.join(F.broadcast(first), "term"), "o1").where("at >= -o1").select("doc", "item", "at", "o2").distinct()
    two = place(lists.join(F.broadcast(second), "term"), "o2").select("doc", "item", "at", "o2")
    both = one.where("o2 >= 0").join(two, ["doc", "item", "at", "o2"], "left_semi")
    found = both.unionByName(one.where("o2 < 0")).select("doc", "item", "at").distinct()
    return found.groupBy("doc").agg(F.collect_list(F.struct("item", "at")).alias("places"))


def _confirm(items: list[tuple[str, np.ndarray]], window: int):
    schema = pa.schema([("doc", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        for batch in batches:
            h, words = _hashed(batch.column("text"))
            rows = ([], [], [])
            for r, (doc, places) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                own = h[words[r] : words[r + 1]]
                hit = np.zeros(len(own) + 1, np.int32)
                ids = set()
                for p in places:
                    name, item = items[p["item"]]
                    a, b = max(0, p["at"]), min(len(own), p["at"] + len(item))
                    if b <= a:
                        continue
                    same = np.concatenate([[False], own[a:b] == item[a - p["at"] : b - p["at"]], [False]])
                    edge = np.flatnonzero(same[1:] != same[:-1])
                    for s, e in zip(edge[0::2], edge[1::2], strict=True):
                        if e - s >= min(window, len(item)):
                            hit[a + s] += 1
                            hit[a + e] -= 1
                            ids.add(name)
                if ids:
                    covered = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
                    edge = np.flatnonzero(covered[1:] != covered[:-1])
                    rows[0].append(doc)
                    rows[1].append(sorted(ids))
                    rows[2].append([{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def _merge(batches):
    """Spans of one text from several slices: overlapping or touching ones as one, in order."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict] = []
            for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
                if merged and merged[-1]["end"] >= x["start"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(dict(x))
            out.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("items"), pa.array(out, batch.schema.field("spans").type)], ["doc", "items", "spans"])


HITS = "doc long, items array<string>, spans array<struct<start:int,end:int>>"


def _dealt(found: DataFrame) -> DataFrame:
    """Each row once for every salt, to meet the salted rows of a text that may have any number of copies."""
    return found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Per document: doc_id, doc (text key), n_words, items (ids of items with an occurring window), spans (hit words, merged)."""
    spark = docs.sparkSession
    corpus.small_batches(spark)
    keyed = _salted(docs.select("doc_id", "text", F.xxhash64("text").alias("doc")))
    lengths, every = None, spark.createDataFrame([], HITS)
    for items in itertools.chain(_slices(benchmark, slice_words), [None]):
        if items is None and lengths is not None:
            break
        items = items or []
        terms = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.int64)
        counts = np.zeros(len(terms), np.int64)
        if items:
            found = docs.select("text").mapInArrow(corpus.trimmed(_count(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
            counts[np.searchsorted(terms, found.column("term").to_numpy())] = found.column("n").to_numpy()
        probes = _probes(items, terms, counts, window)
        wanted = np.unique(np.concatenate([probes[2], probes[4][probes[3] >= 0]])).astype(np.int64)
        index = build_index(docs, wanted, documents=lengths is None)
        if lengths is None:
            lengths = index.where("term is null").select("doc_id", "doc", "n_words")
        if len(probes[0]):
            places = _dealt(_candidates(index, probes))
            hits = keyed.join(places, ["doc", "_salt"]).select("doc", "text", "places").mapInArrow(corpus.trimmed(_confirm(items, window)), HITS)
            every = every.unionByName(corpus.table(hits, "hits"))
    # copies of a text confirm the same; two texts of one key would be told apart by length
    each = every.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))
    out = _salted(lengths).join(_dealt(each.mapInArrow(corpus.trimmed(_merge), HITS)), ["doc", "_salt"], "left")
    return out.select("doc_id", "doc", "n_words", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))


def _verdict(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    found = _verdict(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no test item contaminates."""
    found = _verdict(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).where("contaminated").select(F.col("doc").alias("_doc")).distinct()
    return docs.withColumn("_doc", F.xxhash64("text")).join(found, "_doc", "left_anti").select(*docs.columns)


def term(word: str) -> int:
    """The index key of a word."""
    return int(_hashed(pa.array([word]))[0][0])


def _query_terms(index: DataFrame, queries: dict[str, str]) -> DataFrame:
    rows = []
    for name, text in queries.items():
        rows += [(name, o, int(t)) for o, t in enumerate(_hashed(pa.array([text]))[0])]
    return index.sparkSession.createDataFrame(rows, "query string, o int, term long")


def phrase_search(index: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query, doc, at): where each phrase stands in each text of a full index."""
    q = _query_terms(index, queries)
    need = q.groupBy("query").agg(F.count("*").alias("need"))
    lists = index.where("term is not null").dropDuplicates(["term", "doc"])
    at = lists.join(q, "term").select("query", "doc", "o", F.explode(F.transform("positions", lambda p: p - F.col("o"))).alias("at"))
    return at.groupBy("query", "doc", "at").agg(F.count("*").alias("n")).join(need, "query").where("n = need").select("query", "doc", "at")


def proximity_search(index: DataFrame, queries: dict[str, str], slop: int) -> DataFrame:
    """(query, doc, at): positions of a query's rarest term with every other term at most ``slop`` words away."""
    q = _query_terms(index, queries).select("query", "term").distinct()
    lists = index.where("term is not null").dropDuplicates(["term", "doc"])
    rarity = lists.join(q.select("term").distinct(), "term").groupBy("term").agg(F.sum(F.size("positions")).alias("df"))
    need = q.groupBy("query").agg(F.count("*").alias("need"))
    own = lists.join(q.join(rarity, "term"), "term").groupBy("query", "doc").agg(F.array_sort(F.collect_list(F.struct("df", "term", "positions"))).alias("lists"))
    full = own.join(need, "query").where("size(lists) = need")
    near = F.expr(f"filter(lists[0].positions, p -> forall(lists, l -> exists(l.positions, x -> abs(x - p) <= {int(slop)})))")
    return full.select("query", "doc", F.explode(near).alias("at"))
