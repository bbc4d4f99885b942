"""MinHash near-dedup: banded candidates, odd sketches to sift them, full sets to confirm.

A document's set is its distinct shingles of ``size`` words. Its MinHash samples fall into
bands, and documents that share a band are candidates. The samples also fold into an odd
sketch, a bitmap of parities; the population count of two sketches' XOR estimates their
similarity, most sharply where it is high, and pairs estimated six deviations under the
threshold go. What remains is confirmed on the full sets. Bands and sift follow ``percent``:
op3 asks for ``PERCENT``, the pipeline's stage for ``STAGE_PERCENT``.

Documents with equal sets are one node, so copies never meet as pairs. A band first links
its members to its smallest one. Where members of a band then still lie in different
components, shingles are counted over those members: one with too few shingles that any
other has can link with none and leaves, which lowers the counts of the rest. The shingles
of those that stay are rare, held by ``RARE`` of them at most, or common. A pair shares at
most the rare ones that it is found to share plus the smaller number of common ones:

- pairs that share a rare shingle come from its list, of bounded length, with their count;
- a pair that shares none needs enough common ones in both. Only documents made almost
  wholly of common shingles have them; those meet in blocks of a band's members, by counts
  and sketches. Each round confirms a member's best 16, then 16 times as many, until no
  unconfirmed pair is left between components.

So no pair is dropped. Sets of 64-bit shingle hashes confirm; a document with many partners
is sent to a few tasks that stream the partners past it, not once a pair.

Defined cases: null, empty or blank texts have an empty set and link with nothing; a text
of fewer words is one shingle; rows that share a doc_id are one node; a null doc_id is
its own unlinked row, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus, graph, textops

SHINGLE = 5
PERCENT = 85
STAGE_PERCENT = 80
#: The usual number of bands, and the greatest chance that a pair at the threshold shares none.
BANDS, MISS = 32, 1e-7
SAMPLES = 256
SKETCH_BITS = 1024
DEVIATIONS = 6
PEELS = 3
RARE = 16
BLOCK_MEMBERS = 8192
FIRST_EACH = 16
#: Tasks among which one document's partners are dealt, and one class's rows.
SALTS = 32
SIGNATURE = "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch binary"

_rng = np.random.Generator(np.random.Philox(key=[20, 26]))
_A = (_rng.integers(0, 1 << 32, SAMPLES, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each document, ascending, and the hashes before each document."""
    s, e, words = textops.words(data, offsets, textops.SPACE_WORD)
    h = textops.word_hashes(data, s, e, lower=True)
    n = np.diff(words)
    grams = textops.gram_hashes(h, size)
    at = np.flatnonzero(textops.inside_documents(words, size)) if len(grams) else np.zeros(0, np.int64)
    doc = np.searchsorted(words, at, "right") - 1
    keys = grams[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = np.array([textops.gram_hashes(h[words[i] : words[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short], np.uint64)
        keys, doc = np.concatenate([keys, own]), np.concatenate([doc, short])
    by = np.lexsort((keys, doc))
    keys, doc = keys[by], doc[by]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(offsets)))


def minhash(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, SAMPLES) minima; every document has a key."""
    h = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), SAMPLES), np.uint32)
    v = np.empty_like(h)
    for k in range(SAMPLES):
        np.multiply(h, _A[k], out=v)
        v += _B[k]
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows, four at most, at which a pair at the threshold shares no band with chance ``MISS`` or less."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is not 1 to 100: {percent}")
    for rows in (4, 3, 2, 1):
        if (1 - (percent / 100) ** rows) ** BANDS <= MISS:
            return BANDS, rows
    bands = math.ceil(math.log(MISS) / math.log(1 - percent / 100))
    if bands > SAMPLES:
        raise ValueError(f"{SAMPLES} samples are too few for {percent} percent")
    return bands, 1


def band_keys(samples: np.ndarray, count: int, rows: int) -> np.ndarray:
    v = samples[:, : count * rows].reshape(len(samples), count, rows).astype(np.uint64)
    acc = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        acc = textops.mix(acc ^ v[:, :, r] * np.uint64(0xD6E8FEB86659FD93))
    return acc


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_BITS / 8) bytes: parities of the samples that hash to each bit."""
    n = len(samples)
    bit = (textops.mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits of two odd sketches."""
    x = np.minimum(differing / SKETCH_BITS, 0.4999)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - 2 * x)


def sift(percent: int) -> float:
    """The least estimate of a pair that is not sifted out: the threshold less ``DEVIATIONS`` of the estimate's.

    Differing samples are binomial; those whose bits collide, about Poisson, cancel.
    """
    j = percent / 100
    samples = j * (1 - j) / SAMPLES
    collisions = 2 * (1 - j) ** 2 / SKETCH_BITS * math.exp(8 * SAMPLES * (1 - j) / SKETCH_BITS)
    return j - DEVIATIONS * math.sqrt(samples + collisions)


def most_bits(percent: int) -> int:
    """The most differing bits of a pair that is not sifted out."""
    return int(np.max(np.flatnonzero(estimate(np.arange(SKETCH_BITS)) >= sift(percent))))


MOST_BITS = most_bits(PERCENT)


def _signatures(size: int, percent: int):
    count, rows = banding(percent)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            data, offsets = textops.flat(batch.column("text"))
            for a, b in textops.blocks(offsets, textops.BLOCK_BYTES):
                keys, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                bands = [None] * (b - a)
                sketch = [None] * (b - a)
                if len(full):
                    starts = at[:-1][full]
                    f1[full] = np.add.reduceat(keys, starts)
                    f2[full] = np.add.reduceat(textops.mix(keys ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    samples = minhash(keys, starts)
                    for i, k, s in zip(full.tolist(), band_keys(samples, count, rows).view(np.int64), odd_sketches(samples), strict=True):
                        bands[i], sketch[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n", "f1", "f2", "bands", "sketch"])

    return run


def _sets(size: int, arrays: bool = False):
    """(id, keys): a document's set as bytes, or as an array."""

    def run(batches):
        for batch in batches:
            data, offsets = textops.flat(batch.column("text"))
            for a, b in textops.blocks(offsets, textops.BLOCK_BYTES):
                keys, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64))) if arrays else pa.array([keys[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), sets], ["id", "keys"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """Rows come in order of (a, salt, b), the sets of ``a`` itself first, with a null b."""

    def run(batches):
        key, heads = None, []
        for batch in batches:
            out = ([], [], [])
            for a, salt, b, keys in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist(), batch.column("keys"), strict=True):
                if (a, salt) != key:
                    key, heads = (a, salt), []
                own = np.frombuffer(keys.as_buffer(), np.uint64)
                if b is None:
                    heads.append(own.copy())
                else:
                    for c, v in zip(out, (a, b, any(_linked(h, own, percent) for h in heads)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "linked"])

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) of candidate pairs, from the full sets of their texts; a stored table."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct()
    sets = corpus.table(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(corpus.trimmed(_sets(size)), "id long, keys binary"), "sets")
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"), "b")
    heads = dealt.select("a", "salt").distinct().join(sets, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "keys")
    bodies = dealt.join(sets, F.col("b") == F.col("id")).select("a", "salt", "b", "keys")
    stream = heads.unionByName(bodies).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    found = stream.mapInArrow(corpus.trimmed(_confirm(percent)), "a long, b long, linked boolean")
    # rows that share a doc_id are one node: any of its texts may link it
    out = corpus.table(found.groupBy("a", "b").agg(F.bool_or("linked").alias("linked")), "confirmed")
    corpus.drop(sets)
    return out


def _block_pairs(t: pa.Table, each: int, percent: int):
    """(a, b, more) arrays of one block or pair of blocks: each member's ``each`` best partners after it, of pairs whose first common band this is."""
    members = t.num_rows
    sketch = np.frombuffer(textops.flat(t.column("sketch"))[0].tobytes(), "<u8").reshape(members, -1)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(members, -1)
    ids, comp, side, n, held = (t.column(c).to_numpy() for c in ("id", "component", "side", "n", "held"))
    cross, band = t.column("i")[0] != t.column("j")[0], t.column("band")[0].as_py()
    most = most_bits(percent)
    for x in range(members - 1):
        shared = np.minimum(held[x], held[x + 1 :])
        ok = (comp[x + 1 :] != comp[x]) & (100 * shared >= percent * (n[x] + n[x + 1 :] - shared))
        if cross:
            ok &= side[x + 1 :] != side[x]
        y = np.flatnonzero(ok) + x + 1
        if not len(y):
            continue
        bits = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1)
        near = bits <= most
        y, bits = y[near], bits[near]
        first = bands[x][(bands[y] == bands[x]).argmax(axis=1)] == band
        y, bits = y[first], bits[first]
        if len(y):
            more = len(y) > each
            if more:
                y = y[np.lexsort((ids[y], bits))[:each]]
            yield np.minimum(ids[y], ids[x]), np.maximum(ids[y], ids[x]), np.full(len(y), more)


def _pairs_in_blocks(each: int, percent: int):
    """Rows arrive grouped by (band, i, j); groups are cut from the stream, at most two blocks long."""

    def emit(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        found, size = [], 0
        for out in _block_pairs(t, each, percent) if t.num_rows > 1 else ():
            found.append(out)
            size += len(out[0])
            if size >= 1 << 16:
                yield batch_of(found)
                found, size = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b", "more"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "i", "j")], axis=1)
            cuts = (np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
                if tuple(k[a]) != key:
                    if held:
                        yield from emit(held)
                    key, held = tuple(k[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit(held)

    return run


def _mixed(members: DataFrame, least: int = 2) -> DataFrame:
    """Bands of more than ``least`` members that lie in different components, from (band, id, component)."""
    return members.groupBy("band").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where(f"lo < hi and c > {least}").select("band", "c")


def _labelled(bands: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("id").alias("_id"), "component")
    return bands.join(named, F.col("id") == F.col("_id"), "left").select("band", "id", F.coalesce("component", "id").alias("component"))


def _open_nodes(docs: DataFrame, bands: DataFrame, labels: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of mixed bands that may still link: (id, n, rare, common), how many of their n shingles are rare and common ones; and (id, k), their rare shingles."""
    members = _labelled(bands, labels)
    ids = members.join(_mixed(members), "band").select(F.col("id").alias("doc_id")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(corpus.trimmed(_sets(size, True)), "id long, keys array<long>")
    rows = corpus.table(sets.select("id", F.explode("keys").alias("k")).distinct(), "shingles")
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    held, stored = None, [rows]
    for _ in range(PEELS):
        alive = rows if held is None else rows.join(held.select("id"), "id", "left_semi")
        shared = alive.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
        counted = alive.join(shared, "k")
        sums = counted.groupBy("id").agg(F.count_if(F.col("c") <= RARE).alias("rare"), F.count_if(F.col("c") > RARE).alias("common"))
        held = corpus.table(sums.join(sizes, "id").where(100 * (F.col("rare") + F.col("common")) >= percent * F.col("n")).select("id", "n", "rare", "common"), "open")
        stored.append(held)
    # counts were over those alive before the last departures: never too low
    rare = corpus.table(counted.where(F.col("c") <= RARE).join(held.select("id"), "id", "left_semi").select("id", "k"), "rare")
    corpus.drop(*stored[:-1])
    return held, rare


def _sharing_rare(rare: DataFrame, alive: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): open nodes of different components that share rare shingles, and enough of all by the counts."""
    named = labels.select(F.col("id").alias("_id"), "component")
    nodes = alive.join(named, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("component"), "n", "rare", "common")
    lists = rare.join(nodes, "id").groupBy("k").agg(F.collect_list(F.struct("id", "component", "n", "rare", "common")).alias("l"))
    enough = "100 * ({0}) >= {1} * (x.n + y.n - ({0}))".format("least(x.rare, y.rare) + least(x.common, y.common)", percent)
    pair = "named_struct('a', x.id, 'b', y.id, 'n', x.n + y.n, 'common', least(x.common, y.common))"
    pairs = lists.select(F.explode(F.expr(f"flatten(transform(l, x -> transform(filter(l, y -> y.id > x.id and y.component <> x.component and {enough}), y -> {pair})))")).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg((F.count("*") + F.max("p.common")).alias("both"), F.max("p.n").alias("n"))
    return counted.where(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("a", "b")


def _between_components(bands: DataFrame, sketches: DataFrame, labels: DataFrame, alive: DataFrame, each: int, percent: int) -> DataFrame:
    """(a, b, more): sifted pairs of open nodes of different components that share a band, of those that may link by common shingles alone."""
    able = alive.where(100 * F.col("common") >= percent * F.col("n")).select("id", "n", F.col("common").alias("held"))
    members = _labelled(bands.join(able.select("id"), "id", "left_semi"), labels)
    rows = members.join(_mixed(members, 1), "band")
    blocks = F.ceil(F.col("c") / BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("side", own).join(able, "id").join(sketches, "id")
    held = ["band", "id", "component", "sketch", "bands", "side", "n", "held"]
    dealt = rows.select(*held, F.explode(F.expr("sequence(0, blocks - 1)")).alias("o")).select(*held, F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    grouped = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id")
    return grouped.mapInArrow(corpus.trimmed(_pairs_in_blocks(each, percent)), "a long, b long, more boolean")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signs = corpus.table(docs.mapInArrow(corpus.trimmed(_signatures(size, percent)), SIGNATURE), "signatures")
    known = signs.where("n > 0 and doc_id is not null")
    classes = corpus.table(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")), "classes")
    nodes = known.select(F.col("doc_id").alias("id"), "bands", "sketch").join(classes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    bands = nodes.select("id", F.explode("bands").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1")
    bands = corpus.table(bands.join(shared.select("band", F.col("a").alias("first")), "band").select("band", "id", "first"), "bands")
    sketches = corpus.table(nodes.select("id", "sketch", "bands").join(bands.select("id").distinct(), "id", "left_semi"), "sketches")

    words = F.transform(F.sequence(F.lit(0), F.lit(SKETCH_BITS // 64 - 1)), lambda i: F.conv(F.substring(F.hex("sketch"), i * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    longs = sketches.select("id", words.alias("w"))
    firsts = bands.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    differing = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    firsts = firsts.join(longs.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b").join(longs.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").where(differing <= most_bits(percent)).select("a", "b").distinct()

    tried = confirmed(docs, corpus.table(firsts, "pairs"), size, percent)
    labels = graph.components(tried.where("linked"))
    bands = bands.select("band", "id")
    alive, rare = _open_nodes(docs, bands, labels, size, percent)

    def joined(new: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = confirmed(docs, new, size, percent)
        links = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return found, graph.components(links.unionByName(found.where("linked").select("a", "b")))

    new = corpus.table(_sharing_rare(rare, alive, labels, percent), "pairs")
    if not new.isEmpty():
        found, labels = joined(new)
        tried = corpus.table(tried.unionByName(found), "confirmed")
    each, more = FIRST_EACH, True
    while more:
        pairs = corpus.table(_between_components(bands, sketches, labels, alive, each, percent).groupBy("a", "b").agg(F.bool_or("more").alias("more")), "pairs")
        more = bool(pairs.agg(F.coalesce(F.bool_or("more"), F.lit(False))).first()[0])
        new = pairs.join(tried, ["a", "b"], "left_anti").select("a", "b")
        if not new.isEmpty():
            found, labels = joined(new)
            tried = corpus.table(tried.unionByName(found), "confirmed")
        corpus.drop(pairs)
        each *= 16
    corpus.drop(bands, sketches, alive, rare, tried)
    return _result(signs, classes, labels)


def _result(signs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    # only classes of several documents or with links say something new; a class's rows are dealt among SALTS tasks
    named = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").where("c > 1 or component is not null")
    named = named.select("n", "f1", "f2", F.coalesce("component", "node").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = signs.select("doc_id", "n", "f1", "f2", salt.alias("salt")).join(named, ["n", "f1", "f2", "salt"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id."""
    gone = near_duplicates(docs, percent=STAGE_PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
