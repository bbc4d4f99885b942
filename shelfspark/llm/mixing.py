"""Mixing sources to target weights.

Words of a source are packed, document after document, into blocks of ``block`` words.
Every output shard draws from its own seed how many slots each source fills, a multinomial
over the targets, and a source's j-th slot takes block ``perm(j mod blocks)``, a keyed
pseudorandom permutation of its block indices: each pass over a source uses every block
once. Slots beyond a source's target are left out, and what the draws left it short of fills
shards of its own at the end, so the slots add up to the targets. Blocks join by (source,
index).

Targets: sources by code point, null last, weigh ``weights``, repeating, and share
``size_factor`` of all words; a target stops at ``most`` times its source, and the excess
goes to the others by weight until none is above.

One row a source reaches the driver, the list for which a caller sets weights; shards draw
in tasks, and a source's first slot in each shard is a sum in two levels. Packing
needs each document's place in its source: documents are dealt into groups by hash, the
groups' sums are added up, and places follow inside a group, so a source that holds a
third of all rows is many groups.

Defined cases: null or empty texts have size 0 and take nothing; a null source is a
source; null doc_ids order last in their group; rows that share a doc_id are separate
documents; an empty table gives an empty mix. The same rows give the same mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import corpus

BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
SIZE_FACTOR = 1.5
MOST = 2.0
SHARD_SLOTS = 65_536
GROUP_DOCS = 4096
GROUP_SHARDS = 4096
#: Slots that one task makes.
TASK_SLOTS = 1 << 18

_SPACE = r"[\\x20\\x09-\\x0D]+"
_TRIM = "' \t\n\x0b\f\r'"


def word_array(text: str = "text") -> str:
    """SQL for the words of a text, in order."""
    trimmed = f"trim(BOTH {_TRIM} FROM coalesce({text}, ''))"
    return f"transform(array({trimmed}), t -> if(t = '', cast(array() as array<string>), split(t, '{_SPACE}')))[0]"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, size_factor: float = SIZE_FACTOR, most: float = MOST) -> list[float]:
    """Words each source gives, for sources in their order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total = size_factor * sum(sizes)
    out, free = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}
    while free:
        share = (total - sum(out[i] for i in range(len(sizes)) if i not in free)) / sum(w[i] for i in free)
        full = {i for i in free if share * w[i] >= most * sizes[i]}
        for i in free:
            out[i] = most * sizes[i] if i in full else share * w[i]
        if not full:
            break
        free -= full
    return out


def draw(shard: int, wanted: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """Slots of each source in a shard: a multinomial over the targets, of the room that the shard has."""
    total = int(wanted.sum())
    room = min(shard_slots, total - shard * shard_slots)
    rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
    return rng.multinomial(room, wanted / total)


def draws(spark, wanted: list[int], shard_slots: int, seed: int) -> DataFrame:
    """(shard, i, n, first): slots of source ``i`` in each shard, and how many it has in earlier ones; they add up to ``wanted``."""
    goal = np.array(wanted, np.int64)
    shards = -(-int(goal.sum()) // shard_slots)
    schema = "shard long, i int, n long, first long"
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                n = draw(shard, goal, shard_slots, seed)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(n[some])], ["shard", "i", "n"])

    drawn = spark.range(0, shards, 1, max(1, shards // 256)).mapInArrow(corpus.trimmed(run), "shard long, i int, n long").withColumn("g", F.expr(f"shard div {GROUP_SHARDS}"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = drawn.groupBy(F.col("i").alias("_i"), F.col("g").alias("_g")).agg(F.sum("n").alias("n"))
    groups = groups.withColumn("_before", earlier(Window.partitionBy("_i").orderBy("_g"))).drop("n")
    local = drawn.withColumn("_in", earlier(Window.partitionBy("i", "g").orderBy("shard")))
    placed = local.join(groups, (F.col("i") == F.col("_i")) & (F.col("g") == F.col("_g"))).select("shard", "i", "n", (F.col("_before") + F.col("_in")).alias("first"))
    # one row a source: its target, for the cut, and what it was drawn, for the rest
    totals = {r["i"]: r["n"] for r in drawn.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    goals = spark.createDataFrame([(i, int(n)) for i, n in enumerate(wanted)], "_i int, goal long")
    cut = placed.join(goals, F.col("i") == F.col("_i")).select("shard", "i", F.least("n", F.col("goal") - F.col("first")).alias("n"), "first").where("n > 0")
    rest, at = [], 0
    for i, n in enumerate(wanted):
        first = totals.get(i, 0)
        while first < n:
            size = min(n - first, shard_slots - at % shard_slots)
            rest.append((shards + at // shard_slots, i, size, first))
            first, at = first + size, at + size
    return cut.unionByName(spark.createDataFrame(rest, schema)) if rest else cut


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed bijection of range(size) for each row: a Feistel network over the next even number of bits, walked into range."""
    from .textops import mix

    size = size.astype(np.uint64)
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))) + 1).astype(np.int64) // 2).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    x = index.astype(np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        b, m, k = bits[todo], low[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> b, x[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (mix(right ^ k + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        x[todo] = left << b | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def placed(docs: DataFrame, group_docs: int = GROUP_DOCS, texts: bool = True) -> DataFrame:
    """The documents with size and first (the document's first word in its source's packed stream)."""
    count = docs.count()
    groups = max(1, -(-count // group_docs))
    sized = docs.withColumn("size", F.expr(f"cast(size({word_array()}) as bigint)")).withColumn("_tie", F.xxhash64("text"))
    # rows without an id are spread by their texts
    sized = (sized if texts else sized.drop("text")).withColumn("_g", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("_tie")).otherwise(F.xxhash64("doc_id", F.lit(7))), F.lit(groups)).cast("int"))
    sums = sized.groupBy("source", "_g").agg(F.sum("size").alias("n"))
    before = sums.select(F.col("source").alias("_s"), F.col("_g").alias("_h"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_g").orderBy(F.col("doc_id").asc_nulls_last(), "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(before, local["source"].eqNullSafe(before["_s"]) & (local["_g"] == before["_h"])).withColumn("first", F.col("_before") + F.col("_in")).drop("_s", "_h", "_g", "_before", "_in", "_tie")


def plan(sources: list[tuple[str | None, int]], block: int = BLOCK, **options) -> list[dict]:
    """Per source in order: source, i, size, blocks, target and slots."""
    seed = options.pop("seed", 0)
    order = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    goal = targets([n for _, n in order], **options)
    most = options.get("most", MOST)
    out = []
    for i, ((name, n), t) in enumerate(zip(order, goal, strict=True)):
        blocks = -(-n // block)
        slots = min(int(round(t * blocks / n)), int(most * blocks)) if n else 0
        out.append({"source": name, "i": i, "size": n, "blocks": blocks, "target": float(t), "slots": slots, "seed": seed})
    return out


def slot_blocks(spark, plans: list[dict], shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, slot, i, block): which block of source ``i`` fills each slot of each output shard."""
    wanted = [p["slots"] for p in plans]
    size = spark.createDataFrame([(p["i"], p["blocks"]) for p in plans], "_i int, blocks long")
    # a run of a source's slots in one row, of at most TASK_SLOTS; a fixed number of tasks, as a row does not show its length
    counts = draws(spark, wanted, shard_slots, seed).join(size, F.col("i") == F.col("_i")).drop("_i")
    pieces = counts.withColumn("p", F.explode(F.expr("sequence(0L, (n - 1) div 8192)"))).selectExpr("shard", "i", "blocks", "first + p * 8192 as lo", "least(first + n, first + (p + 1) * 8192) as hi")
    tasks = max(1, -(-sum(wanted) // TASK_SLOTS))
    slots = pieces.repartition(tasks, "shard", "i", "lo").select("shard", "i", "blocks", F.explode(F.expr("sequence(lo, hi - 1)")).alias("slot"))

    def run(batches):
        for batch in batches:
            i, blocks, slot = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "blocks", "slot"))
            # another key for each source and pass
            key = (i * 1_000_003 + slot // blocks * 7_919 + seed).astype(np.uint64)
            at = permute(slot % blocks, blocks, key)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(slot), batch.column("i"), pa.array(at)], ["shard", "slot", "i", "block"])

    return slots.mapInArrow(corpus.trimmed(run), "shard long, slot long, i int, block long")


def mixed(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0, texts: bool = True, **options) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(documents with size, first and i), (shard, slot, i, block), and the plan of each source."""
    spark = docs.sparkSession
    at = corpus.table(placed(docs, texts=texts), "placed")
    sizes = [(r["source"], r["n"]) for r in at.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    plans = plan(sizes, block, seed=seed, **options)
    names = spark.createDataFrame([(p["source"], p["i"], p["size"], p["target"]) for p in plans], "_s string, i int, source_size long, target double")
    at = at.join(names, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return at, slot_blocks(spark, plans, shard_slots, seed), plans


def overlaps(at: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block that a document's words reach: i, block, row, start (word in the document), n."""
    b = F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block")
    rows = at.where("size > 0").select("i", "row", "first", "size", b)
    lo, hi = F.greatest(F.col("first"), F.col("block") * block), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("i", "block", "row", (lo - F.col("first")).alias("start"), (hi - lo).alias("n"))


def _keyed(docs: DataFrame) -> DataFrame:
    """One key for each place in its source: it tells rows that share a doc_id apart and is the same in every run."""
    return docs.withColumn("row", F.struct("i", "first", "size"))


def mix_documents(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, and taken words, repeats counted."""
    at, slots, _ = mixed(docs.select("doc_id", "source", "text"), block, texts=False, **options)
    at = _keyed(at)
    # a few draws explode into all slots, which their size does not show: not to be broadcast
    uses = slots.groupBy("i", "block").agg(F.count("*").alias("uses"))
    taken = overlaps(at, block).join(uses.hint("merge"), ["i", "block"]).groupBy("row").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    out = at.join(taken.withColumnRenamed("row", "_row"), (F.col("row") == F.col("_row")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """The mix itself: shard, slot, source, block and the block's words, joined by a space."""
    at, slots, _ = mixed(docs.select("doc_id", "source", "text"), block, **options)
    keyed = _keyed(at)
    parts = overlaps(keyed, block).join(keyed.select("row", "source", "text"), "row")
    piece = F.expr(f"array_join(slice({word_array()}, cast(start + 1 as int), cast(n as int)), ' ')")
    blocks = parts.select("i", "block", "source", F.struct(F.col("row.first").alias("first"), piece.alias("words")).alias("piece"))
    whole = blocks.groupBy("i", "block", "source").agg(F.expr("array_join(transform(array_sort(collect_list(piece)), p -> p.words), ' ')").alias("text"))
    return slots.hint("merge").join(whole, ["i", "block"]).select("shard", "slot", "source", "block", "text")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words the mix takes of it: its chosen pieces in order, a second use after the first.

    A document taken whole and once keeps its text as it stands; one of which nothing is taken goes. Places and pieces
    go without texts, which meet them once, by id and a hash of the row; equal rows differ in their pieces alone.
    """
    names = docs.columns
    hashed = docs.withColumn("_row_hash", F.xxhash64(*names)).withColumn("_row_key", F.coalesce("doc_id", F.lit(0)))
    at, slots, _ = mixed(hashed.select("doc_id", "source", "text", "_row_hash", "_row_key"), texts=False)
    keyed = _keyed(at)
    uses = slots.groupBy("i", "block").agg(F.count("*").alias("uses"))
    pieces = overlaps(keyed, BLOCK).join(uses.hint("merge"), ["i", "block"]).groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("start", "n", "uses"))).alias("_pieces"))
    chosen = keyed.select("row", "size", "_row_key", "_row_hash").join(pieces, F.col("row") == F.col("_row")).select("_row_key", "_row_hash", "size", "_pieces")
    joined = hashed.dropDuplicates(["_row_key", "_row_hash"]).join(chosen.hint("merge"), ["_row_key", "_row_hash"])
    cut = lambda least: f"transform(filter(_pieces, p -> p.uses >= {least}), p -> array_join(slice(w, cast(p.start + 1 as int), cast(p.n as int)), ' '))"
    text = F.expr(f"transform(array({word_array()}), w -> array_join(concat({cut(1)}, {cut(2)}), ' '))[0]")
    once = F.expr("aggregate(_pieces, 0L, (a, p) -> a + p.n) = size and forall(_pieces, p -> p.uses = 1)")
    out = joined.withColumn("text", F.when(once, F.col("text")).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*names)
