"""The pipeline against a plain version of every stage, and the registry."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from shelfspark.llm import mixing, near_dedup, quality, token_store

from .helpers import SCHEMA, corpus, sentence, words
from .test_dedup import linked_at
from .test_operators import brute_hits, brute_quality


def shares(text):
    n, chars, symbols, dup, repeat = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"symbol_share": symbols / chars, "dup_line_share": dup / len(lines), "repeat_share": repeat / n, "word_length": chars / n, "word_chars": chars, "n_lines": len(lines), "n_words": n} if n else {}


def quantile(counts, q):
    """Of {bucket value: n}: as far up inside the bucket as the rank is among its members."""
    rank, upto = math.ceil(q * sum(counts.values())), 0
    for v in sorted(counts):
        upto += counts[v]
        if upto >= rank:
            upper = v * ((quality.GAMMA + 1) / 2)
            return upper / quality.GAMMA + (upper - upper / quality.GAMMA) * max(0.0, (rank - (upto - counts[v])) / counts[v])


def tails(values):
    """Per measure: q50, up and down."""

    def bucket(x):
        return 2 * quality.GAMMA ** math.ceil(math.log(x) / math.log(quality.GAMMA)) / (quality.GAMMA + 1) if x > 1e-9 else 0.0

    out = {}
    for k in (*quality.MEASURES, *quality.SIZES):
        counts, end = collections.Counter(bucket(s[k]) for s in values), quality.TAIL.get(k, 0.5)
        out[k] = quantile(counts, 0.5), quantile(counts, end), quantile(counts, 1 - end)
    return out


def fences(own, usual):
    out = {}
    for k in quality.MEASURES:
        q50, up, down = own[k]
        least = quality.UNIT[k][0] / own[quality.UNIT[k][1]][0] if k in quality.UNIT else quality.WORD_PART * q50
        rise, fall = 8 * (up - q50), 8 * (q50 - down)
        most_up, most_down = usual.get(k, (rise, fall))
        out[k] = q50 - max(min(fall, 2 * max(most_down, least)), least), q50 + max(min(rise, 2 * max(most_up, least)), least)
    return out


def kept_by_quality(rows):
    measured = {d[0]: shares(d[1]) for d in rows}
    good = {d[0] for d in rows if (m := brute_quality(d[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    groups = collections.defaultdict(list)
    for d in rows:
        if d[0] in good:
            for level in (("own", d[2], d[3]), ("lang", d[2]), ("all",)):
                groups[level].append(measured[d[0]])
    ends = {g: tails(v) for g, v in groups.items()}
    full = [ends[g] for g, v in groups.items() if g[0] == "own" and len(v) >= 50]
    middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    usual = {k: (middle([8 * (e[k][1] - e[k][0]) for e in full]), middle([8 * (e[k][0] - e[k][2]) for e in full])) for k in quality.MEASURES} if full else {}
    out = []
    for d in rows:
        if d[0] not in good:
            continue
        level = next(x for x in (("own", d[2], d[3]), ("lang", d[2]), ("all",)) if x == ("all",) or len(groups[x]) >= 50)
        limits = fences(ends[level], usual)
        if all(measured[d[0]][k] <= limits[k][1] and (not lower or measured[d[0]][k] >= limits[k][0]) for k, (_, lower) in quality.MEASURES.items()):
            out.append(d)
    return out


def mixed(rows):
    by = collections.defaultdict(list)
    for d in sorted(rows):
        by[d[3]].append(d)
    sizes = [(s, sum(len(words(d[1])) for d in ds)) for s, ds in by.items()]
    plans = mixing.plan(sizes)
    streams = {p["i"]: [(d[0], w) for d in by[p["source"]] for w in words(d[1])] for p in plans}
    uses = collections.Counter()
    for p in plans:  # whichever shards they are drawn for, a source's slots are all its first ones
        i, blocks = p["i"], p["blocks"]
        for slot in range(p["slots"]):
            key = i * 1_000_003 + slot // blocks * 7_919
            uses[i, int(mixing.permute(np.array([slot % blocks]), np.array([blocks]), np.array([key], np.uint64))[0])] += 1
    once, twice, count = collections.defaultdict(list), collections.defaultdict(list), collections.Counter()
    for i, stream in streams.items():
        for k, (doc, w) in enumerate(stream):
            n = uses[i, k // mixing.BLOCK]
            count[doc] += n
            if n:
                once[doc].append(w)
            if n > 1:
                twice[doc].append(w)
    out = []
    for d in rows:
        size = len(words(d[1]))
        if count[d[0]]:
            whole = count[d[0]] == size and len(once[d[0]]) == size
            out.append((d[0], d[1] if whole else " ".join(once[d[0]] + twice[d[0]])))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    r = random.Random(21)
    rows = corpus(20, 90)
    clean = [d[1] for d in rows if d[1] and len(words(d[1])) > 60]
    rows += [(5000, " ".join(w + "#$%" for w in sentence(r, 90).split()), "en", "hot", 0), (5001, "same line here\n" * 40, "en", "hot", 0)]
    items = [(1, clean[3][:200]), (2, sentence(r, 20)), (3, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{root}/benchmark.parquet")
    return f"file://{root}", rows, items


def test_run_equals_a_plain_version(spark, tables):
    root, rows, items = tables
    docs = kept_by_quality(rows)
    assert 0 < len(docs) < len(rows)
    groups = linked_at(docs, near_dedup.STAGE_PERCENT)
    docs = [d for d in docs if groups[d[0]] == d[0]]
    hits = brute_hits(docs, items)
    clean = [d for d in docs if not (hits[d[0]][1] and 20 * hits[d[0]][1] >= hits[d[0]][0])]
    assert len(clean) < len(docs)
    enc, at, want = token_store.Encoder(token_store.default_tokenizer()).tokenizer, 0, {}
    for doc, text in sorted(mixed(clean)):
        ids = [*enc.encode(text, add_special_tokens=False).ids, 2]
        want[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, root).collect()}
    assert got == want


def test_stages_return_the_columns_of_documents(spark, tables):
    root, _, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).columns == docs.columns


def test_pipeline_of_no_documents(spark, tables, tmp_path):
    root, _, _ = tables
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{root}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_registered_queries(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
