from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import block_dedup, graph, near_dedup, suffix_dedup

from .helpers import corpus, frame, lower, sentence, words


def cut_windows(docs, items, size, join):
    """(removed, spans, what is left) of each document, judged on the input."""
    seen, out = set(), []
    for d in docs:
        x = items(d)
        gone = [False] * len(x)
        for i in range(len(x) - size + 1):
            key = x[i : i + size] if isinstance(x, bytes) else tuple(x[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            else:
                seen.add(key)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, join([y for y, g in zip(x, gone, strict=True) if not g])))
    return out


@pytest.mark.parametrize("window", [20, 5])
def test_block_dedup_equals_brute_force(spark, window):
    rows = corpus(2)
    want = cut_windows(sorted(rows), lambda d: words(d[1]), window, " ".join)
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_text) for r in block_dedup.block_dedup(frame(spark, rows), window, part_bytes=3000).collect()}
    assert [got[d[0]] for d in sorted(rows)] == want


@pytest.mark.parametrize(("length", "gram", "part"), [(100, 48, 4000), (20, 8, 900), (7, 7, 2000)])
def test_suffix_dedup_equals_brute_force(spark, length, gram, part):
    rows = corpus(3, 30)
    want = cut_windows(sorted(rows), lambda d: (d[1] or "").encode(), length, bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, rows), length, gram, part).collect()}
    assert [got[d[0]] for d in sorted(rows)] == want


@pytest.mark.parametrize(("length", "gram", "part"), [(100, 48, 4000), (20, 8, 900), (7, 7, 2000), (9, 4, 1500)])
def test_hot_grams_by_pieces_equal_brute_force(spark, length, gram, part):
    """With every repeated gram hot, all windows are dealt by what surrounds them."""
    r = random.Random(8)
    line = "This line of the licence stands in every text, whatever may surround it here."
    rows = corpus(4, 20) + [(i + 500, sentence(r, 4) + "\n" + line + "\n" + sentence(r, 4) + ("\n" + line + line) * (i % 3 == 0), None, None, 0) for i in range(25)]
    want = cut_windows(sorted(rows), lambda d: (d[1] or "").encode(), length, bytes)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.suffix_dedup(frame(spark, rows), length, gram, part, hot=1).collect()}
    assert [got[d[0]] for d in sorted(rows)] == want


def test_a_line_in_unlike_surroundings_is_spread(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line = "Licensed under the terms of the common licence, version 2; see the file there."
    docs = spark.createDataFrame([(i, noise(300) + line + noise(300)) for i in range(3000)], "doc_id long, text string")
    split, parts = suffix_dedup.corpus.parted(docs, 64 << 10)
    loads = {}
    for hot in (1 << 30, suffix_dedup.HOT):
        _, runs = suffix_dedup.sorted_runs(split, 64, hot=hot)
        sizes = {}
        for x in runs.select("bucket", "body").collect():
            sizes[x["bucket"]] = sizes.get(x["bucket"], 0) + int.from_bytes(bytes(x["body"])[:4], "little")
        loads[hot] = sorted([0] * (64 - len(sizes)) + list(sizes.values()))
    plain, spread = loads[1 << 30], loads[suffix_dedup.HOT]
    assert plain[-1] >= 2500 and spread[-1] <= 2 * spread[32]


def test_repeated_and_null_ids(spark):
    text = sentence(random.Random(4), 40)
    rows = [(1, text), (1, text), (None, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (block_dedup.block_dedup(df), suffix_dedup.suffix_dedup(df)):
        assert sorted((r.doc_id is None, r.n_removed > 0) for r in out.collect()) == [(False, False), (False, True), (True, False), (True, True)]
    near = near_dedup.near_duplicates(df).collect()
    # rows of one id are one node; a null id is a row of its own, linked with nothing, whatever its text
    assert sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near), key=repr) == [(0, 0, None, True), (0, 36, None, True), (1, 36, 1, True), (1, 36, 1, True)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert block_dedup.block_dedup(df).count() == 0
    assert suffix_dedup.suffix_dedup(df).count() == 0
    assert near_dedup.near_duplicates(df).count() == 0


def test_stored_tables_go_once_a_pipeline_stage_is_stored(spark):
    from shelfspark.llm import corpus as store

    mark = store.stored()
    a, b, c = (store.table(spark.range(n), f"t{n}") for n in (1, 2, 3))
    store.drop(b)
    store.sweep(spark, mark)
    assert store.stored() == mark + 1 and c.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(a.inputFiles()[0].rsplit("/", 1)[0]).count()
    store.sweep(spark, mark, keep=0)


def test_messages_grow_in_proportion_to_large_inputs():
    from shelfspark.llm import corpus as store

    messages = lambda total: 2 * store.exchange_parts(total) ** 2
    assert store.exchange_parts(1 << 30) == 128 and store.exchange_parts(16 << 30) == 2048
    assert store.exchange_parts(0) == 1
    for total in (32 << 30, 1 << 40, 100 << 40):
        assert messages(total) / total == pytest.approx(messages(16 << 30) / (16 << 30), rel=0.01)
    assert (100 << 40) / store.exchange_parts(100 << 40) < 1 << 30


def test_merge_of_runs():
    r = random.Random(5)
    for _ in range(200):
        runs = []
        for _ in range(r.randint(0, 9)):
            s = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 24))) for _ in range(r.randint(0, 12))})
            runs.append(suffix_dedup.read_run(suffix_dedup.write_run(s)) if s else ([], []))
        which, place, shared = suffix_dedup.merge_runs(runs) if runs else ([], [], [])
        out = [runs[a][0][b] for a, b in zip(which, place, strict=True)]
        assert out == sorted(x for run in runs for x in run[0])
        assert shared[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:], strict=False)]


def shingles(text):
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = {d[0]: shingles(d[1]) for d in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def copies(seed, n, edits):
    """Independently edited copies of one text: some link to the base alone, some to each other, some to none."""
    r = random.Random(seed)
    base = sentence(r, 220, 5000).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("block", "rare", "each"), [(8192, 16, 16), (16, 2, 1), (64, 1, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, rare, each):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(near_dedup, "RARE", rare)
    monkeypatch.setattr(near_dedup, "FIRST_EACH", each)
    rows = corpus(6)
    texts = copies(7, 120, 6) + copies(8, 40, 10)
    rows += [(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    want = linked(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_templates_of_common_lines_link_as_brute_force_says(spark, monkeypatch):
    """Documents made of a common pool of lines: no shingle is rare, and similarities lie around the threshold."""
    monkeypatch.setattr(near_dedup, "RARE", 3)
    r = random.Random(41)
    pool = [sentence(r, 12, 10**6) for _ in range(24)]
    rows = [(i, "\n".join(x for x in pool if r.random() < 0.9), "en", "s", 0) for i in range(90)]
    want = linked(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_odd_sketch_estimates():
    r = np.random.default_rng(1)
    for j in (0.85, 0.95):
        n = 1000
        both = int(round(2 * n * j / (1 + j)))
        pool = r.integers(0, 2**63, 3 * n).astype(np.uint64)
        a, b = pool[:n], np.concatenate([pool[n - both : n], pool[n : 2 * n - both]])
        s = near_dedup.odd_sketches(near_dedup.minhash(np.concatenate([a, b]), np.array([0, n])))
        bits = np.bitwise_count(s[0] ^ s[1]).sum()
        assert abs(near_dedup.estimate(np.array([bits]))[0] - j) < 0.1
        assert bits <= near_dedup.MOST_BITS


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_kept_text_has_a_stable_digest(spark):
    rows = corpus(9, 10)
    out = block_dedup.block_dedup(frame(spark, rows)).withColumn("h", F.sha2("kept_text", 256)).collect()
    assert all(r.h == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in out)


def linked_at(rows, percent):
    sets = {d[0]: shingles(d[1]) for d in rows}
    ids, root = sorted(sets), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def edited(seed, percents):
    """A text and copies of it at about those similarities."""
    r = random.Random(seed)
    out = []
    for i, p in enumerate(percents):
        base = [f"b{i}x{k}" for k in range(200)]
        copy = list(base)
        for k in range(round(196 * (1 - p / 100) / (1 + p / 100) / 5)):
            copy[10 * k + 5] = f"e{r.randrange(10**9)}"
        out += [" ".join(base), " ".join(copy)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(out)]


def test_stage_drops_near_copies_from_80_percent(spark):
    rows = edited(31, [82] * 10 + [75] * 3)
    want = {i for i, c in linked_at(rows, 80).items() if i == c}
    at_85 = {i for i, c in linked_at(rows, 85).items() if i == c}
    assert len(want) < len(at_85)
    assert {r.doc_id for r in near_dedup.stage(spark, frame(spark, rows), "").collect()} == want


@pytest.mark.parametrize("percent", [50, 70, 80])
def test_bands_and_sift_follow_the_percent(spark, percent):
    rows = edited(32, [percent + 2] * 40 + [max(1, percent - 6)] * 5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), percent=percent).collect()}
    assert got == linked_at(rows, percent)
    count, each = near_dedup.banding(percent)
    assert (1 - (percent / 100) ** each) ** count <= near_dedup.MISS


def test_a_percent_the_samples_cannot_serve_is_refused():
    assert near_dedup.banding(85) == (32, 4)
    for percent in (0, 3, 101):
        with pytest.raises(ValueError):
            near_dedup.banding(percent)
