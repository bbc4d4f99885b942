from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import line_dedup as ld
from shelfspark.llm.cuckoo import CuckooFilter, filled

from .helpers import corpus, frame, lower


def brute(rows, min_chars=10):
    """(doc_id, n_lines, n_dropped, kept) of rows (doc_id, text, ...), sorted; rows without an id by their text."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    names = [("id", r[0]) if r[0] is not None else ("row", n) for n, r in enumerate(order)]
    held = collections.defaultdict(list)
    for name, r in zip(names, order, strict=True):
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= min_chars and name not in held[k]:
                held[k].append(name)
    out = []
    for name, r in zip(names, order, strict=True):
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(h := held.get(key(x), [])) < 2 or h[0] == name]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


def lines(seed=1, n=70):
    r = random.Random(seed)
    pool = [f"a shared line number {i} é" for i in range(25)] + ["short", "nine char", "ten chars.", "éééééééééé", "  ten chars. \r", "TEN CHARS.", "\tA Shared Line Number 3 é", "x" * 3000, "", " \x0b "]
    out = []
    for i in range(n):
        body = [r.choice(pool) if r.random() < 0.5 else f"own line {i} {j} of it" for j in range(r.randrange(0, 12))]
        out.append("\n".join(["the licence line of all"] * (i % 3 == 0) + body + [""] * (i % 4 == 0)))
    out += [None, "", "\n", "\n\n", "the licence line of all", "THE licence line of all\nthe licence line of all", "ten chars.\n" * 400 + "end of that one"]
    return [(i * 2 + 1, t, "en", "s", 0) for i, t in enumerate(out)]


@pytest.mark.parametrize("part_bytes", [1 << 23, 900])
def test_lines_equal_brute_force(spark, part_bytes):
    rows = lines() + [(i + 1000, *r[1:]) for i, r in enumerate(corpus(2, 20))]
    random.Random(5).shuffle(rows)
    assert got(ld.line_dedup(frame(spark, rows), part_bytes=part_bytes)) == brute(rows)


def test_rows_of_one_id_are_a_document(spark):
    rows = [(1, "the same line\nother text here", "", "", 0), (1, "the same line", "", "", 0), (2, "the same line", "", "", 0), (0, "zero", "", "", 0)]
    assert got(ld.line_dedup(frame(spark, rows))) == brute(rows)


def test_rows_without_an_id(spark):
    rows = [(None, f"one of the lines\nline {i % 3} of these", "", "", 0) for i in range(6)]
    for part_bytes in (1 << 23, 20):
        out = got(ld.line_dedup(frame(spark, rows), part_bytes=part_bytes))
        texts = [x for r in out for x in r[3].split("\n")]
        assert len(out) == 6 and all(texts.count(x) == 1 for x in ["one of the lines", "line 0 of these", "line 1 of these", "line 2 of these"])
    both = [*rows, (7, "one of the lines", "", "", 0)]
    out = got(ld.line_dedup(frame(spark, both), part_bytes=20))
    assert (7, 1, 0, "one of the lines") in out and sum("one of the lines" in r[3] for r in out) == 1
    assert ld.line_dedup(frame(spark, [])).count() == 0


def test_other_least_lengths(spark):
    rows = lines(9, 30)
    assert got(ld.line_dedup(frame(spark, rows), min_chars=1)) == brute(rows, 1)
    assert got(ld.line_dedup(frame(spark, rows), min_chars=24)) == brute(rows, 24)


def keys_of(index) -> set[int]:
    out = set()
    for r in index.refs.collect():
        out |= set(ld.textops.unpack_sorted(bytes(r["body"])).tolist())
    return out


def check(index, rows):
    """The result is that of the documents alone, and the filters hold each live key once and nothing else."""
    assert got(index.deduplicated()) == brute(rows)
    live, filters = keys_of(index), {r["bucket"]: CuckooFilter.load(bytes(r["body"])) for r in index.filters.collect()}
    assert sum(map(len, filters.values())) == len(live)
    every = np.array(sorted(live), np.uint64)
    at = ld.corpus.slices(every, index.buckets)
    assert all(filters[b].contains(every[at[b] : at[b + 1]]).all() for b in range(index.buckets) if at[b + 1] > at[b])


def test_insertions_and_deletions_are_reversible(spark):
    rows = lines(3, 60)
    first, second = rows[:40], rows[40:]
    index = ld.LineIndex.of(frame(spark, second), part_bytes=700, buckets=3)  # later ids first: insertion changes who is the first holder
    check(index, second)
    before = {r["bucket"]: bytes(r["body"]) for r in index.filters.collect()}
    both = index.insert(frame(spark, first))
    check(both, rows)
    gone = spark.createDataFrame([(r[0],) for r in first] + [(99999,)], "doc_id long")
    back = both.delete(gone)
    check(back, second)
    assert {r["bucket"] for r in back.filters.collect()} >= set(before)
    some = {r[0] for r in rows[::3]}
    check(both.delete(spark.createDataFrame([(i,) for i in some], "doc_id long")).compact(), [r for r in rows if r[0] not in some])
    empty = back.delete(frame(spark, second).select("doc_id"))
    assert empty.deduplicated().count() == 0 and sum(len(CuckooFilter.load(bytes(r["body"]))) for r in empty.filters.collect()) == 0


def test_filters_answer_alone(spark):
    index = ld.LineIndex.of(frame(spark, lines(4, 40)))
    asked = [(1, "the licence line of all\nshort", "", "", 0), (2, "nothing of this kind is there\n" * 2 + "the licence line of all", "", "", 0), (3, None, "", "", 0)]
    out = {r["doc_id"]: (r["n_keys"], r["n_seen"]) for r in index.maybe_held(frame(spark, asked)).collect()}
    assert out[1] == (1, 1) and out[2][0] == 2 and out[2][1] >= 1 and out[3] == (0, 0)


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**64, 200_000, dtype=np.uint64))
    f = filled(keys)
    assert f.contains(keys).all() and len(f) == len(keys)
    other = np.setdiff1d(r.integers(0, 2**64, 200_000, dtype=np.uint64), keys)
    assert f.contains(other).mean() < 0.001
    f.delete(keys[::2])
    assert f.contains(keys[1::2]).all() and len(f) == len(keys[1::2]) and f.contains(keys[::2]).mean() < 0.001
    assert CuckooFilter.load(f.dump()).contains(keys[1::2]).all()
    tight = CuckooFilter(10)
    assert not tight.insert(keys[:1000])


@pytest.mark.parametrize("bits", [4, 7])
def test_false_positives_of_the_filter_change_nothing(spark, monkeypatch, bits):
    """With fingerprints of a few bits most new keys seem to be seen; the counts put that right."""
    plain = CuckooFilter._places

    def few(self, keys):
        prints, at = plain(self, keys)
        return (prints & np.uint16((1 << bits) - 1)) | np.uint16(1), at

    monkeypatch.setattr(CuckooFilter, "_places", few)
    r = np.random.default_rng(bits)
    pool = np.unique(r.integers(0, 2**64, 4000, dtype=np.uint64))
    counts = object.__new__(ld._Counts)
    counts.keys = [np.unique(r.choice(pool, 300)) for _ in range(30)]
    monkeypatch.setattr(ld, "STEP", 500)
    suspects, seen = ld.through_filter(counts, list(range(30)), None)
    times = collections.Counter(np.concatenate(counts.keys).tolist())
    assert {k for k, n in times.items() if n > 1} <= set(suspects.tolist())
    assert len(seen) == len(times) and seen.contains(np.array(sorted(times), np.uint64)).all()


def test_query_drops_as_the_contract_says(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(ld.line_dedup(docs)) == brute([tuple(r) for r in docs.collect()])
    assert re.fullmatch("[0-9a-f]{64}", ld.query(spark, sf_dir).select(F.max("kept_sha256")).first()[0])
