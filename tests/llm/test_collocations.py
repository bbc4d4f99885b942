from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from shelfspark.llm import collocations as co
from shelfspark.llm import textops
from shelfspark.llm.mphf import PerfectHash, tree_sum

from .helpers import frame, lower


def brute(rows, min_count=10, percent=50, top=2000, max_words=3):
    """Sorted rows of the operator's columns for rows (doc_id, text, lang, ...)."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    out = collections.defaultdict(list)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    for (lang, p), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = [b for (x, q), b in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= percent * a for b in longer):
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed=1, n=120):
    r = random.Random(seed)
    names = ["New York City", "à la carte", "ad hoc", "of the", "in the middle of", "Ünïted Nations"]
    out = []
    for i in range(n):
        words = []
        while len(words) < r.randint(20, 90):
            words += r.choice(names).split() if r.random() < 0.4 else [f"w{min(r.randrange(30), r.randrange(30))}"]
            words[-1] += r.choice(["", "", "", "", ".", ",", "!", ";\n", "\t"])
        out.append((i, r.choice([" ", "  ", "\t "]).join(words), r.choice(["en", "en", "fr", None]), "s", 0))
    out += [(n, None, "en", "s", 0), (n + 1, "", "fr", "s", 0), (n + 2, " .,;:!?\n\t", None, "s", 0), (n + 3, "one", "und", "s", 0), (n + 4, "and and " * 300, "und", "s", 0)]
    out += [(n + 5, "x y " * 40 + "z" * 3000, "e n\nx", "s", 0), (n + 6, "x\x00y x\x00y " * 40, "", "s", 0), (None, "of the of the", "en", "s", 0), (None, "of the", "en", "s", 0), (3, out[3][1], out[3][2], "s", 0)]
    return out


@pytest.mark.parametrize("part_bytes", [1 << 23, 1500])
def test_phrases_equal_brute_force(spark, part_bytes):
    rows = made()
    want = brute(rows)
    assert len({r[0] for r in want}) == 5 and any(" " in r[2] and len(r[2].split()) == 3 for r in want)
    assert got(co.collocations(frame(spark, rows), part_bytes=part_bytes)) == want


@pytest.mark.parametrize("options", [{"min_count": 2, "percent": 80, "top": 7}, {"max_words": 2}, {"min_count": 1, "top": 40}])
def test_other_parameters(spark, options):
    rows = made(2, 40)
    assert got(co.collocations(frame(spark, rows), part_bytes=900, **options)) == brute(rows, **options)


def test_nothing_to_find(spark):
    assert co.collocations(frame(spark, [])).count() == 0
    assert co.collocations(frame(spark, [(1, None, None, None, 0), (2, "a b c", "en", "s", 0)])).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    counts = [(99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (3_333_333_333_333, 12_345_678_901_234, 98_765_432_109_876), (10, 99_999_999_999_999, 99_999_999_999_999)]
    df = spark.createDataFrame(counts, "a long, l long, r long").select("a", "l", "r", co._score("a", "l", "r").alias("s"))
    assert all(r["s"] == 1000000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_perfect_hash_is_minimal_and_verifies():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 100_000):
        keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        h = PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        other = np.setdiff1d(r.integers(0, 2**64, 1000, dtype=np.uint64), keys)
        assert (h.slots(other) == -1).all()
    runs = PerfectHash(np.arange(5000, dtype=np.uint64) << np.uint64(30))
    assert sorted(runs.slots(runs.keys).tolist()) == list(range(5000))


def test_keys_that_no_level_takes(monkeypatch):
    monkeypatch.setattr("shelfspark.llm.mphf.LEVELS", 1)
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64, 3000, dtype=np.uint64))
    h = PerfectHash(keys)
    assert len(h.rest) > 100 and sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.slots(keys + np.uint64(1)) == -1).all()


def test_counts_by_slot():
    r = np.random.default_rng(3)
    lists = [np.unique(r.integers(0, 500, 200, dtype=np.uint64)) for _ in range(21)]
    weights = [r.integers(1, 9, len(x)) for x in lists]
    want = collections.Counter()
    for x, w in zip(lists, weights, strict=True):
        want.update(dict(zip(x.tolist(), w.tolist(), strict=True)))
    hashed, total = co.slot_counts(lists, weights)
    assert dict(zip(hashed.keys.tolist(), total.tolist(), strict=True)) == want
    assert tree_sum([np.full(3, i) for i in range(11)]).tolist() == [55] * 3
    values = r.integers(0, 2**64, 1000, dtype=np.uint64)
    assert (textops.unmix(textops.mix(values)) == values).all()


def test_too_many_words_are_refused():
    with pytest.raises(OverflowError):
        co._frequent(np.full(5, 20), 10, 3, 4, 4, "words")
