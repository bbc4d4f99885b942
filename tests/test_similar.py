from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import similar


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy(hint, title):
    d, size = levenshtein(hint, title), lambda s: len(s.encode())
    return min(d, (size(title) - size(hint)) // 8 + 1) if size(hint) >= 4 and hint in title else d


def frame(spark, titles, key="id"):
    return spark.createDataFrame(list(enumerate(titles)), f"{key} long, title string").repartition(3)


def made(seed, n=90):
    r = random.Random(seed)
    words = ["history", "of", "the", "sea", "dragon", "a", "an", "księga", "été", "book", "one", "日本", "ö"]
    out = []
    for _ in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
        out.append(t)
        for _ in range(2):
            s = list(t)
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(s) + 1)
                s[i : i + r.randint(0, 1)] = [r.choice(["x", "e", ""])]
            out.append("".join(s))
        out.append(r.choice(["", "a ", "volume one "]) + t + r.choice(["", ": part", ", the long one", " - unabridged edition"]))
    return [*out, "", None, "a", "ab", "日本", "日", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "aaaabaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabc", "bcabcabcabcabcabca", "x" * 3000, "x" * 2999 + "y"]


@pytest.mark.parametrize("most, seed", [(2, 1), (2, 2), (1, 3), (3, 4), (0, 5)])
def test_pairs_equal_brute_force(spark, most, seed):
    titles = made(seed)
    distinct = sorted({t for t in titles if t})
    cheap = lambda a, b: abs(len(a) - len(b)) <= most and len(a) < 100 or a in b or a[:9] == b[:9] == "x" * 9
    want = {(a, b, d) for a in distinct for b in distinct if cheap(a, b) and (d := fuzzy(a, b) if len(a) < 100 else 0 if a == b else 1) <= most}
    got = similar.fuzzy_join(frame(spark, titles), frame(spark, titles), most).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want


def test_lists_of_common_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(similar, "SLICE", 3)
    titles = made(7, 30)
    got = {tuple(r) for r in similar.fuzzy_join(frame(spark, titles), frame(spark, titles)).collect()}
    distinct = {t for t in titles if t and len(t) < 100}
    assert {p for p in got if len(p[0]) < 100} == {(a, b, d) for a in distinct for b in distinct if (d := fuzzy(a, b)) <= 2}
    plan = similar.fuzzy_join(frame(spark, titles), frame(spark, titles))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= plan.count("counts#")


def test_candidates_of_copies_are_not_expanded(spark):
    titles = ["The Sea Dragon"] * 60 + ["the séa dragon"] * 3 + ["The Sea Dragons", "Sea Dragon", "other"]
    hints = frame(spark, titles, "q_id")
    got = {}
    for r in similar.text_candidates(hints, frame(spark, titles, "c_id"), limit=5, same=True).collect():
        got.setdefault(r["q_id"], []).append((r["pos"], r["text_distance"], r["c_id"]))
    assert sorted(got[0]) == [(i, 0, i + 1) for i in range(5)] and sorted(got[2]) == [(0, 0, 0), (1, 0, 1), (2, 0, 3), (3, 0, 4), (4, 0, 5)]
    assert sorted(got[63])[0] == (0, 1, 0) and 65 not in got
    every = similar.text_candidates(hints, frame(spark, titles, "c_id"), limit=5).where("q_id = 65").collect()
    assert [(r["c_id"], r["pos"]) for r in every] == [(65, 0)]


def test_no_titles(spark):
    assert similar.fuzzy_join(frame(spark, []), frame(spark, [None, ""])).count() == 0


def test_only_pairs_that_nearly_match_go_on(spark, monkeypatch):
    r = random.Random(9)
    words = ["inanin", "thread", "eaniere", "oublent", "thashed", "leanere"]
    titles = [" ".join(r.choice(words) for _ in range(9)) for _ in range(400)]
    titles += [t + "s" for t in titles[:50]]
    seen, met = [], similar._met
    monkeypatch.setattr(similar, "_met", lambda *a: seen.append(met(*a)) or seen[-1])
    found = similar.fuzzy_join(frame(spark, titles), frame(spark, titles)).count()
    assert found >= 500 and sum(df.distinct().count() for df in seen) <= 3 * found


def test_a_piece_of_many_titles_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(similar, "SLICE", 2)
    monkeypatch.setattr(similar, "COUNTED", 1)
    titles = [f"a very long opening of a title, number {i}" for i in range(60)]
    got = {tuple(r) for r in similar.fuzzy_join(frame(spark, titles), frame(spark, titles)).collect()}
    assert got == {(a, b, d) for a in titles for b in titles if (d := fuzzy(a, b)) <= 2}


def test_hints_of_one_title_are_dealt_out(spark, monkeypatch):
    titles = ["The Sea Dragon"] * 40 + ["the séa dragon"] * 3 + ["The Sea Dragons", "other", "", None]
    hints, listed = frame(spark, titles, "q_id").withColumn("of_hint", F.col("q_id") + 100), frame(spark, titles, "c_id").withColumn("of_row", F.col("c_id") + 200)
    rows = lambda: similar.text_candidates(hints, listed, limit=5, same=True).collect()
    plain = rows()
    monkeypatch.setattr(similar, "SLICE", 4)
    monkeypatch.setattr(similar, "COUNTED", 1)
    dealt = rows()
    told = lambda some: sorted((r["q_id"], r["of_hint"], r["c_id"], r["of_row"], r["pos"], r["text_distance"]) for r in some)
    assert told(dealt) == told(plain) and len(plain) == 44 * 5
    assert all(r["of_hint"] == r["q_id"] + 100 and r["of_row"] == r["c_id"] + 200 for r in plain)
    assert len({r["dealt"] for r in plain}) == 2 < len({r["dealt"] for r in dealt})
