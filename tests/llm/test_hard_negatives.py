from __future__ import annotations

import math
import random

import numpy as np
import pytest

from shelfspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, part string, n int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """Anchors are told apart by (id, label, vector); returns sorted rows of the operator's columns."""
    fine = [(i, tuple(math.floor(256 * x) for x in v), b) for i, v, b in rows if b is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, v, b in sorted({x for x in fine if x[0] is not None and x[0] % 100 == 0}):
        best = sorted(((score(v, w), j) for j, w, c in fine if c == b and j != i), key=order)[:positives]
        for rank, (s, j) in enumerate(best, 1):
            window = sorted(((t, k) for t, k in ((score(v, w), k) for k, w, c in fine if c != b) if low * s <= 100 * t <= high * s), key=order)[:negatives]
            out += [(i, j, n, k, s, t, rank) for n, (t, k) in enumerate(window, 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, n=230, d=7):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, 0.4))) for _ in range(d)], r.randrange(3)) for i in range(n)]
    hot = rows[0][1]
    rows += [(500 + i, hot, 0 if i % 2 else 1) for i in range(40)]  # one vector many times: ties by id
    rows += [(700, hot, 2)] * 15 + [(300, rows[5][1], 1)] * 3  # repeated rows
    rows += [(800, None, 1), (801, hot, None), (802, [None, *hot[1:]], 1), (803, [float("nan"), *hot[1:]], 1), (804, [float("inf"), *hot[1:]], 1), (None, hot, 1), (None, hot, 2), (900, [], 1), (901, hot[:3], 0)]
    return rows


@pytest.mark.parametrize("tile", [(256, 4096, 32), (2, 40, 3), (1, 7, 1)])
def test_lists_equal_brute_force(spark, tile):
    rows = made(3)
    assert got(hn.hard_negatives(frame(spark, rows), tile=tile)) == brute(rows)


def test_other_sizes_and_few_rows(spark):
    rows = made(4, 30, 2)
    assert got(hn.hard_negatives(frame(spark, rows), positives=2, negatives=3, low=-50, high=120, tile=(3, 11, 2))) == brute(rows, 2, 3, -50, 120)
    assert hn.hard_negatives(frame(spark, [])).count() == 0
    assert hn.hard_negatives(frame(spark, [(100, [1.0], 0)])).count() == 0


def test_large_components_are_exact_or_refused(spark):
    big = hn.limit(2) // 256
    rows = [(100, [float(big), -float(big)], 0), (1, [float(big), 1.0], 0), (2, [float(big) / 2, 3.0], 1)]
    rows = [(i, [float(np.float32(x)) if abs(x) < 1e5 else x for x in v], b) for i, v, b in rows]
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(hn.hard_negatives(doubles)) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        hn.hard_negatives(spark.createDataFrame([(100, [1e30], 0), (1, [1.0], 0)], "vec_id long, embedding array<double>, label int")).collect()


def test_products_past_doubles_are_exact():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**28), 2**28, (5, 40)), r.integers(-(2**28), 2**28, (6, 40))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert hn.product(a, b).tolist() == want


def test_tiles_are_multiplied_by_panels_without_a_cross_join(spark):
    plan = hn.hard_negatives(frame(spark, made(5)), tile=(2, 40, 3))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
