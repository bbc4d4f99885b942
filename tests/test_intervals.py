from __future__ import annotations

import random

import pytest

from shelfspark.operators import intervals
from shelfspark.sources import pages

LEFT, RIGHT = "book long, a_id long, a long, b long", "book long, b_id long, x long, y long"


def made(seed, longest, n=120):
    r = random.Random(seed)

    def spans():
        out = []
        for i in range(n):
            at = r.randrange(0, 5 * longest)
            out.append((r.choice([1, 1, 1, 2, None]), i, at, at + r.choice([0, 1, 2, r.randrange(1, longest), longest, -3])))
        return out

    return spans(), spans()


def brute(left, right):
    return sorted((k, i, j, min(b, y) - max(a, x)) for k, i, a, b in left for m, j, x, y in right if k is not None and k == m and a < b and x < y and a < y and x < b)


@pytest.mark.parametrize("seed, longest", [(1, 50), (2, 5_000), (3, 400_000), (4, 3 * 10**9), (5, 10**15)])
def test_overlaps_equal_brute_force(spark, seed, longest):
    left, right = made(seed, longest)
    df = intervals.overlapping(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["book"], ("a", "b"), ("x", "y"))
    assert sorted((r["book"], r["a_id"], r["b_id"], r["overlap"]) for r in df.collect()) == brute(left, right)
    best = {}
    for k, i, j, n in brute(left, right):
        key = (-n, right[j][2], j)
        best[k, i] = min(best.get((k, i), key), key)
    near = intervals.nearest_span(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["book"], "a_id", "b_id", ("a", "b"), ("x", "y"))
    assert {(r["book"], r["a_id"]): (-r["overlap"], r["b_id"]) for r in near.collect()} == {k: (n, j) for k, (n, _, j) in best.items()}


def test_a_long_span_takes_few_rows(spark):
    one = spark.createDataFrame([(1, 1, 7, 7 + 10**12)], LEFT)
    assert intervals._binned(one, "a", "b", "_l").count() <= 2 * intervals.LEVELS


def test_nothing_overlaps(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([(1, 1, 0, 5)], RIGHT)
    assert intervals.overlapping(left, right, ["book"], ("a", "b"), ("x", "y")).count() == 0


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [(i, r.randrange(300), f"s{i % 5}") for i in range(1000)]
    table = pages.write_pages(spark.createDataFrame(rows, "id long, at long, status string").repartition(4), f"file://{tmp_path_factory.mktemp('pages')}/p", ("at", "id"), 90)
    return table, sorted(rows, key=lambda r: (-r[1], -r[0]))


@pytest.mark.parametrize("number, size", [(1, 10), (3, 50), (10, 100), (11, 100), (4, 333), (1, 5000), (50, 20), (51, 20)])
def test_pages_by_number(laid, number, size):
    table, want = laid
    assert [tuple(r) for r in table.page(number, size).collect()] == want[(number - 1) * size : number * size]


@pytest.mark.parametrize("place, size", [(0, 10), (89, 10), (500, 100), (990, 50), (999, 5)])
def test_pages_after_a_key(laid, place, size):
    table, want = laid
    got = table.after((want[place][1], want[place][0]), size).collect()
    assert [tuple(r) for r in got] == want[place + 1 : place + 1 + size]


def test_a_deep_page_reads_few_files(laid):
    table, _ = laid
    assert table.count() == 1000 and table._files().count() >= 8
    assert max(len(table.page(n, 40).inputFiles()) for n in (1, 12, 20, 25)) <= 2
    assert len(table.after((150, 5), 40).inputFiles()) <= 2


def test_no_rows(spark, tmp_path):
    none = pages.write_pages(spark.createDataFrame([], "id long, at long, status string"), f"file://{tmp_path}/p", ("at", "id"))
    assert none.count() == 0 and none.page(1, 5).count() == 0 and none.after((1, 1), 5).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_laid_spans_equal_the_general_join(spark, seed):
    r = random.Random(seed)
    sides = []
    for _ in range(2):
        at, side = {}, []
        for i in range(150):
            k = r.choice([1, 1, 2, None])
            start = at.get(k, 0) + r.choice([0, 0, 0, 3, 400])
            at[k] = start + r.choice([0, 1, 5, 5, 100, 5000])
            side.append((k, i, start, at[k]))
        sides.append(side)
    left, right = sides
    want = intervals.nearest_span(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["book"], "a_id", "b_id", ("a", "b"), ("x", "y"))
    both = spark.createDataFrame([(k, side is left, i, a, b) for side in sides for k, i, a, b in side], "book long, left boolean, id long, start long, end long").repartition(3)
    laid = intervals.nearest_laid(both, ["book"], "a_id", "b_id")
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_spans_that_overlap_their_own_side_are_refused(spark):
    both = spark.createDataFrame([(1, True, 1, 0, 9), (1, True, 2, 8, 12), (1, False, 1, 0, 20)], "book long, left boolean, id long, start long, end long")
    with pytest.raises(Exception, match="spans of one side overlap"):
        intervals.nearest_laid(both, ["book"], "a_id", "b_id").collect()


def test_lines_are_dealt_by_book_once(spark, sf_dir):
    from shelfspark.plans import timeline

    plan = timeline.span_match(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
