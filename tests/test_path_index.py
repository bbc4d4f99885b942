from __future__ import annotations

import random

import pytest

from shelfspark.operators import path_index, paths


@pytest.fixture(scope="module")
def entries(spark):
    r = random.Random(1)
    words = ["Dragon", "sea", "Été", "CD 1", "Book 02", "@eaDir", "the", "of", "xy", "日本語の本", "a"]
    rows = []
    for i in range(300):
        path = "/".join(" ".join(r.choice(words) for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 4))) + f" {i}"
        rows.append((path + r.choice(["", ".m4b", ".mp3", ".M4B"]), r.random() < 0.3, i))
    return spark.createDataFrame(rows, "rel_path string, is_dir boolean, size long").repartition(3)


@pytest.fixture(scope="module")
def index(spark, entries, tmp_path_factory):
    return path_index.build(entries, f"file://{tmp_path_factory.mktemp('index')}/i", block=50, folders=7)


QUERIES = ["dragon", "DRAGON sea", "été", "book 02 dragon", "日本語", "xy", "a", "no such thing", "", "  ", "dragon xy", "cd 1 été the", "m4b", "sea sea", "dragon/sea"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_the_scan(index, entries, query):
    got, want = path_index.search(index, query, 20), paths.search(entries, query, 20)
    assert sorted(map(tuple, got.select("rel_path", "place", "total").collect())) == sorted(map(tuple, want.select("rel_path", "place", "total").collect()))


@pytest.mark.parametrize("lists", [1, 2, 8])
def test_many_searches_equal_scans(spark, index, entries, lists):
    rows = [r["rel_path"] for r in entries.collect()]
    want = sorted((q, p) for q in set(QUERIES) for p in rows if q.split() and all(t in p.lower() for t in q.lower().split()))
    got = path_index.search_many(index, spark.createDataFrame([(q,) for q in [*QUERIES, None, "xy"]], "query string"), lists)
    assert sorted((r["query"], r["rel_path"]) for r in got.collect()) == want


def test_only_the_lists_asked_for_are_read(index):
    plan = path_index.candidates(index, "dragon")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [dra,rag,ago,gon])]" in plan or "In(gram" in plan
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters")[1]
    read = {f.split("folder=")[1].split("/")[0] for f in path_index.asked(index, ["dra"]).inputFiles()}
    every = {f.split("folder=")[1].split("/")[0] for f in index.lists.inputFiles()}
    assert len(every) > 1 and path_index.asked(index, ["dra"]).select("folder").distinct().count() == 1 and read <= every


def test_lists_are_cut_by_blocks(index):
    assert index.lists.selectExpr("max(n)").first()[0] <= 50
    assert index.entries.selectExpr("count(distinct block)").first()[0] >= 6
    order = [r["rel_path"] for r in index.entries.orderBy("entry").collect()]
    assert order == sorted(order, key=lambda p: p.split("/"))


def test_no_entries(spark, entries, tmp_path):
    none = path_index.build(entries.where("false"), f"file://{tmp_path}/none")
    assert none.entries.count() == 0 and path_index.search(none, "dragon").count() == 0


def test_many_searches_broadcast_one_row_only(spark, index):
    queries = spark.createDataFrame([(q,) for q in QUERIES], "query string").repartition(2)
    plan = path_index.search_many(index, queries)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") == plan.count("BroadcastNestedLoopJoin") == 1
