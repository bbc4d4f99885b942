from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import settings
from shelfspark.sources.store import Store

T = [datetime.datetime(2024, 1, 1, h) for h in range(6)]
WANTED = "id long, kind string, path string, options string, created_at timestamp"
MOVED = "id long, status string, at timestamp, error string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", 4)


def test_jobs_are_added_once_and_move_as_they_may(spark, store):
    add = lambda *rows: store.add(spark.createDataFrame(rows, WANTED))
    move = lambda *rows: store.move(spark.createDataFrame(rows, MOVED))
    state = lambda: {r["id"]: (r["status"], r["started_at"], r["finished_at"], r["error"]) for r in store.jobs.read().collect()}
    add((1, "retag", "a", "{}", T[0]), (2, "retag", "a", "{}", T[1]), (3, "sort", "a", "{}", T[0]))
    assert {k: v[0] for k, v in state().items()} == {1: "pending", 3: "pending"}
    add((4, "retag", "a", "{}", T[2]), (1, "sort", "z", "{}", T[2]))  # an active job of that path; a known id
    assert set(state()) == {1, 3}
    for _ in range(2):
        move((1, "running", T[1], None), (3, "done", T[1], None), (9, "running", T[1], None))
        assert state() == {1: ("running", T[1], None, None), 3: ("pending", None, None, None)}
    move((1, "error", T[2], "no space"), (1, "done", T[3], None))  # the first counts
    assert state()[1] == ("error", T[1], T[2], "no space")
    add((5, "retag", "a", "{}", T[4]))  # the old one has ended
    assert state()[5][0] == "pending"
    move((1, "running", T[5], None), (5, "cancelled", T[5], None))
    assert state()[1][0] == "error" and state()[5] == ("cancelled", None, T[5], None)


def test_answers_keep_what_others_gave(spark, store):
    schema = "asin string, region string, book string, chapters string, fetched_at timestamp"
    store.remember(spark.createDataFrame([("A", "us", "b", None, T[0]), (None, "us", "x", None, T[0])], schema))
    store.remember(spark.createDataFrame([("A", "us", None, "c", T[1]), ("A", "de", "d", None, T[1])], schema))
    assert sorted(tuple(r) for r in store.cache.read().select("asin", "region", "book", "chapters").collect()) == [("A", "de", "d", None), ("A", "us", "b", "c")]


def test_settings_are_saved_whole_or_not_at_all(spark, store):
    row = store.load_settings()
    assert row.count() == 1
    valid = settings.typed(spark.createDataFrame([], "key string, value string"))
    store.save_settings(valid)
    number = next(k for k, v in settings.DEFAULTS.items() if isinstance(v, int) and not isinstance(v, bool))
    with pytest.raises(ValueError, match="invalid settings"):
        store.save_settings(valid.withColumn(number, F.lit(-5)))
    assert store.load_settings().first() == valid.first()
    assert store.settings.read().count() == len(settings.DEFAULTS)
