from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from shelfspark.sources.keyed import KeyedTable

SCHEMA = "id long, region string, book string, chapters string, at long"
KEY = ("id", "region")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def apply_upsert(model, batch):
    """A brute-force upsert: columns in the order of the schema, null keeps what is there."""
    for row in sorted(batch, key=lambda r: r[4]):
        if None in row[:2]:
            continue
        old = model.get(row[:2], (None, None, None))
        model[row[:2]] = tuple(n if n is not None else o for n, o in zip(row[2:], old, strict=True))


def state(table):
    return {(r["id"], r["region"]): (r["book"], r["chapters"], r["at"]) for r in table.read().collect()}


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_upserts_equal_brute_force_and_repeat_without_change(spark, tmp_path):
    r = random.Random(1)
    table, model = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, KEY, buckets=16), {}
    assert table.read().count() == 0
    for batch_no in range(4):
        batch = [(r.choice([None, *range(40)]) if r.random() < 0.9 else 7, r.choice(["us", "de", None]), r.choice([None, f"b{batch_no}{i}"]), r.choice([None, f"c{batch_no}{i}"]), batch_no * 100 + i) for i in range(30)]
        apply_upsert(model, batch)
        for _ in range(2):  # a batch that runs again changes nothing
            table.upsert(frame(spark, batch), ["at"])
            assert state(table) == model


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, KEY, buckets=32)
    table.upsert(frame(spark, [(i, "us", f"b{i}", None, 0) for i in range(500)]), ["at"])
    before = files(tmp_path)
    assert len(before) == 32
    touched = table.upsert(frame(spark, [(3, "us", None, "new", 1), (900, "us", "b", None, 1)]), ["at"])
    after = files(tmp_path)
    changed = {f.split("bucket=")[1].split("/")[0] for f in before ^ after}
    assert changed == {str(b) for b in touched} and 1 <= len(touched) <= 2
    got = state(table)
    assert got[3, "us"] == ("b3", "new", 1) and got[900, "us"] == ("b", None, 1) and len(got) == 501
    assert table.upsert(frame(spark, []), ["at"]) == [] and files(tmp_path) == after


def test_inserts_leave_stored_rows(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, KEY, buckets=4)
    table.insert(frame(spark, [(1, "us", "a", None, 5), (1, "us", "b", None, 3)]), ["at"])
    table.insert(frame(spark, [(1, "us", "z", "z", 0), (2, "us", "c", None, 0)]), ["at"])
    assert state(table) == {(1, "us"): ("b", None, 3), (2, "us"): ("c", None, 0)}


def test_lookups_read_the_buckets_of_their_keys(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, KEY, buckets=32)
    table.upsert(frame(spark, [(i, "us", f"b{i}", None, 0) for i in range(500)]), ["at"])
    found = table.lookup(frame(spark, [(3, "us"), (999, "us")], "id long, region string"))
    assert [(r["id"], r["book"]) for r in found.collect()] == [(3, "b3")]
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    scanned = table._stored().where(F.col("bucket").isin(table._touched(frame(spark, [(3, "us")], "id long, region string"))))
    assert len({f for r in scanned.select(F.input_file_name().alias("f")).distinct().collect() for f in [r["f"]]}) == 1


def test_columns_a_batch_lacks_stay(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, KEY, buckets=4)
    table.upsert(frame(spark, [(1, "us", "a", "c", 1)]), ["at"])
    table.upsert(spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit("us").alias("region"), F.lit("new").alias("book"), F.lit(2).cast("long").alias("at")), ["at"])
    assert state(table) == {(1, "us"): ("new", "c", 2)}
