from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import paths
from shelfspark.sources import fetch, listing
from shelfspark.sources.keyed import KeyedTable


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for folder in ("A/Book one/CD 1", "A/Book one/CD 2", "A/empty", "B é/x y/z", "@eaDir/deep/er", "A/.hidden/in"):
        (root / folder).mkdir(parents=True)
    for i, f in enumerate(["A/Book one/CD 1/01.mp3", "A/Book one/CD 2/02.mp3", "A/cover.jpg", "B é/x y/z/ä.m4b", "top.mp3", "@eaDir/deep/er/t.mp3", "A/.hidden/in/x.mp3"]):
        (root / f).write_bytes(b"x" * i)
    for i in range(300):
        (root / "B é" / f"{i:03}").mkdir()
    return root


def walked(root, junk):
    out = set()
    for d, dirs, files in os.walk(root):
        rel = os.path.relpath(d, root)
        at = "" if rel == "." else rel + "/"
        out |= {(at + n, True, 0) for n in dirs} | {(at + n, False, os.path.getsize(os.path.join(d, n))) for n in files}
        if not junk:
            dirs[:] = [n for n in dirs if not n.startswith((".", "@eaDir"))]
    return out


@pytest.mark.parametrize("junk", [True, False])
@pytest.mark.parametrize("address", ["{}", "file://{}", "file:{}", "{}/"])
def test_trees_equal_a_walk(spark, library, junk, address):
    if junk and address != "{}":
        return
    tree = listing.folder_tree(spark, address.format(library), junk, folders=50)
    assert {(r["rel_path"], r["is_dir"], r["size"]) for r in tree.collect()} == walked(library, junk)
    assert tree.where("mtime is null").count() == 0


def test_empty_folders_are_known_and_hidden_from_listings(spark, library):
    tree = listing.folder_tree(spark, str(library))
    counts = {r["parent"]: (r["audio_files"], r["sub_dirs"]) for r in paths.children(tree).collect()}
    assert counts["A"] == (0, 2) and "A/empty" not in counts  # Book one and the empty one; .hidden is junk
    shown = [r["name"] for r in paths.listing(tree, "A", newest_first=False).collect()]
    assert shown == ["Book one"]


def test_folders_are_listed_by_many_tasks(spark, library):
    tree = listing.folder_tree(spark, str(library), folders=20)
    by_level = {f.split("level=")[1].split("/")[0] for f in tree.inputFiles()}
    assert by_level == {"0", "1", "2", "3"}
    assert sum("level=2" in f for f in tree.inputFiles()) >= 3 or tree.where("rel_path like 'B é/%'").count() >= 300


def test_missing_and_empty_roots(spark, tmp_path):
    assert listing.folder_tree(spark, str(tmp_path)).count() == 0
    assert listing.folder_tree(spark, str(tmp_path / "none")).count() == 0


def transport(url):
    if "missing" in url:
        return 404, {}, None
    if "down" in url:
        return 500, {}, None
    return 200, {}, f'{{"at": "{url}"}}'


class Clock:
    def __init__(self):
        self.t = 1000.0

    def now(self):
        return self.t

    def sleep(self, s):
        self.t += s


def test_lanes_share_one_rate():
    times = []
    for lane in range(4):
        clock = Clock()
        slots = fetch.Slots(lane, 4, 80, clock.now, clock.sleep)
        for _ in range(50):
            slots.wait()
            times.append(clock.t)
            clock.t += 0.01 * lane
    times.sort()
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.74  # no two requests share a slot of 0.75 s
    assert max(sum(a <= t < a + 60 for t in times) for a in times) <= 80


def test_a_lane_that_is_run_again_takes_no_slot_twice():
    clock = Clock()
    first = fetch.Slots(2, 4, 80, clock.now, clock.sleep)
    first.wait()
    again = fetch.Slots(2, 4, 80, clock.now, clock.sleep)
    again.wait()
    assert again.last > first.last


def test_a_column_of_addresses(spark):
    urls = spark.createDataFrame([(f"u{i}",) for i in range(30)] + [("missing",), (None,)], "url string").repartition(5)
    got = fetch.fetched(urls, "tests.test_listing_fetch:transport", rate=6000, lanes=3).collect()
    assert sorted(r["url"] for r in got) == sorted([f"u{i}" for i in range(30)] + ["missing"])
    assert {r["status"] for r in got if r["url"] == "missing"} == {"not_found"} and all(r["body"] == f'{{"at": "{r["url"]}"}}' for r in got if r["status"] == "ok")
    asked = sorted(r["asked"] for r in got)
    assert len(set(asked)) == len(asked)


def test_rounds_go_on_where_the_last_ended(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/answers", fetch.ANSWER, ("url",), buckets=4)
    urls = spark.createDataFrame([(f"u{i}",) for i in range(25)] + [("missing",)], "url string")
    options = {"rate": 60_000, "lanes": 2, "round_size": 10}
    assert fetch.fetch_all(urls, table, "tests.test_listing_fetch:transport", rounds=1, **options) == 10  # cut off after a round
    assert fetch.fetch_all(urls, table, "tests.test_listing_fetch:transport", **options) == 16
    assert fetch.fetch_all(urls, table, "tests.test_listing_fetch:transport", **options) == 0
    assert {(r["url"], r["status"]) for r in table.read().collect()} == {(f"u{i}", "ok") for i in range(25)} | {("missing", "not_found")}


def test_a_stream_of_addresses(spark, tmp_path):
    spark.createDataFrame([(f"u{i}",) for i in range(6)], "url string").coalesce(1).write.parquet(str(tmp_path / "in"))
    table = KeyedTable(spark, f"file://{tmp_path}/answers", fetch.ANSWER, ("url",), buckets=2)
    source = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
    stream = fetch.fetched(source, "tests.test_listing_fetch:transport", rate=60_000, lanes=2).writeStream.foreachBatch(lambda batch, _: table.upsert(batch.persist(), ["asked"])).option("checkpointLocation", str(tmp_path / "cp"))
    assert stream.trigger(availableNow=True).start().awaitTermination(120)
    assert table.read().where(F.col("status") == "ok").count() == 6
