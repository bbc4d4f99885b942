from __future__ import annotations

import datetime
import json
import struct

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import jobs
from shelfspark.sources import containers, fetch, payloads, tables
from shelfspark.sources.keyed import KeyedTable
from shelfspark.streaming import events

C = F.col


@pytest.mark.parametrize(
    ("body", "starts", "titles"),
    [
        ("00:00:00 Start\n00:01:00.5 Next\n", [0, 60_500], ["Start", "Next"]),
        ("﻿# note\n\n00:00:00,25\n", [250], ["Chapter 01"]),
        ("CHAPTER01=00:00:00.000\nCHAPTER01NAME=One\nCHAPTER02=00:02:00\n", [0, 120_000], ["One", "Chapter 02"]),
    ],
)
def test_sidecar(one, body, starts, titles):
    s = one(payloads.sidecar(C("b"), F.lit(300_000).cast("long")), b=body)
    assert s.reason is None
    assert [c.start_ms for c in s.chapters] == starts
    assert [c.title for c in s.chapters] == titles
    assert s.chapters[-1].end_ms == 300_000


def test_bad_sidecars(one):
    e = payloads.sidecar(C("b"), F.lit(60_000).cast("long"))
    assert one(e, b="00:00:30 a\n00:00:10 b").reason == "starts out of order"
    assert one(e, b="00:00:30 a\n00:02:00 b").reason == "starts after the audio ends"
    assert one(e, b="").chapters == []


def test_product(one):
    body = {"product": {"asin": "B1", "title": "T", "authors": [{"name": "A"}, {"name": ""}], "release_date": "2011-03-04", "series": [{"title": "S", "sequence": ""}, {"title": "N", "sequence": "2"}], "category_ladders": [{"ladder": [{"name": "G"}, {"name": "s"}]}, {"ladder": [{"name": "G"}, {"name": "t"}]}], "product_images": {"500": "u"}, "publisher_summary": "<p>Hi &amp; bye</p>", "unknown": 1}}
    b = one(payloads.product_book(C("b")), b=json.dumps(body))
    assert (b.title, b.authors, b.year, b.series_name, b.series_position, b.genres, b.sub_genres, b.cover_url, b.summary) == ("T", ["A"], "2011", "N", "2", ["G"], ["s", "t"], "u", "Hi & bye")
    assert one(payloads.product_book(C("b")), b='{"product":{"asin":"B1"}}') is None
    assert one(payloads.product_book(C("b")), b="broken") is None


def test_secondary_and_chapters(one):
    b = one(payloads.secondary_book(C("b")), b=json.dumps({"title": "T", "releaseDate": "2011-03-04T00:00", "genres": [{"name": "G", "type": "genre"}, {"name": "t", "type": "tag"}], "seriesPrimary": {"name": "S", "position": "1.5"}}))
    assert (b.year, b.release_date, b.genres, b.sub_genres, b.series_position) == ("2011", "2011-03-04", ["G"], ["t"], "1.5")
    c = one(payloads.chapter_list(C("b")), b=json.dumps({"isAccurate": True, "runtimeLengthMs": 10, "chapters": [{"title": "x", "startOffsetMs": 0, "lengthMs": 10}]}))
    assert (c.accurate, c.runtime_ms, c.chapters[0].title) == (True, 10, "x")


def test_probe(one):
    body = {"format": {"format_name": "mov,mp4", "duration": "12.5", "bit_rate": "64000", "tags": {"title": "T"}}, "streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2, "time_base": "1/44100", "duration_ts": 551250, "nb_frames": "539"}], "chapters": [{"start_time": "0.0", "end_time": "12.5", "tags": {"title": "One"}}]}
    p = one(payloads.probe(C("b")), b=json.dumps(body))
    assert (p.duration_ms, p.bitrate_kbps, p.sample_rate, p.codec, p.chapters_truncated, p.chapters[0].title) == (12500, 64, 44100, "aac", False, "One")


REPLIES = [
    ('```json\n{"title":"T","authors":["A"]}\n```', ("T", ["A"]), []),
    ('Sure! {"title":"T","authors":"A; B","year":2011} Enjoy.', ("T", ["A", "B"]), []),
    ('{"title":"unknown","authors":["A"]}', ("", ["A"]), []),
    ("no", None, ["no JSON"]),
    ("{broken", None, ["no JSON"]),
    ("{broken}", None, ["broken JSON"]),
    ('{"weather":"fine"}', None, ["not about a book"]),
]


@pytest.mark.parametrize(("reply", "want", "warnings"), REPLIES)
def test_lenient_reply(one, reply, want, warnings):
    r = one(payloads.lenient_reply(C("s")), s=reply)
    assert (r.book and (r.book.title, r.book.authors), r.warnings) == (want, warnings)


def test_library_items(one):
    xml = '<MediaContainer librarySectionID="3"><Directory ratingKey="9"><Collection tag="A"/><Collection tag="B"/></Directory></MediaContainer>'
    assert tuple(one(payloads.library_item(C("x")), x=xml)) == ("3", "9", ["A", "B"])
    assert one(payloads.with_collection(C("c"), F.lit("b")), c=["A", "B"]) == ["A", "B"]
    assert one(payloads.with_collection(C("c"), F.lit("d")), c=["A"]) == ["A", "d"]
    assert one(payloads.query_string(F.create_map(F.lit("b"), F.lit("x y"), F.lit("a"), F.lit("1"), F.lit("z"), F.lit("")))) == "a=1&b=x+y"


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(ticks: int, samples: int, media_ticks: int = 0) -> bytes:
    head = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, ticks))
    media = box(b"mdhd", b"\0" * 12 + struct.pack(">II", 44100, media_ticks)) + box(b"minf", box(b"stbl", box(b"stts", struct.pack(">IIII", 0, 1, samples, 1024))))
    data = lambda s: box(b"data", b"\0" * 8 + s)
    tags = box(b"\xa9nam", data(b"Title")) + box(b"----", box(b"mean", b"\0" * 4 + b"com") + box(b"name", b"\0" * 4 + b"ASIN") + data(b"B0")) + box(b"covr", data(b"\x89PNG"))
    return box(b"ftyp", b"M4B ") + box(b"moov", head + box(b"trak", box(b"mdia", media)) + box(b"udta", box(b"meta", b"\0" * 4 + box(b"ilst", tags))))


def test_containers(spark, tmp_path):
    (tmp_path / "a.m4b").write_bytes(movie(23_220, 1000))
    (tmp_path / "b.m4b").write_bytes(movie(5, 1000))  # an edit list's difference, no fault
    (tmp_path / "w.m4b").write_bytes(movie(132_262, 4_200_000, 4_200_000 * 1024 % 2**32))  # the low 32 bits of the true length
    (tmp_path / "c.m4b").write_bytes(b"\0\0\0\x10ftypxx")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-5]: r for r in containers.read_containers(files).collect()}
    assert (got["a"].tags, got["a"].duration_ms, bytes(got["a"].cover), got["a"].problem) == ({"title": "Title", "ASIN": "B0"}, 23_220, b"\x89PNG", None)
    assert (got["b"].duration_ms, got["b"].problem) == (5, None)
    assert (got["w"].duration_ms, got["w"].problem) == (4_200_000 * 1024 * 1000 // 44100, "header duration is wrong")
    assert got["c"].problem == "no movie box"
    # the same by seeks over paths; what cannot be opened says so
    paths = spark.createDataFrame([(str(tmp_path / f"{x}.m4b"),) for x in "abcwz"], "path string")
    sought = {r.path[-5]: r for r in containers.read_paths(paths).collect()}
    assert all(sought[x][1:] == got[x][1:] for x in "abcw")
    assert sought["z"].problem.startswith("cannot be read")


def test_wrapped_durations_are_written_out():
    wrapped = 4_200_000 * 1024
    head = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 132_262) + b"rest")
    media = box(b"mdhd", b"\0" * 12 + struct.pack(">II", 44100, wrapped % 2**32) + b"\x55\xc4\0\0")
    table = box(b"stbl", box(b"stts", struct.pack(">IIII", 0, 1, 4_200_000, 1024)) + box(b"stco", struct.pack(">IIII", 0, 2, 100, 5000)))
    track = box(b"trak", box(b"tkhd", b"\0" * 12 + struct.pack(">III", 1, 0, 132_262) + b"tail") + box(b"mdia", media + box(b"minf", table)))
    movie_bytes = box(b"moov", head + track)
    fixed = containers.repaired(movie_bytes, start=24)
    found = containers.read(fixed)
    assert found["problem"] is None and found["header_ms"] == found["sample_ms"] == wrapped * 1000 // 44100
    grown = len(fixed) - len(movie_bytes)
    assert grown == 3 * 12 and struct.pack(">IIII", 0, 2, 100, 5000 + grown) in fixed  # only the chunk behind the box moved
    assert b"rest" in fixed and b"tail" in fixed and struct.pack(">Q", wrapped) in fixed
    assert containers.repaired(fixed) is None and containers.repaired(movie(23_220, 1000)[12:]) is None
    with pytest.raises(ValueError, match="no longer fits"):
        containers.repaired(movie_bytes.replace(struct.pack(">IIII", 0, 2, 100, 5000), struct.pack(">IIII", 0, 2, 100, 2**32 - 5)), start=24)


def test_a_large_file_is_read_by_seeks(tmp_path):
    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def seek(self, *a):
            return self.f.seek(*a)

        def tell(self):
            return self.f.tell()

        def read(self, n):
            self.n += n
            return self.f.read(n)

    whole = movie(23_220, 1000)
    at = whole.index(b"moov") - 4
    with open(tmp_path / "big.m4b", "wb") as f:
        f.write(whole[:at] + struct.pack(">I4s", 50_000_008, b"mdat"))
        f.seek(50_000_000, 1)
        f.write(whole[at:])
    with open(tmp_path / "big.m4b", "rb") as f:
        counted = Counting(f)
        assert containers.read(containers.movie_box(counted))["tags"]["title"] == "Title"
        assert counted.n < 10_000


def test_fetch_retries():
    answers = iter([(500, {}, None), (429, {"Retry-After": "500"}, None), (200, {}, "ok")])
    waits = []
    bucket = fetch.TokenBucket(10, 60, now=lambda: 0.0, sleep=waits.append)
    assert fetch.fetch("u", lambda _: next(answers), bucket, sleep=waits.append, jitter=lambda: 0) == ("ok", "ok")
    assert waits == [0.5, 120.0]
    assert fetch.fetch("u", lambda _: (404, {}, None), bucket) == ("not_found", None)
    assert fetch.fetch("u", lambda _: (500, {}, None), bucket, sleep=lambda _: None) == ("error", None)


def transport(url):
    return (404, {}, None) if "missing" in url else (200, {}, json.dumps({"url": url}))


def test_fetch_source(spark):
    spark.dataSource.register(fetch.JsonFetch)
    out = spark.read.format("json_fetch").option("urls", json.dumps(["a", "missing", "b"])).option("partitions", "2").option("transport", "tests.test_sources:transport").load()
    assert {(r.url, r.status) for r in out.collect()} == {("a", "ok"), ("b", "ok"), ("missing", "not_found")}


def test_tables(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    schema = "id int, v string"
    assert tables.read(spark, root, schema).count() == 0
    for n in range(4):
        tables.replace(spark.createDataFrame([(n, "x")], schema), root)
    assert [r.id for r in tables.read(spark, root, schema).collect()] == [3]
    tables.prune(spark, root)
    assert tables.read(spark, root, schema).count() == 1
    (tmp_path / "log.txt").write_text("a\nb\nc\n")
    assert [r.line for r in tables.tail(spark, str(tmp_path / "log.txt"), 2).collect()] == ["b", "c"]


def test_file_tree(spark, tmp_path):
    (tmp_path / "x" / "CD 1").mkdir(parents=True)
    (tmp_path / "x" / "CD 1" / "a.mp3").write_bytes(b"123")
    got = {(r.rel_path, r.is_dir, r["size"]) for r in tables.file_tree(spark, str(tmp_path)).collect()}
    assert got == {("x/CD 1/a.mp3", False, 3), ("x", True, 0), ("x/CD 1", True, 0)}


def run_events():
    t = datetime.datetime(2024, 1, 1)
    ms = [0, 100, 400, 500, 650, 700, 1300]
    stages = ["probe", "probe", "probe", "probe", "probe", "merge", "merge"]
    return [("j", "progress", s, 0.1 if i < 6 else 1.0, "running", "", t + datetime.timedelta(milliseconds=m)) for i, (m, s) in enumerate(zip(ms, stages, strict=True))]


def test_throttle_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(run_events(), events.EVENT)
    batch = sorted((r.stage, r.ts.microsecond // 1000 + 1000 * r.ts.second) for r in events.throttled_batch(df).collect())
    assert batch == [("merge", 700), ("merge", 1300), ("probe", 0), ("probe", 500)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(events.EVENT).parquet(str(tmp_path / "in"))
        query = events.throttled_stream(source).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted((r.stage, r.ts.microsecond // 1000 + 1000 * r.ts.second) for r in spark.table("throttled").collect()) == batch
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_states_by_batches(spark, tmp_path):
    start = spark.createDataFrame([("a", "p/x", datetime.datetime(2024, 1, 1)), ("b", "p/fail", datetime.datetime(2024, 1, 1))], "job_id string, path string, start timestamp")
    sim = events.simulated(start, jobs.STAGES["sort"])
    assert sim.count() == 30
    sim.coalesce(1).write.parquet(str(tmp_path / "in"))
    root = f"file://{tmp_path}/states"
    source = spark.readStream.schema(events.EVENT).parquet(str(tmp_path / "in"))
    query = source.writeStream.foreachBatch(events.state_upserter(root)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.job_id, r.status) for r in KeyedTable(spark, root, "job_id string, status string, ts timestamp", ("job_id",)).read().collect()} == {("a", "done"), ("b", "error")}


def test_polling_finds_new_files_and_keeps_to_its_tasks(spark, tmp_path):
    seen = []

    def apply(batch, number):
        seen.append((number, batch.rdd.getNumPartitions(), sorted(r["job_id"] for r in batch.collect())))

    def add(*names):
        spark.createDataFrame([(n, None, None, None, None, None, None) for n in names], events.EVENT).repartition(8).write.mode("append").parquet(str(tmp_path / "in"))

    add(*[f"j{i}" for i in range(40)])
    source = spark.readStream.schema(events.EVENT).parquet(str(tmp_path / "in"))
    query = events.polled(source, apply, str(tmp_path / "cp"), every="1 second", most=3)
    try:
        query.processAllAvailable()
        add("late")
        query.processAllAvailable()
    finally:
        query.stop()
    assert [x[2] for x in seen] == [sorted(f"j{i}" for i in range(40)), ["late"]]
    assert all(tasks <= 3 for _, tasks, _ in seen)
