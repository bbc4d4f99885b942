from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import chapters, fuse, genres, jobs, match, paths, settings, template

C = F.col


def test_runtime_band(one):
    e = match.runtime_band(C("o"), C("l"))
    assert tuple(one(e, o=969, l=970)) == ("exact", -1, 25)
    assert one(e, o=420, l=970)["band"] == "off"
    assert one(e, o=1500, l=970)["band"] == "off"
    assert tuple(one(e, o=0, l=970)) == ("", 0, 0)


def linkage(spark, hint, candidates):
    rows = [("q", *hint, t, a, r, lang, i) for i, (t, a, r, lang) in enumerate(candidates)]
    pairs = spark.createDataFrame(rows, "q_id string, hint_title string, hint_author string, hint_runtime int, hint_language string, title string, authors array<string>, runtime_min int, language string, pos int")
    return match.ranked(match.scored(pairs), "q_id")


EXACT, LONG = ("Project Hail Mary", ["Andy Weir"], 970, "english"), ("Artemis", ["Andy Weir"], 538, "english")


@pytest.mark.parametrize(
    ("hint", "candidates", "strict", "lenient"),
    [
        (("Project Hail Mary", "Andy Weir", 970, "english"), [EXACT], True, True),
        (("Project Hail Mary", "Andy Weir", 970, "english"), [EXACT, LONG], True, True),
        (("Project Hail Mary", "Andy Weir", 970, "english"), [EXACT, EXACT], False, False),
        (("Project Hail Mary", "Andy Weir", 500, "english"), [EXACT], False, False),
        (("Project Hail Mary", "Andy Weir", 0, "english"), [EXACT], False, True),
        (("Something Else", "Andy Weir", 970, "english"), [EXACT], False, False),
        (("", "Andy Weir", 970, "english"), [EXACT], False, False),
        (("Project Hail Mary", "Andy Weir", 970, "german"), [EXACT], False, False),
        (("Project Hail Mary", "Someone", 0, ""), [EXACT], False, False),
    ],
)
def test_acceptance(spark, hint, candidates, strict, lenient):
    best = linkage(spark, hint, candidates)
    assert match.accepted(best).first()["accepted"] is strict
    assert match.leniently_accepted(best).first()["accepted"] is lenient


def test_score_keeps_catalog_order_for_ties(spark):
    rows = linkage(spark, ("", "", 0, ""), [("b", [], 0, ""), ("a", [], 0, "")]).orderBy("rank").collect()
    assert [r.title for r in rows] == ["b", "a"]
    assert [r.score for r in rows] == [100, 99]


def test_strictly_decreasing_equals_the_loop(spark):
    import random

    r = random.Random(3)
    lists = [[r.randint(-5, 100) for _ in range(r.randint(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(k, i, w) for k, ws in enumerate(lists) for i, w in enumerate(ws)], "k int, i int, wanted int")
    got = {(x.k, x.i): x.shown for x in match.strictly_decreasing(df, "k", [C("i")]).collect()}
    for k, ws in enumerate(lists):
        last = None
        for i, w in enumerate(ws):
            last = max(1, w if last is None else min(w, last - 1))
            assert got[k, i] == last


def chapter_rows(spark, starts, length=0):
    return spark.createDataFrame([(1, i, s, length) for i, s in enumerate(starts)], "b int, i int, start_ms long, length_ms long")


def test_fixed_shift(spark):
    out = chapters.shifted(chapter_rows(spark, [0, 20000]), "b", ["i"], F.lit(1500).cast("long"), F.lit(60000).cast("long")).orderBy("i").collect()
    assert [(r.start_ms, r.length_ms) for r in out] == [(1500, 20000), (21500, 38500)]


@pytest.mark.parametrize(
    ("starts", "anchors", "want"),
    [
        ([0, 10000, 20000, 30000, 40000, 50000], (1, 0, 5, 2000), [0, 10500, 21000, 31500, 42000, 52000]),
        ([0, 10000, 20000, 30000, 40000], (2, 1000, 4, 3000), [1000, 11000, 22000, 33000, 43000]),
        ([0, 10000, 20000], (3, 500, 1, 0), [0, 10250, 20500]),
    ],
)
def test_interpolated_shift(spark, starts, anchors, want):
    a, am, b, bm = anchors
    lit = lambda x: F.lit(x).cast("long")
    rows = chapters.anchored_shift(chapter_rows(spark, starts), "b", ["i"], F.lit(a), lit(am), F.lit(b), lit(bm))
    out = chapters.shifted(rows, "b", ["i"], C("shift_ms"), lit(0)).orderBy("i").collect()
    assert [r.start_ms for r in out] == want


def test_monotone_equals_the_loop(spark):
    import random

    r = random.Random(5)
    starts = sorted(r.randint(0, 1000) for _ in range(50))
    shifts = [r.randint(-300, 300) for _ in starts]
    df = spark.createDataFrame([(1, i, s, 0, d) for i, (s, d) in enumerate(zip(starts, shifts, strict=True))], "b int, i int, start_ms long, length_ms long, d long")
    got = [x.start_ms for x in chapters.shifted(df, "b", ["i"], C("d"), F.lit(900).cast("long")).orderBy("i").collect()]
    last, want = 0, []
    for s, d in zip(starts, shifts, strict=True):
        last = max(last, min(900, max(0, s + d)))
        want.append(last)
    assert got == want


def align(lengths, n, intro=0, outro=0):
    """The sequential rule."""
    extra, lo, hi = len(lengths) - n, 0, len(lengths)
    if n == 0 or extra < 0 or extra > 2:
        return None
    short = lambda i, brand: 0 < lengths[i] <= max(40_000, brand + 5_000)
    for _ in range(extra):
        if short(lo, intro):
            lo += 1
        elif short(hi - 1, outro):
            hi -= 1
        else:
            return None
    return [str(i) for i in range(lo, hi)]


def test_aligned_titles_equal_the_loop(spark):
    import random

    r = random.Random(9)
    cases = [([r.choice([0, 20_000, 39_000, 50_000, 90_000]) for _ in range(r.randint(1, 6))], r.randint(0, 6), r.choice([0, 50_000]), r.choice([0, 90_000])) for _ in range(300)]
    df = spark.createDataFrame([(i, [(str(j), 0, x) for j, x in enumerate(ls)], n, a, b) for i, (ls, n, a, b) in enumerate(cases)], f"k int, c {chapters.CHAPTERS}, n int, a long, b long")
    for row in df.select("k", chapters.aligned_titles(C("c"), C("n"), C("a"), C("b")).alias("t")).collect():
        assert row.t == align(*cases[row.k]), cases[row.k]


def test_file_titles(one):
    assert one(chapters.file_titles(C("p")), p=["x/01 - Opening Credits.mp3", "x/02_The_Middle.mp3"]) == ["Opening Credits", "The Middle"]
    assert one(chapters.file_titles(C("p")), p=["Track 01.mp3", "Track 02.mp3"]) == ["Chapter 01", "Chapter 02"]
    assert one(chapters.file_titles(C("p")), p=["1 Same.mp3", "2 Same.mp3"]) == ["Chapter 01", "Chapter 02"]


def plan(spark, mode, provider, runtime, files, accurate=True):
    probed = "array<struct<title:string,start_ms:bigint,end_ms:bigint>>"
    schema = f"mode string, title string, actual long, runtime long, accurate boolean, intro long, outro long, provider {chapters.CHAPTERS}, files array<struct<path:string,duration_ms:bigint,chapters:{probed},truncated:boolean,sidecar:{probed}>>"
    total = sum(f[1] for f in files)
    row = spark.createDataFrame([(mode, "Book", total, runtime, accurate, 0, 0, provider, files)], schema)
    return chapters.chosen(row).first()["plan"]


def test_chapter_choice(spark):
    file = lambda n, ms, own=(), cut=False, side=(): (f"0{n} - Name {n}.mp3", ms, list(own), cut, list(side))
    two, own, side = [file(1, 60_000), file(2, 60_000)], [("o", 0, 60_000)], [("s", 0, 60_000)]
    provider = [("P1", 0, 60_000), ("P2", 60_000, 60_000)]
    assert plan(spark, "auto", provider, 121_000, two).source == "provider"
    assert plan(spark, "", provider, 500_000, two).source == "files"
    assert plan(spark, "", provider, 500_000, two).warnings == ["provider runtime does not fit"]
    assert plan(spark, "provider", provider, 500_000, two, False).warnings == ["provider forced against its runtime", "provider timings possibly inaccurate"]
    assert plan(spark, "provider", [], 0, two).warnings == ["no provider chapters available"]
    titled = plan(spark, "titles-files", [("Brand", 0, 20_000), *provider], 1, two)
    assert (titled.source, [c.title for c in titled.chapters], titled.warnings) == ("titles-files", ["P1", "P2"], ["short provider chapters skipped"])
    assert [(c.title, c.start_ms) for c in plan(spark, "auto", [], 0, two).chapters] == [("Name 1", 0), ("Name 2", 60_000)]
    assert plan(spark, "auto", [], 0, [file(1, 60_000, own)]).source == "existing"
    assert plan(spark, "auto", [], 0, [file(1, 60_000, own, True, side)]).source == "sidecar"
    assert plan(spark, "existing", provider, 60_000, [file(1, 60_000, own, True, side)]).source == "existing"
    assert plan(spark, "sidecar", provider, 60_000, [file(1, 60_000, own)]).source == "provider"
    assert plan(spark, "auto", [], 0, [file(1, 60_000)]).chapters[0].title == "Book"


def test_chapter_text(one):
    cs = F.array(F.struct(F.lit(" A ").alias("title"), F.lit(0).cast("long").alias("start_ms"), F.lit(1500).cast("long").alias("length_ms")))
    assert one(chapters.text_file(cs)) == "00:00:00.000 A\n## total-duration: 00:00:01.500\n"


def test_verification(one):
    ok = chapters.verified_conversion(C("p"), C("m"), C("f"), C("c"))
    assert one(ok, p=1_000_000, m=1_009_000, f=2, c=3)
    assert not one(ok, p=1_000_000, m=1_011_000, f=2, c=3)
    assert not one(ok, p=1_000_000, m=1_000_000, f=2, c=0)
    why = chapters.retag_problem(C("b"), C("a"), C("w"), C("g"), C("t"))
    assert one(why, b=1000, a=1000, w=2, g=2, t="x") is None
    assert one(why, b=1000, a=1000, w=2, g=1, t="x") == "chapter count differs"
    assert one(why, b=1000, a=1000, w=2, g=2, t=" ") == "no title"


def test_genres(one):
    f = genres.cleaned(F.lit(""), C("g"), C("s"), F.array(F.array(F.lit("History"), F.lit("Old")), F.array(F.lit("Romance"), F.lit("Love")), F.array(F.lit("Romance"), F.lit("Love"), F.lit("New"))))
    out = one(f, g=["x"], s=["y"])
    assert (out.genres, out.sub_genres) == (["Romance"], ["Love", "New"])
    none = F.array().cast("array<array<string>>")
    flat = one(genres.cleaned(F.lit("Fiction "), C("g"), C("s"), none), g=["History", "Romance"], s=["y"])
    assert (flat.genres, flat.sub_genres) == (["Romance"], [])
    all_bad = one(genres.cleaned(F.lit("fiction"), C("g"), C("s"), none), g=["History"], s=["y"])
    assert (all_bad.genres, all_bad.sub_genres) == (["History"], ["y"])
    assert one(genres.record_kind(F.lit(""), F.array(F.array(F.lit("History")), F.array(F.lit("Romance"))))) == ""
    assert one(genres.without_placeholders(C("g")), g=["Audiobook", "Horror"]) == ["Horror"]


def test_paths(one):
    for bad in ("../outside", "..", "a/../../b", "/abs", "C:\\abs", "a\\b"):
        assert one(paths.confined(C("p")), p=bad) is None, bad
    assert one(paths.confined(C("p")), p="a/b c/d") == "a/b c/d"
    assert one(paths.confined(C("p")), p=" ") == "."
    assert one(paths.cleaned_path(C("p")), p="a//./b/../c/") == "a/c"
    for name, want in {"CD1": 1, "cd 2": 2, "Disc 3": 3, "DISK_10": 10, "Part.4": 4, "Chapter 1": None, "CDX": None, "Book CD": None}.items():
        assert one(paths.disc_number(C("p")), p=name) == want
    assert tuple(one(paths.typed_tokens(C("p")), p="Dune [uk]")) == ("", "uk", "Dune")
    assert one(paths.typed_tokens(C("p")), p="Unabridged edition")["id"] == ""
    assert one(paths.typed_tokens(C("p")), p="0593163389")["id"] == "0593163389"


def test_selection(spark):
    names = ["Terry Pratchett", "Terry Pratchett/Discworld", "Other Book", "Terry Pratchett/Discworld/01.mp3", "Other Book", "Deep/Nested/Dir/file.mp3"]
    got = paths.deduped_selection(spark.createDataFrame([(1, i, p) for i, p in enumerate(names)], "id int, pos int, path string")).orderBy("pos").collect()
    assert [r.path for r in got] == ["Terry Pratchett", "Other Book", "Deep/Nested/Dir/file.mp3"]


V = {"author": "Andy Weir", "title": "Project Hail Mary", "series_name": "Hail Mary", "series_position": "1", "asin": "B08G9PRS1K"}


@pytest.mark.parametrize(
    ("pattern", "holes", "want"),
    [
        ("{author}/{series_name}/{Book series_position:00 - }{title}/{title} [{asin}]", (), "Andy Weir/Hail Mary/Book 01 - Project Hail Mary/Project Hail Mary [B08G9PRS1K]"),
        ("{author}/{series_name}/{Book series_position:00 - }{title}/{title} [{asin}]", ("series_name", "series_position", "asin"), "Andy Weir/Project Hail Mary/Project Hail Mary"),
        ("Books/{year}/{title}", (), "Books/Project Hail Mary"),
        ("{author} - {year} - {title}", (), "Andy Weir - Project Hail Mary"),
        ("{title} (read by {narrator})", (), "Project Hail Mary"),
        ("{year}", (), None),
    ],
)
def test_template(one, pattern, holes, want):
    variables = {k: F.lit("" if k in holes else v) for k, v in V.items()}
    assert one(template.rendered(pattern, variables)) == want


def test_template_values_are_not_templates(one):
    assert one(template.rendered("{title}", {"title": F.lit("a{b}: (c) [d]/e.")})) == "a{b} (c) [d]e"


def test_template_problems():
    for bad in ("{authr}/{title}", "plain text", "", "{author}/{Book position - }{title}", "{author}/{title", "{author/title}"):
        assert template.problem(bad), bad
    assert template.problem("{author}/{Book series_position:00 - }{title}") is None


def book(**fields):
    base = {"title": "", "subtitle": "", "authors": [], "narrators": [], "series_name": "", "series_position": "", "year": "", "release_date": "", "publisher": "", "language": "", "genres": [], "sub_genres": [], "genre_paths": [], "literature_type": "", "description": "", "summary": "", "runtime_min": 0, "cover_url": ""}
    return tuple({**base, **fields}.values())


def test_merge(spark):
    rows = spark.createDataFrame([(1, book(title="A", description="short", series_name="S"), book(title="B", publisher="P", summary="full", series_name="T", series_position="2"))], f"id int, primary {fuse.BOOK}, secondary {fuse.BOOK}")
    r = fuse.merged(rows).first()
    assert (r.book.title, r.book.publisher, r.book.summary, r.book.series_name, r.book.series_position) == ("A", "P", "full", "S", "")
    assert r.sources == {"title": "primary", "publisher": "secondary", "description": "secondary", "series": "primary"}
    o = fuse.merged(rows, overrides=F.create_map(F.lit("title"), F.lit("secondary"), F.lit("publisher"), F.lit("primary"))).first()
    assert (o.book.title, o.book.publisher) == ("B", "P")


def test_jobs(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [("a", "pending", now, None, None, None, None), ("b", "running", now, now, None, None, None), ("c", "error", now, now, now, "x", None)]
    df = spark.createDataFrame(rows, "id string, status string, created_at timestamp, started_at timestamp, finished_at timestamp, error string, result string")
    state = lambda d: {r.id: (r.status, r.error) for r in d.collect()}
    t = F.lit(now)
    assert state(jobs.reconciled(df, t))["b"] == ("error", "interrupted")
    done = jobs.finished(df, spark.createDataFrame([("b", "r", ""), ("a", "r", "")], "id string, result string, error string"), t)
    assert state(done)["b"][0] == "done" and state(done)["a"][0] == "pending"
    assert state(jobs.cancelled(df, spark.createDataFrame([("a",), ("b",)], "id string"), t)) == {"a": ("cancelled", None), "b": ("running", None), "c": ("error", "x")}
    again = jobs.retries(df, spark.createDataFrame([("c",), ("a",)], "id string"), t).collect()
    assert [(r.status, r.error) for r in again] == [("pending", None)] and again[0].id != "c"
    assert jobs.history(df).count() == 2


def test_template_previews_of_the_samples(spark):
    want = {
        "{author}/{title}": ("J.K. Rowling/Harry Potter and the Sorcerer's Stone.m4b", "Andy Weir/Project Hail Mary.m4b"),
        "{author}/{series_name}/{Book series_position:00 - }{title}/{title} [{asin}]": ("J.K. Rowling/Harry Potter/Book 01 - Harry Potter and the Sorcerer's Stone/Harry Potter and the Sorcerer's Stone [B017V4IM1G].m4b", "Andy Weir/Project Hail Mary/Project Hail Mary [B08G9PRS1K].m4b"),
        "{narrator} ({year})": ("Jim Dale (2015).m4b", "Ray Porter (2021).m4b"),
        "{series_name}": ("Harry Potter.m4b", None),
    }
    for made, both in want.items():
        shown = settings.preview(made)
        assert tuple(spark.range(1).select(shown["series"], shown["standalone"]).first()) == both


def test_process_config():
    known = settings.process_config({"PORT": "90", "DEV": "True", "INPUT_DIR": " /books ", "OUTPUT_DIR": ""})
    assert (known["port"], known["dev"], known["input_dir"], known["output_dir"]) == (90, True, "/books", "/output")
    assert settings.process_config({"PORT": "x1", "DEV": "no"})["port"] == 8684 and settings.process_config({})["dev"] is False
