from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import clock, tags, text

C = F.col


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Project Hail Mary [Unabridged] (2021).mp3", "Project Hail Mary"),
        ("01 - The Way of Kings", "The Way of Kings"),
        ("andy_weir-the_martian_64k", "andy weir-the martian"),
        ("Dune (Complete Audiobook) {Frank Herbert}", "Dune"),
        ("Émile Zola - Germinal", "Emile Zola - Germinal"),
        ("The.Hobbit.m4b", "The Hobbit"),
        ("", ""),
    ],
)
def test_normalized_name(one, name, want):
    assert one(text.normalized_name(C("s")), s=name) == want


def test_author_title(one):
    assert one(text.author_title(C("s")), s="Andy Weir - Project Hail Mary").asDict() == {"author": "Andy Weir", "title": "Project Hail Mary"}
    assert one(text.author_title(C("s")), s="Dune").asDict() == {"author": "", "title": "Dune"}
    assert one(text.author_title(C("s")), s="one two three four five - x")["author"] == ""


def test_fuzzy_distance(one):
    assert one(text.fuzzy_distance(C("a"), C("b")), a="dune", b="dune: the whole saga") == 3
    assert one(text.fuzzy_distance(C("a"), C("b")), a="kitten", b="sitting") == 3
    assert one(text.fuzzy_distance(C("a"), C("b")), a="it", b="it ends") == 5  # too short to soften
    assert one(F.levenshtein(C("a"), C("b")), a="café", b="cafe") == 1


def natural_less(a: str, b: str) -> bool:
    import re

    def parts(s):
        return [(0, int(t)) if t.isdigit() else t for t in re.findall(r"[0-9]+|[^0-9]", s.lower())]

    x, y = parts(a), parts(b)
    for p, q in zip(x, y, strict=False):
        if isinstance(p, tuple) and isinstance(q, tuple):
            if p != q:
                return p < q
        else:
            p, q = ("0" if isinstance(p, tuple) else p), ("0" if isinstance(q, tuple) else q)
            if p != q:
                return p < q
    return len(x) < len(y)


@pytest.mark.parametrize(("a", "b"), [("file_2", "file_10"), ("a2b", "a10a"), ("Chapter 9", "chapter 10"), ("01 intro", "2 body"), ("a", "a1")])
def test_natural_key(one, a, b):
    assert one(text.natural_key(C("a")) < text.natural_key(C("b")), a=a, b=b)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abZ019 _", min_size=1, max_size=9), min_size=2, max_size=40))
def test_natural_key_orders_as_the_comparator(spark, names):
    got = {r.s: r.k for r in spark.createDataFrame([(n,) for n in names], "s string").select("s", text.natural_key(C("s")).alias("k")).collect()}
    for a in names:
        for b in names:
            if natural_less(a, b):
                assert got[a] <= got[b], (a, b)


def test_html_text(one):
    assert one(text.html_text(C("s")), s="<p>A &amp; B</p><p>C<br/>D</p>\r\n <b>x</b>  y ") == "A & B\n\nC\n\nD\n\nx y"
    assert one(text.html_text(C("s")), s="") == ""


def test_people_and_lists(one):
    assert one(text.people(C("s")), s="A, B; C") == ["A, B", "C"]
    assert one(text.people(C("s")), s="A & B") == ["A", "B"]
    assert one(text.people(C("s")), s="A, B ,") == ["A", "B"]
    assert one(text.people(C("s")), s="") == []
    assert one(text.listed(C("s")), s=" a; ;b") == ["a", "b"]
    assert one(text.distinct_in_order(C("s")), s=["b", " a", "b ", ""]) == ["b", "a"]


def test_names(one):
    assert one(text.sort_name(C("s")), s="Frank Herbert") == "Herbert, Frank"
    assert one(text.sort_name(C("s")), s="Martin King Jr.") == "King, Martin, Jr."
    assert one(text.sort_name(C("s")), s="Plato") == "Plato"
    assert one(text.initials(C("s")), s="John Ronald Reuel Tolkien") == "J.R.R.Tolkien"
    assert one(text.truncated(C("s"), 12), s="some words that go on") == "some words…"
    assert one(text.truncated(C("s"), 3), s="ééé") == "é…"
    assert one(text.truncated(C("s"), 30), s="short") == "short"


def test_trimming_is_unicode(one):
    assert one(text.trimmed(C("s")), s="  x 　\t") == "x"


@pytest.mark.parametrize(("kbps", "want"), [(0, 128), (63, 64), (70, 64), (81, 96), (110, 96), (125, 128), (130, 128), (200, 192), (300, 320), (999, 320), (80, 64)])
def test_snapped_rate(one, kbps, want):
    assert one(clock.snapped_rate(C("k")), k=kbps) == want


def test_unwrapped(one):
    e = clock.unwrapped_ms(C("c"), C("b"), C("t"), C("n"))
    assert one(e, c="aac", b="1/44100", t=21092352, n=4214902) == 97869833
    assert one(e, c="mp3", b="1/44100", t=21092352, n=4214902) is None
    assert one(e, c="aac", b="x", t=21092352, n=4214902) is None
    assert one(e, c="aac", b="1/44100", t=1024 * 1000, n=1000) is None


def test_clock(one):
    assert one(clock.status_ms(C("s")), s="frame=1 time=01:02:03.50 speed=2x") == 3723500
    assert one(clock.status_ms(C("s")), s="no time here") is None
    assert one(clock.seconds_ms(C("s")), s="1.9996") == 1999
    assert one(clock.seconds_ms(C("s")), s="x") == 0
    assert one(clock.timestamp_text(C("n")), n=3723004) == "01:02:03.004"
    assert one(clock.clock_text(C("n")), n=63_000) == "1:03"
    assert one(clock.leading_year(C("s")), s="2011-05") == "2011"
    assert one(clock.year_before_dash(C("s")), s="12345") == "12345"
    assert str(one(clock.release_date(C("d"), C("y")), d="bad", y="2011")) == "2011-01-01"
    assert one(clock.shift_input_ms(C("s")), s="99999999") == 3_600_000
    assert one(clock.doubled_rating(C("s")), s="4.5") == 9.0
    assert one(clock.doubled_rating(C("s")), s="") is None


def test_tags(one):
    raw = F.create_map(*[F.lit(x) for x in ("com.apple:Title", " T ", "ALBUM", "A", "x:asin", "b0abcdefg1", "Description", "short", "comment", "much longer", "DATE", "2011-02-03T00", "artist", "P & Q", "title", "other")])
    b = one(tags.book(raw))
    assert (b.asin, b.title, b.summary, b.year, b.release_date, b.authors) == ("B0ABCDEFG1", "T", "much longer", "2011", "2011-02-03", ["P", "Q"])
    hand = F.create_map(F.lit("own_source"), F.lit("Manual"), F.lit("own_id"), F.lit("7"))
    assert one(tags.hand_tagged_id(hand, "own")) == "7"
    assert one(tags.hand_tagged_id(F.create_map(F.lit("own_id"), F.lit("7")), "own")) == ""


def test_ids(one):
    assert one(text.catalog_id(C("s")), s="0593163389")
    assert not one(text.catalog_id(C("s")), s="059316338")
    assert not one(text.catalog_id_token(C("s")), s="UNABRIDGED")
