"""What a query must not do on its way to its rows, told from plans and small limits."""

from __future__ import annotations

import pytest

from shelfspark.operators import match
from shelfspark.plans import catalog, link


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["link_auto_accept", "link_display_scores", "link_lenient_accept", "link_top_candidates", "link_nearest_editions"])
def test_parts_are_not_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in plan(catalog.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("block", [3, 10, 25, 1000])
def test_neighbours_across_blocks(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(link, "BLOCK", block)
    types = {r["p_partkey"]: r["p_type"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    want = {(q, c, i) for q in types for i, c in enumerate(sorted((c for c in types if types[c] == types[q]), key=lambda c: (abs(c - q), c))[: link.CANDIDATES])}
    got = link._pairs(spark, sf_dir).select("q_id", "c_id", "pos").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_author_names_meet_by_what_deletions_leave(spark):
    names = ["Ann Lee", "Ann Léé", "Anne Lee", "An Le", "Ann", "Anna Leer", "Bo", "B", "", "Åsa Lee", None]
    wanted = [(f"k{i}", i % 2, n) for i, n in enumerate([*names, *names])]
    listed = [(i % 2, i, n) for i, n in enumerate([*reversed(names), *names])]
    fold = lambda n: n.lower().replace("é", "e").replace("å", "a")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for k, by, w in wanted:
        met = sorted((d, pos) for b, pos, n in listed if b == by and w is not None and n is not None and (d := distance(fold(w), fold(n))) <= 2)
        want |= {(k, pos, d, i) for i, (d, pos) in enumerate(met, 1)}
    out = match.author_candidates(spark.createDataFrame(wanted, "k string, by int, wanted_name string"), spark.createDataFrame(listed, "by int, pos int, name string"), "k", "by")
    got = out.select("k", "pos", "distance", "rank").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert "_rest" in plan(out) and "BroadcastHashJoin" not in plan(out)


@pytest.mark.parametrize("name", ["link_text_accept", "link_text_ranked", "link_text_editions"])
def test_titles_are_not_sent_with_each_pair(spark, sf_dir, name):
    from shelfspark.plans import similar

    assert "title" not in similar._pairs(spark, sf_dir).columns
    ranks = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("Window")[1]
    assert "title" not in ranks.replace("title_distance", "").replace("hint_title", "")


@pytest.mark.parametrize("name", ["link_text_editions", "link_text_ranked"])
def test_pairs_of_titles_are_not_sent(spark, sf_dir, name):
    above, search = plan(catalog.queries()[name](spark, sf_dir)).split("Generate posexplode", 1)
    assert "Exchange" not in above and "Exchange" in search


@pytest.mark.parametrize(("near", "block"), [(128, 1000), (25, 7)])
def test_top_candidates_of_any_place(spark, tmp_path, monkeypatch, near, block):
    import duckdb

    monkeypatch.setattr(link, "NEAR", near)
    monkeypatch.setattr(link, "BLOCK", block)
    # twins 40 places off among titles that are all unlike, keys with gaps, a type of long titles and one of five parts
    rows = [(3 * k + k % 2, f"{'twin title' if k % 40 == 0 else chr(97 + k % 26) * (4 + k % 9)}", f"Brand#{k % 7}", "A", 10 if k % 40 == 0 else 1 + k % 50) for k in range(130)]
    rows += [(1000 + 5 * k, chr(97 + k % 26) * (60 + k % 5) if k % 61 else "long twin " * 7, f"Brand#{k % 5}", "B", 20 if k % 61 == 0 else 1 + k % 50) for k in range(250)]
    rows += [(9000 + k, "few", "Brand#1", "C", 3) for k in range(5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = link.top_candidates(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({link.TOP_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert (0, 120, 1) in {(q, c, 1) for q, c, *_ in want}
