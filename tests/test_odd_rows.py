"""Queries against their SQL on rows that the driver tables do not hold."""

from __future__ import annotations

import duckdb

from shelfspark.plans import catalog


def same(spark, root, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(root))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracles()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and len(want) == len(rows)


def test_references_of_html_to_text(spark, tmp_path):
    texts = ["<a>?x=1&region=eu&copy=2</a>", "&amp;lt; &lt;b&gt; &quot;x&quot;", "&copy;&middot;&hearts;&#65;&nbsp;&amp;amp;", "", "<p>a</p><p>&notit;</p>"]
    same(spark, tmp_path, "html_to_text", "pages", list(enumerate(texts)), "page_id long, html string")


def test_tick_counts_of_large_keys(spark, tmp_path):
    keys = [1, 7, 430_659, 430_660, 430_664, 645_990, 1_200_000, 5_000_000_000]
    rows = [(k, s) for k in keys for s in (3, 25, 26, 50)]
    same(spark, tmp_path, "snap_rung_wrap_recovery", "part", rows, "p_partkey long, p_size int")


def test_tick_counts_of_keys_below_one(spark, tmp_path):
    keys = [0, -1, -7, -1000, -426_400, -430_650, -430_659, -430_660, -430_661, -645_990, -5_000_000_000, None]
    rows = [(k, s) for k in keys for s in (None, -5, 0, 25, 26, 50)]
    same(spark, tmp_path, "snap_rung_wrap_recovery", "part", rows, "p_partkey long, p_size int")


def test_capitals_and_cuts_of_texts(spark, tmp_path):
    starts = ["ßheit, was", "ﬁn", "ŉ x", "ᾳβ", "İstanbul", "ΑΣ ΟΔΟΣ", "éa", "", " x", "😀 y"]
    long = ["a" * 30 + " " + "b" * 28 + "�" + " tail", "é" * 40, "x" * 59 + "é", "x" * 58 + "é!", "word " * 20, "w" * 31 + " ́" + "c" * 40, "日本 " * 12, "a" * 61, "a" * 60]
    same(spark, tmp_path, "truncate_text", "documents", list(enumerate([*starts, *(s + " " + "z" * 70 for s in starts), *long])), "doc_id long, text string")
