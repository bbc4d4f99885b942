"""Queries that read whole tables and whole texts."""

from __future__ import annotations

from shelfspark.plans import names, queue


def test_search_payloads_hold_products_of_any_key(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(k, f"name {k}", "brand", "type", 5) for k in (1, 999, 1000, 1001, 25_000)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{root}/part.parquet")
    got = {r.title for r in queue.search_payloads(spark, root).collect()}
    assert got == {f"name {k}" for k in (1, 999, 1000, 25_000)}  # 1001 is a podcast


def test_truncated_texts_of_any_language_as_they_are(spark, tmp_path):
    root = f"file://{tmp_path}"
    texts = ["kurz", "écoute " * 12, "日本語" * 10, "plain words " * 9, None]
    spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["de", "fr", None, "en", "en"], strict=True))], "doc_id long, text string, lang string").write.parquet(f"{root}/documents.parquet")
    got = {r.doc_id: (r.short, r.cap) for r in names.truncated_texts(spark, root).collect()}
    # at most 60 bytes, cut at a space after the 30th
    assert got == {
        0: ("kurz", "Kurz"),
        1: ("écoute " * 6 + "écoute…", "Écoute éc"),
        2: ("日本語" * 6 + "日本…", "日本語日本語日本語"),
        3: ("plain words " * 4 + "plain words…", "Plain wor"),
        4: (None, None),
    }
