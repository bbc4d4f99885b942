"""Words of a kilobyte and more: unlike ones must not pass for each other in any operator.

Words on the Thue-Morse pattern collide for every pair of letters under a polynomial hash modulo 2**64.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from shelfspark.llm import block_dedup, decontam, lm_score, near_dedup, textops, token_store

from .helpers import sentence


def pattern(a: str, b: str, n: int = 1024) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


X, Y = pattern("a", "b"), pattern("b", "a")


@pytest.mark.parametrize("n", [8, 64, 65, 512, 1024, 2048, 4096])
def test_hashes_of_long_words_differ(n):
    made = [pattern(a, b, n) for a in "abcdefgh" for b in "abcdefgh" if a != b]
    data = np.frombuffer("".join(made).encode(), np.uint8)
    starts = np.arange(len(made)) * n
    h = textops.word_hashes(data, starts, starts + n)
    assert len(set(h.tolist())) == len(made)
    again = textops.word_hashes(np.concatenate([data[3:n], data]), starts + n - 3, starts + 2 * n - 3)
    assert (h == again).all()


def test_windows_of_unlike_long_words_stay(spark):
    rest = sentence(random.Random(1), 19, 10**6)
    df = spark.createDataFrame([(1, f"{X} {rest}"), (2, f"{Y} {rest}"), (3, f"{X} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in block_dedup.block_dedup(df).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_unlike_long_words_are_no_near_copies(spark):
    df = spark.createDataFrame([(1, X), (2, Y), (3, X)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_unlike_long_words_contaminate_nothing(spark):
    docs = spark.createDataFrame([(1, X), (2, f"a {Y} b")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", Y)], "item_id string, text string")
    assert {r.doc_id: list(r["items"]) for r in decontam.contamination(docs, bench).collect()} == {1: [], 2: ["i"]}


def test_unlike_long_words_keep_their_ids(spark, tmp_path):
    texts = [f"x {X}", f"x {Y}", f"{Y} {X} {Y}"]
    token_store.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), token_store.default_tokenizer(), f"file://{tmp_path}/s")
    got = {r.doc_id: r.ids_crc32 for r in token_store.read_tokens(spark, f"file://{tmp_path}/s", crc=True).collect()}
    plain = token_store.Encoder(token_store.default_tokenizer()).tokenizer
    assert got == {i: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}


def test_unlike_long_words_are_counted_apart(spark):
    df = spark.createDataFrame([(1, f"{X} {X} {X} {X}"), (2, f"{Y} {X}")], "doc_id long, text string")
    same = spark.createDataFrame([(1, "p p p p"), (2, "q p")], "doc_id long, text string")
    marks = spark.createDataFrame([(1,)], "doc_id long")
    loss = lambda d: {r.doc_id: (r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9)) for r in lm_score.cross_entropy_difference(d, marks, min_count=1).collect()}
    assert loss(df) == loss(same)


def test_token_store_of_an_empty_table(spark, tmp_path):
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), token_store.default_tokenizer(), f"file://{tmp_path}/e")
    assert token_store.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_operators_with_clashing_columns(spark):
    text = sentence(random.Random(2), 60)
    wide = spark.createDataFrame([(1, text, "en", "s", 1, 2, 3, True, 4, 5)], "doc_id long, text string, lang string, source string, size int, source_size int, row int, kept boolean, doc int, _m int")
    from shelfspark.llm import mixing, quality

    assert [60 <= r.taken <= 120 for r in mixing.mix_documents(wide).collect()] == [True]
    assert quality.quality(wide.drop("_m", "kept")).count() == 1
    assert near_dedup.near_duplicates(wide).count() == block_dedup.block_dedup(wide).count() == 1
    assert decontam.contamination(wide, spark.createDataFrame([("i", text)], "item_id string, text string")).first()["items"] == ["i"]
