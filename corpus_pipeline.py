"""From raw documents to token shards: quality rules, near-duplicates, test items, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All
but the last return the columns of ``documents``; the last writes the token store, reads
it back and returns a row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import corpus, decontam, mixing, near_dedup, quality, token_store

STAGES = [
    ("quality_rules", quality.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
    ("tokens", token_store.stage),
]

#: Tokenisation and permutations are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = corpus.stored()
    for name, stage in STAGES[:-1]:
        docs = corpus.table(stage(spark, docs, sf_dir), name)
        corpus.sweep(spark, mark)  # what the stage stored on its way, and the one before it
    return STAGES[-1][1](spark, docs, sf_dir)
