"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_dedup, collocations, decontam, hard_negatives, html_extract, line_dedup, lm_score, mixing, near_dedup, oracles, pii, quality, suffix_dedup, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lm_score.query,
    "op2_html_extract": html_extract.query,
    "op3_near_dedup": near_dedup.query,
    "op4_decontamination": decontam.query,
    "op5_token_store": token_store.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_pii": pii.query,
    "op8_quality_rules": quality.query,
    "op9_block_dedup": block_dedup.query,
    "op10_mixing": mixing.query,
    "op11_collocations": collocations.query,
    "op12_line_dedup": line_dedup.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLES: dict[str, str] = oracles.ORACLES
