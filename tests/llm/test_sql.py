"""The operators' queries against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from shelfspark.llm import registry

from ..test_queries import TABLES, rows


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = con.execute(registry.ORACLES[name])
    assert got == rows([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_query_covers_its_table(spark, sf_dir, name):
    table = "pages" if "html" in name else "documents"
    assert registry.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
