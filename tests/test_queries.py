"""Every query against its SQL in DuckDB, on the driver tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from shelfspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = duck.execute(catalog.oracles()[name])
    want = rows([c[0] for c in result.description], result.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in result.description)
    assert got == want
    assert got or name == "library_search"


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
