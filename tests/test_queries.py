"""Every query that has SQL gives the same rows as DuckDB on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillon.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    """Values in one form for both engines."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def ordered(names, rows):
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_duckdb(spark, oracle, name):
    found = plans.QUERIES[name](spark, SF)
    result = oracle.execute(plans.SQL[name])
    assert ordered(found.columns, [tuple(r) for r in found.collect()]) == ordered([d[0] for d in result.description], result.fetchall())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)
