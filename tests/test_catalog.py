"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    return None if v is None else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = tables.sql(catalog.ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())


def test_without_sql(spark):
    """The approximate search alone has no SQL: ten rows for each query, the query's own first."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"vector_ann"}
    rows = catalog.QUERIES["vector_ann"](spark, SF).collect()
    assert len(rows) == 10 * len({r["query"] for r in rows}) and all(r["id"] == r["query"] for r in rows if r["rank"] == 1)
