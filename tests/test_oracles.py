"""Every query and inline rule with SQL against DuckDB on the same tables; the others must run."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from korpusa import catalog
from korpusa.sources.tables import TABLES


def norm(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    return bool(x) if isinstance(x, bool) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda t: tuple((x is not None, str(type(x)), str(x)) for x in t))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES | catalog.RULES))
def test_query(spark, sf, duck, name):
    df = (catalog.QUERIES | catalog.RULES)[name](spark, sf)
    got = df.collect()
    if name not in catalog.SQL:
        assert len(got) > 0
        return
    rel = duck.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = rel.fetchall()
    assert len(want) > 0
    assert rows(df.columns, got) == rows(names, want)
