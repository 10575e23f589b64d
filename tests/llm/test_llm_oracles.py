"""The queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from korpusa.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=str)
    df = registry.QUERIES[name](spark, sf)
    assert len(want) > 0 and sorted(map(tuple, df.select(*names).collect()), key=str) == want
