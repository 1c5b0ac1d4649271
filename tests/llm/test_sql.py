"""Queries of this subpackage beside their SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from wayfarer.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
