"""Every query that has SQL gives the rows of its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quern.plans import catalogue, further, oracle, oracle_further

QUERIES, SQL = catalogue.QUERIES | further.QUERIES, oracle.SQL | oracle_further.SQL

TABLES = Path("/root/testdata/sf0.001")


def same(spark, name, query, sql, tables=TABLES):
    con = duckdb.connect()
    for p in tables.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    norm = lambda v: float(f"{v:.9g}") if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v
    df = query(spark, str(tables))
    columns = sorted(df.columns)
    found = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert found == expected, name


@pytest.mark.skipif(not TABLES.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, name, QUERIES[name], SQL[name])


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
