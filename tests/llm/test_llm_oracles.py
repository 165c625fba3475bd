"""The queries that SQL can express, against DuckDB on the same files."""

import duckdb
import pytest

import __spark_entry__ as entry
from spanlake.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.project(", ".join(columns)).fetchall(), key=key)
