"""Every query with SQL against DuckDB on the same files."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spanlake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert norm(tuple(r) for r in got.select(*columns).collect()) == norm(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_nested_loops(spark):
    """Interval joins are equi-joins on bins; nothing is paired with everything."""
    for name in ("overlap_pairs", "overlap_range_only", "overlap_full", "count_overlaps", "sql_comma_join", "sql_with_clause", "events_self_overlap", "nearest_row", "contained_in", "sql_key_on_range_where", "sql_left_join", "sql_right_join_residual", "sql_full_join", "sql_exists", "sql_anti_join", "sql_three_tables", "sql_more_comparisons"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
