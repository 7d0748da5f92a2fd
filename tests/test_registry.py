"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normalized

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    got, want = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalized(got) == normalized(want)


def test_nested_groups(spark):
    rows = queries()["facet_groups_nested"](spark, SF).collect()
    names = {r.query_id: [g.Name for g in r.FacetGroups] for r in rows}
    assert names.pop(9) == []  # the blank phrase
    assert names and all(n == ["Brand", "Material", "Mounting", "Style"] for n in names.values())


def test_entry(spark):
    assert entry(spark).count() > 0
