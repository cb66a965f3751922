"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in oracle_sql():
        cursor = duck.execute(oracle_sql()[name])
        assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())
    else:
        assert got[1]


def test_every_sql_belongs_to_a_query(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns[:2] == ["pincode", "contractor_name"]
