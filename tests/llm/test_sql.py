"""Queries against their SQL, all windows and all shingles, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from paperloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    own = queries()[name](spark, DATA)
    found = con.execute(oracle_sql()[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == sorted(own.columns)
    assert sorted(tuple(r) for r in own.select(*order).collect()) == sorted(found.fetchall())
