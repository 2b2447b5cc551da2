"""Every further query returns, over the smallest tables, the rows that its SQL says."""

import glob
import math
import os

import duckdb
import pytest

from factloom.plans import more_queries

TABLES = "/root/testdata/sf0.001"
NAMES = [n for n, f in more_queries.QUERIES.items() if f.__module__ == more_queries.__name__]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(spark, tables, name):
    if not glob.glob(f"{TABLES}/*.parquet"):
        pytest.skip("no tables")
    out = more_queries.QUERIES[name](spark, TABLES)
    columns = sorted(out.columns)
    found = tables.execute(more_queries.SQL[name])
    named = [d[0] for d in found.description]
    assert sorted(named) == columns
    want = sorted(plain([row[named.index(c)] for c in columns]) for row in found.fetchall())
    assert sorted(plain(row) for row in out.select(*columns).collect()) == want
