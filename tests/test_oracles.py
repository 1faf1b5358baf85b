"""Every query with SQL returns what DuckDB returns."""

import glob
import os

import duckdb
import pytest

from lamina import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted([tuple(plain(r[i]) for i in at) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_rows(spark, con, name):
    df, rel = q.QUERIES[name](spark, SF), con.sql(q.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())
