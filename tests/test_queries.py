"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemill.plans import batch_queries, curation_queries, record_queries, stored_queries

SQL = curation_queries.query.sql | batch_queries.query.sql | record_queries.query.sql | stored_queries.query.sql


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def order(row):
    return tuple((v is None, f"{v:.6e}" if isinstance(v, float) else str(v)) for v in row)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, duck, name):
    df = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(df.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    want = sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(all(map(same, a, b)) for a, b in zip(got, want, strict=True))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
