"""Every registered query against its SQL in DuckDB, on whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def order(row):
    return tuple((value is None, str(value)) for value in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    positions = [list(expected.columns).index(c) for c in names]
    rows = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=order)
    wanted = sorted((tuple(r[i] for i in positions) for r in expected.fetchall()), key=order)
    assert rows == wanted


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.queries()) >= set(QUERIES)
