"""Every query with SQL gives the same rows as DuckDB over the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry
from data import PRESENT, SMALL

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not PRESENT, reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SMALL}/{name}'")
    return c


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return "null" if math.isnan(value) else f"{float(value):.6g}" if abs(value) > 1e9 else f"{round(float(value), 4) + 0.0:.4f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([[plain(r[i]) for i in order] for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    found = con.sql(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(found.columns, found.fetchall())
