import pytest

import __spark_entry__ as entry
from data import PRESENT, SMALL

NO_SQL = sorted(set(entry.queries()) - set(entry.oracle_sql()))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not PRESENT, reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["subset", "n_tables", "actual", "total"]
    assert entry.entry(spark).count() == 6


@pytest.mark.skipif(not PRESENT, reason="no test tables")
@pytest.mark.parametrize("name", NO_SQL)
def test_queries_without_sql_run(spark, name):
    df = entry.queries()[name](spark, SMALL)
    rows = df.limit(5).collect()
    assert rows and len(set(df.columns)) == len(df.columns)
