"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return None if math.isnan(x) else float(f"{float(x):.11g}")
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    return x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*cols).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
