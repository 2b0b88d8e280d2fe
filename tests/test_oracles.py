"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in entry.queries()])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    want = sorted(tuple(plain(r[theirs.index(c)]) for c in names) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
