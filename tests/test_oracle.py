"""Every registered query against its SQL counterpart on the smallest data set."""

import datetime as dt
import os

import duckdb
import pytest

from catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain_value(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def ordered(rows):
    return sorted((tuple(map(plain_value, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = ordered(df.select(columns).collect())
    if name not in ORACLES:
        assert rows
        return
    duck.execute(ORACLES[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    expected = ordered([tuple(r[names.index(c)] for c in columns) for r in duck.fetchall()])
    assert rows == expected
