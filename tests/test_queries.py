"""Every registered receipt query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tillwright.plans import registry as fixtures

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        try:
            return str(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_matches_sql(spark, db, name):
    df = fixtures.QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    want = db.sql(fixtures.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(got, df.columns) == normal(want.fetchall(), want.columns)


def test_every_query_has_sql():
    assert set(fixtures.QUERIES) == set(fixtures.ORACLES)
