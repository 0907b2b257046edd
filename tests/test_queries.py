"""Every registered query against its SQL oracle, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in cols]
    b = sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b
    assert b


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
