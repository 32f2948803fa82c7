"""Every query that has DuckDB SQL gives the same rows there."""

import decimal
import math

import duckdb
import pytest

from folioscope.plans.catalogue import ORACLES, QUERIES

D = "/root/testdata/sf0.01"  # rows of fixtures have unique keys here
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and not isinstance(v, bool):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    there = duck.sql(ORACLES[name])
    names = list(there.columns)
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in there.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b or all(x == y or isinstance(x, (int, float)) and abs(x - y) < 3e-5 for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0
