"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from evidra.plans.dialect import TABLES
from evidra.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    ref = con.execute(SQL[name])
    assert sorted(c[0] for c in ref.description) == columns
    where = [[c[0] for c in ref.description].index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in where) for r in ref.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == want


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert os.path.basename(__file__)
