"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from actflow.plans.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if isinstance(v, Decimal) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    got = Counter(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert got == want
