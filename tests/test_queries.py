"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = db.execute(catalogue.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = [tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall()]
    have = [tuple(plain(r[n]) for n in names) for r in got.collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
