"""Registered queries of this subpackage against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from tessera.llm import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = c.execute(catalogue.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted(repr(tuple(r[order.index(n)] for n in names)) for r in found.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == want
