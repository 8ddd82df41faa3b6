"""Registered queries against their SQL twins in DuckDB (sf0.001), all of them."""

import os

import duckdb
import pytest

from parlance.plans.oracle import ORACLE
from parlance.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def canon(rows, cols):
    return sorted(tuple(repr(r[c]) for c in cols) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r)) for r in rel.fetchall()]
    assert canon(df.collect(), sorted(names)) == canon(want, sorted(names))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
