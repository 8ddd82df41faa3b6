"""Queries with a SQL twin against it, over sf0.01."""

import os

import duckdb
import pytest

from parlance.llm.oracle import ORACLE
from parlance.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want
