"""Every named query against its SQL in DuckDB, on the smallest data."""

import os

import duckdb
import pytest

from pointloom.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(None if r[i] is None else repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values) if all(c is not None for r in values for c in r) else sorted((tuple("" if r[i] is None else repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values))


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for name in os.listdir(SF):
        own.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return own


@pytest.mark.parametrize("name", sorted(queries()))
def test_matches_sql(name, spark, duck):
    got = queries()[name](spark, SF)
    want = duck.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
