"""Every registered query of the run-log jobs against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from joblore.plans.catalog import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("events", "part", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    out = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    expected = sorted((tuple(r[names.index(c)] for c in order) for r in out.fetchall()), key=key)
    assert len(got) == len(expected)
    assert all(same(x, y) for r, q in zip(got, expected, strict=True) for x, y in zip(r, q, strict=True))
