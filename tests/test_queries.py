"""Every query with an oracle against DuckDB on sf0.01, as the driver compares them."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tracksift.plans import branches, details, flows, more, oracle, queries

QUERIES, ORACLES = queries.queries() | more.queries() | flows.queries() | branches.queries() | details.queries(), oracle.oracle_sql() | more.SQL | flows.SQL | branches.SQL | details.SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "__float__") and not isinstance(v, (int, bool, str)):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    cur = con.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    order = [have.index(n) for n in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=key)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=key)
    assert rows == want
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
