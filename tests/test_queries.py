"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from tallyrack.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.isoformat() if isinstance(v, dt.date) else v


@pytest.fixture(scope="module")
def duck():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in registry.ORACLE_SQL:
        got = duck.execute(registry.ORACLE_SQL[name])
        found = [x[0] for x in got.description]
        assert sorted(found) == columns
        assert rows == sorted(repr([plain(r[found.index(c)]) for c in columns]) for r in got.fetchall())
