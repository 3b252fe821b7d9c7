"""Every registered query with SQL equals DuckDB's result on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{t}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
