"""Every query with SQL gives DuckDB's rows; every other one gives rows of a stable schema."""

import datetime
import math
import os

import duckdb
import pytest

import kgspark.plans.registry as registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in registry.ORACLES:
        return
    got = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLES[name]})")
    assert sorted(got.columns) == columns
    assert rows == sorted((tuple(map(plain, r)) for r in got.fetchall()), key=repr)


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
