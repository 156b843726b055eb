"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__
from fathom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    rows = [r.asDict(True) for r in found.collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    told = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted((tuple(map(plain, r)) for r in told.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr) == want


def test_entry(spark):
    assert len(__spark_entry__.entry(spark).collect()) == 10
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())
