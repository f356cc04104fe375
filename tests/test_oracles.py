"""Every registered query with SQL against DuckDB at the smallest scale."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(n for n in entry.registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, datetime.date):
        return f"{v} 00:00:00"
    return v


@pytest.mark.parametrize("name", CORE)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_name_the_subpackage():
    root = os.path.dirname(entry.__file__)
    for d, _, files in os.walk(f"{root}/tidemark"):
        if "/llm" not in d:
            assert not [f for f in files if f.endswith(".py") and "llm import" in open(f"{d}/{f}").read()]
