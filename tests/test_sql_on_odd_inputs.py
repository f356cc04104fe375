"""Queries against their SQL on inputs that the supplied tables don't have: sums just under a half, null keys, keys of very many values."""

import datetime

import duckdb

import __spark_entry__ as entry
from tests.test_oracles import plain
from tidemark.functions.scalar import rounded
from tidemark.operators import stats

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def at(text):
    return datetime.datetime.fromisoformat(f"{text}+00:00")


def both(spark, tmp_path, rows, name):
    """A query's rows over events, in order, and those of its SQL."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    return [tuple(map(plain, (r[c] for c in columns))) for r in got.collect()], [tuple(map(plain, r)) for r in cur.fetchall()]


def before(hours):
    return at("2024-01-31T00:00:00") - datetime.timedelta(hours=hours)


def test_health_scores_just_under_a_half_round_as_in_sql(spark, tmp_path):
    hours = [(437, 474, 474), (437, 622, 696), (474, 585, 696), (100, 200, 300)]
    rows = [(10 * u + k, before(h), u, kind, 1.0, "{}") for u, hs in enumerate(hours) for k, (h, kind) in enumerate(zip(hs, ("view", "click", "purchase"), strict=True))]
    got, want = both(spark, tmp_path, rows, "customer_health")
    assert sorted(got) == sorted(want) and {r[1] for r in got} >= {27.9, 14.6}


def test_users_at_risk_without_an_id_come_last(spark, tmp_path):
    rows = [(u, before(719 - u % 2), None if u == 30 else u, "click", 1.0, "{}") for u in range(31)]
    got, want = both(spark, tmp_path, rows, "health_at_risk")
    assert got == want and len(got) == 20


def test_rounding(spark):
    df = spark.createDataFrame([(14.649999999999999, 14.7), (-2.25, -2.3), (0.04, 0.0), (None, None)], "x double, y double")
    assert df.where(~rounded(df["x"], 1).eqNullSafe(df["y"])).collect() == []


def test_quantiles_of_many_values_without_a_key_are_one_row(spark):
    df = spark.range(60_001).selectExpr("cast(id as double) as v")
    assert [tuple(r) for r in stats.quantiles(df, [], "v", {"lo": 0.25, "hi": 0.95}).collect()] == [(15_000.0, 57_000.0)]
    assert [tuple(r) for r in stats.floor_ranks(df.where("v < 20"), [], "v", {"p50": 0.5}, small=10).collect()] == [(10.0,)]
    assert [tuple(r) for r in stats.quantiles(df.where("v < 0"), [], "v", {"p50": 0.5}).collect()] == [(None,)]


def test_platform_health_of_events_without_a_type(spark, tmp_path):
    rows = [(97 * n if n % 2 else n, before(n % 700), 2 + n % 8, "view" if n % 3 else None, 500.0 if n % 2 else float(n), "{}") for n in range(400)]
    got, want = both(spark, tmp_path, rows, "platform_health")
    assert got == want and len(got) == 1
