"""Literal cases and properties of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.operators import graph, materialize, privacy, quality, state, stats
from tidemark.streaming import flows


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, "alice", "active", 100.0), (2, "bob", "active", 50.0), (3, "carol", "inactive", -10.0), (4, None, "active", 75.0), (5, "alice", "active", 200.0)]
    return spark.createDataFrame(rows, "id int, email string, status string, amount double")


def outcome(orders, check):
    return quality.run_suite(orders, [check], "orders").first().passed


@pytest.mark.parametrize(
    "kind, column, value, passed",
    [("NOT_NULL", "id", None, True), ("NOT_NULL", "email", None, False), ("UNIQUE", "id", None, True), ("UNIQUE", "email", None, False), ("ROW_COUNT_MIN", None, 3, True), ("ROW_COUNT_MIN", None, 10, False), ("ROW_COUNT_MAX", None, 10, True), ("ROW_COUNT_MAX", None, 3, False),
     ("ACCEPTED_VALUES", "status", ("active", "inactive"), True), ("ACCEPTED_VALUES", "status", ("active",), False), ("CUSTOM_SQL", None, "select * from {model} where id > 100", True), ("CUSTOM_SQL", None, "select * from {model} where amount < 0", False)],
)
def test_checks(orders, kind, column, value, passed):
    assert outcome(orders, quality.Check(kind, column, value)) is passed


def test_suite_is_sorted_and_ids_are_stable(orders):
    checks = [quality.Check("UNIQUE", "id"), quality.Check("ROW_COUNT_MIN", None, 1), quality.Check("NOT_NULL", "id")]
    a, b = (quality.run_suite(orders, c, "t").collect() for c in (checks, checks[::-1]))
    assert [r.kind for r in a] == ["NOT_NULL", "ROW_COUNT_MIN", "UNIQUE"] and [r.test_id for r in a] == [r.test_id for r in b]


def history(spark, values):
    return spark.createDataFrame([("m", k, float(v)) for k, v in enumerate(values)], "model string, k int, v double")


@pytest.mark.parametrize("values, kind", [([10, 10.5, 9.8, 10.2, 10.1, 10.3, 9.9], None), ([10, 10.2, 9.8, 10.1, 10, 10, 100], "spike"), ([100, 99, 101, 100.5, 99.5, 100, 10], "drop"), ([0, 0, 0, 0], None)])
def test_anomalies(spark, values, kind):
    assert stats.cost_anomaly(history(spark, values), "model", "v", [F.col("k").desc()]).first().kind == kind


def test_anomaly_needs_three_points(spark):
    assert stats.cost_anomaly(history(spark, [1, 2]), "model", "v", [F.col("k").desc()]).count() == 0


@pytest.mark.parametrize("values, trend", [([10] * 8, "stable"), ([10, 12, 14, 17, 20, 25, 30], "increasing"), ([30, 25, 20, 17, 14, 12, 10], "decreasing"), ([5], "stable"), ([0, 0, 0], "stable")])
def test_forecasts(spark, values, trend):
    r = stats.ewma_forecast(history(spark, values), "model", "v", ["k"]).first()
    assert r.trend == trend and 0 <= r.lower <= r.next_7d <= r.upper
    if len(values) == 1:
        assert (r.lower, r.upper) == (17.5, 52.5)


def test_incremental_reruns_change_nothing(spark):
    target = materialize.scratch(spark)
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-10')) as d").withColumn("p", F.col("d"))
    body = lambda s, e: days.where((F.col("d") >= s) & (F.col("d") < e))
    for _ in range(2):
        materialize.incremental(body, "2024-01-03", "2024-01-05", target, ["p"])
    assert spark.read.parquet(target).count() == 3
    materialize.incremental(body, "2024-01-06", "2024-01-06", target, ["p"])
    assert spark.read.parquet(target).count() == 4


def test_backfill_stops_at_the_first_failure(spark):
    def write(start, end):
        if start == "b":
            raise ValueError("no")

    got = state.run_backfill(spark, [("a", "a"), ("b", "b"), ("c", "c")], write, materialize.scratch(spark)).orderBy("chunk").collect()
    assert [r.status for r in got] == ["COMPLETED", "FAILED"]


def test_merge_keeps_columns_that_are_not_updated(spark):
    t, s = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "k int, x string, y int"), spark.createDataFrame([(2, "c", 5), (3, None, 7)], "k int, x string, y int")
    assert sorted(map(tuple, materialize.merge_by_key(t, s, ["k"], ["y"]).collect())) == [(1, "a", None), (2, "b", 5), (3, None, 7)]


def test_specs():
    with pytest.raises(ValueError):
        materialize.TableSpec("t", None, "MERGE_BY_KEY")
    with pytest.raises(ValueError):
        materialize.TableSpec("t", None, "INCREMENTAL_BY_TIME_RANGE")
    assert materialize.TableSpec("t", None).resolve({"dev": "/x/"}, "dev") == "/x/t"


def test_exports(spark):
    df = spark.createDataFrame([("=1+1", 2), ("ok", 3)], "a string, n int")
    target = materialize.scratch(spark)
    materialize.export(df, target, "csv")
    assert sorted(r.a for r in sources.read(spark, target, "csv", df.schema).collect()) == ["'=1+1", "ok"]
    sources.write_events(df, target + "-j")
    sources.write_events(df, target + "-j")
    assert sources.read(spark, target + "-j", "json", df.schema).count() == 4


def scrub_one(spark, text, profile):
    return spark.createDataFrame([(text,)], "a string").select(privacy.scrubbed(F.col("a"), profile).alias("a")).first().a


def test_scrubs(spark):
    text = "a@b.org 123-45-6789 4111 1111 1111 1111 3782-8224-6310-005 +1 555 123-4567 10.0.0.1 2001:db8:0:0:0:0:0:1 password=hunter2"
    df = spark.createDataFrame([(text, [text], {"k": text}, (text, 1))], "a string, b array<string>, c map<string,string>, d struct<x:string,y:int>")
    r = privacy.scrub_nested(df).first()
    # phones go before social security numbers and cards, as the order has it
    assert r.a == "[REDACTED_EMAIL] [REDACTED_SSN] [REDACTED_CC] [REDACTED_CC] +[REDACTED_PHONE] [REDACTED_IP] [REDACTED_IP] [REDACTED_SECRET]"
    assert r.b == [r.a] and r.c == {"k": r.a} and r.d.x == r.a and r.d.y == 1


def test_scrubbed_values_stay_and_cases_differ(spark):
    one = lambda t, p="telemetry": scrub_one(spark, t, p)
    assert one("Token: [REDACTED_TOKEN] apikey = x1 API_KEY:y") == "Token: [REDACTED_TOKEN] [REDACTED_SECRET] [REDACTED_SECRET]"
    assert one("DAPI" + "0" * 32 + " dapi" + "a" * 31) == "[REDACTED_TOKEN] dapi" + "a" * 31
    assert one("where FULL_NAME = 'Bo Li' and mail = 'x@y.zz' and name = 'Bo'", "sql") == "where [REDACTED_NAME_FILTER] and mail = '[REDACTED_EMAIL]' and name = 'Bo'"
    assert one("x = 'it''s' and y = 1234567 and z = 123456", "prompt_sql") == "x = <LITERAL> and y = <ID> and z = 123456"
    assert one("api-secret: q 5555 4444 3333 1111 a@b.cd", "prompt") == "<SECRET> <CC> <EMAIL>"
    got = spark.createDataFrame([("it's 'x'",), ("plain",), (None,), ("123-45-6789",)], "a string").select(privacy.contains_pii(F.col("a")).alias("p")).collect()
    assert [r.p for r in got] == [True, False, False, True]
    assert one(None) is None


def test_purge_counts_and_sorted_json(spark):
    df = spark.sql("select * from values (1, timestamp '2024-01-01 00:00:00'), (2, timestamp '2024-01-30 12:00:00'), (3, null) as t(k, ts)")
    got = {tuple(r) for r in privacy.purge_counts({"a": (df, "ts", "12 hours"), "b": (df, "ts", "30 days")}, "2024-01-31 00:00:00").collect()}
    assert got == {("a", 2, 1), ("b", 3, 0)}
    j = spark.createDataFrame([('{"b": 1, "a": {"d": [1, 2], "c": null}}',), ("no json",), (None,)], "j string").select(privacy.sorted_json(F.col("j")).alias("j")).collect()
    assert [r.j for r in j] == ['{"a":{"c":null,"d":[1,2]},"b":1}', None, None]


def test_audit_chain_of_a_long_log(spark):
    log = privacy.audit_chain(spark.range(30000).selectExpr("id % 2 as tenant", "id as at", "cast(id as string) as what"), "tenant", ["at"], ["what"])
    rows = log.withColumn("is_anonymized", F.lit(False))
    assert {tuple(r) for r in privacy.audit_verify(rows, "tenant", ["at"], ["what"]).collect()} == {(0, True, 15000), (1, True, 15000)}
    broken = rows.withColumn("what", F.when(F.col("at") == 2001, "x").otherwise(F.col("what")))
    assert {tuple(r) for r in privacy.audit_verify(broken, "tenant", ["at"], ["what"]).collect()} == {(0, True, 15000), (1, False, 1000)}


def test_merge_takes_one_source_row_of_a_key(spark):
    t = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k int, x string, at int")
    s = spark.createDataFrame([(1, "old", 2), (1, "new", 3), (None, "m", 2), (2, "c", 1), (2, "d", 9)], "k int, x string, at int")
    got = sorted(map(str, (tuple(r) for r in materialize.merge_by_key(t, s, ["k"], order_by=[F.col("at").desc()]).collect())))
    assert got == ["(1, 'new', 3)", "(2, 'd', 9)", "(None, 'm', 2)"]


def test_json_export(spark):
    target = materialize.scratch(spark)
    materialize.export(spark.createDataFrame([("=x", 2)], "a string, n int"), target, "json")
    assert [tuple(r) for r in spark.read.schema("a string, n int").json(target).collect()] == [("=x", 2)]
    with pytest.raises(ValueError):
        materialize.export(spark.range(1), target, "xml")


def test_measured_schema(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, x string")
    assert [(r.column_name, r.data_type, r.nullable) for r in quality.measured_schema(df, "t").collect()] == [("k", "BIGINT", 0), ("x", "STRING", 1)]
    assert [r.nullable for r in quality.measured_schema(df.limit(0), "t").collect()] == [0, 0]


def test_outbox_stream_in_batches(spark, tmp_path):
    """Oldest rows first, at most `most` a step; what fails is tried again until three attempts are over."""
    for k in range(3):
        spark.range(k * 200, k * 200 + 200).selectExpr("id as event_id", "timestamp_seconds(1000 - id) as created_at", "'pending' as status", "0 as attempts", "id % 10 <> 0 as handled").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema("event_id long, created_at timestamp, status string, attempts int, handled boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = {r.event_id: (r.status, r.attempts) for r in flows.deliver(stream, steps=2, most=150).collect()}
    assert len(rows) == 600 and flows.batch_size(10) == 100 and flows.batch_size(120) == 240 and flows.batch_size(9000) == 500
    done = [i for i, (status, _) in rows.items() if status != "pending"]
    assert len(done) > 500 and all(rows[i] == ("delivered", 0) for i in done if i % 10) and all(rows[i][1] >= 1 for i in rows if i % 10 == 0 and i < 150)


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(k % 3 or None, float(rng.randrange(50))) for k in range(500)] + [(9, 5.0), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.lo, r.hi) for r in stats.quantiles(df, ["k"], "v", {"lo": 0.25, "hi": 0.95}).collect()}
    want = {r.k: tuple(r.q) for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.95))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k], strict=True))


def test_cost_model_of_eight_features(spark):
    rng = random.Random(4)
    names = [f"f{k}" for k in range(8)]
    rows = [(*(xs := [rng.random() * 10 for _ in names]), 3 + sum((k - 3) * x for k, x in enumerate(xs)) + rng.gauss(0, 0.5)) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in (*names, "y")))
    a = np.array([(1, *r[:8]) for r in rows])
    want = np.maximum(0, a @ np.linalg.lstsq(a, np.array([r[8] for r in rows]), rcond=None)[0])
    got = [r.predicted for r in stats.predict_cost(stats.fit_cost_model(df, names, "y"), df).collect()]
    assert np.allclose(got, want, atol=1e-6) and min(got) == 0


def test_contract_modes_and_presence_only_drift(spark):
    schema = "table_name string, column_name string, data_type string, nullable int"
    e, a = spark.createDataFrame([("t", "A", None, 1), ("t", "gone", "INT", 1)], schema), spark.createDataFrame([("t", "a", "INT", 1), ("t", "new", "INT", 1)], schema)
    assert sorted((r.column_name, r.drift) for r in quality.schema_drift(e, a).collect()) == [("gone", "REMOVED"), ("new", "ADDED")]
    assert quality.contract_violations(e, a, "DISABLED").count() == 0 and quality.contract_violations(e, a, "WARN").where("severity = 'WARNING'").count() == 1


def test_closure_of_all_seeds_is_the_union(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (9, 9)], "src long, dst long")
    one = lambda *s: {tuple(r) for r in graph.closure(e, spark.createDataFrame([(x,) for x in s], "seed long")).collect()}
    assert one(1, 2, 3) == one(1) | one(2) | one(3) and (1, 3, 1) in one(1)
    assert graph.cyclic_nodes(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (0, 1)], "src long, dst long")).count() == 3


def test_catalog_columns(spark):
    spark.range(1).createOrReplaceTempView("described")
    assert [r.column_name for r in quality.describe(spark, "described").collect()] == ["id"]


def test_kpis_gather_no_array(spark):
    values = {"a": [5.0], "b": [float(k * k % 97) for k in range(400)] + [1e9], "c": [2.0] * 50 + [None], "d": [None], None: [1.0, 3.0]}
    m = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "kpi string, value double")
    got = {r.kpi: (r.p0, r.p95, r.p100) for r in stats.floor_ranks(m, ["kpi"], "value", {"p0": 0.0, "p95": 0.95, "p100": 1.0}).collect()}
    own = {k: sorted(v for v in vs if v is not None) for k, vs in values.items()}
    assert got == {k: tuple(vs[min(int(len(vs) * p), len(vs) - 1)] for p in (0.0, 0.95, 1.0)) for k, vs in own.items() if vs}
    t = spark.createDataFrame([("x", 10.0, 0.0, 1)], "kpi string, target double, warn double, lower_is_better int")
    assert "collect_list" not in stats.kpi_report(m, t)._jdf.queryExecution().optimizedPlan().toString()
