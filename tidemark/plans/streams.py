"""Streaming flows, drained so that they end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.materialize import scratch
from ..registry import query
from ..streaming import flows as S

SUBSCRIBERS = [("billing", ["purchase", "signup"]), ("alerts", ["error"]), ("all", ["click", "view", "error", "signup", "purchase"])]


@query("select event_id, user_id, event_type from events")
def stream_usage_ingest(spark: SparkSession, sf: str) -> DataFrame:
    sink = scratch(spark)
    stream = S.read(spark, sf, "events", "ts")
    S.usage_ingest(stream.union(stream), sink, scratch(spark)).awaitTermination()
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as v from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events)")
def stream_hourly_usage(spark: SparkSession, sf: str) -> DataFrame:
    """The hours that the watermark has passed once all input is read."""
    return S.drain(S.hourly_usage(S.read(spark, sf, "events", "ts"))).withColumn("v", F.round("v", 4))


@query("select 't' || (user_id % 5) as tenant_id, strftime(ts, '%Y-%m') as month, count(*) as n from events group by 1, 2")
def stream_quota(spark: SparkSession, sf: str) -> DataFrame:
    e = S.read(spark, sf, "events", "ts")
    totals = e.groupBy(F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return S.upsert_batches(totals, ["tenant_id", "month"])


STEP_SQL = "case when handled then 'delivered' when attempts + 1 >= 3 then 'failed' else 'pending' end as status, case when handled then attempts else attempts + 1 end as attempts"


@query(f"select event_id, {STEP_SQL} from v_outbox")
def outbox_step(spark: SparkSession, sf: str) -> DataFrame:
    return S.outbox_step(fx.outbox(spark, sf)).select("event_id", "status", "attempts")


def _outbox_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = S.read(spark, sf, "events", "ts")
    return e.select("event_id", "event_type", F.lit("pending").alias("status"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 5 != 0).alias("handled"), F.col("ts").alias("created_at"))


@query(f"""with o as (select *, row_number() over (order by created_at, event_id) as rn, least(500, greatest(100, 2 * count(*) over ())) as size from v_outbox)
  select event_id, status, attempts from (select event_id, {STEP_SQL} from o where rn <= size union all select event_id, status, attempts from o where rn > size)""")
def stream_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """The outbox after one delivery step: its oldest rows were tried, as many as a step takes."""
    return S.deliver(_outbox_stream(spark, sf)).select("event_id", "status", "attempts")


@query("select event_id, subscriber from v_outbox join (select 'billing' as subscriber, ['purchase', 'signup'] as types union all select 'alerts', ['error'] union all select 'all', ['click', 'view', 'error', 'signup', 'purchase']) on list_contains(types, event_type)")
def event_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """A stream-static join, drained."""
    return S.drain(S.fan_out(_outbox_stream(spark, sf), spark.createDataFrame(SUBSCRIBERS, "subscriber string, event_types array<string>")))


def _telemetry_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Finished runs as they arrive, as fixtures.telemetry() has them."""
    e, u, i = S.read(spark, sf, "events", "ts"), F.col("user_id"), F.col("event_id")
    failed = (F.col("event_type") == "error") | ((u % 10 < 2) & F.col("event_type").isin("click", "view"))
    return e.where(failed | (i % 97 != 0)).select(F.concat(F.lit("m"), u % 40).alias("model"), F.col("value").alias("runtime_seconds"), F.col("ts").alias("captured_at"))


def _within(found: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and whether each quantile of found is within the sketch's rank error among rows (keys, v)."""
    j = found.join(rows, keys)
    out = j.groupBy(*keys, "n", "p50", "p95").agg(F.count("*").alias("exact n"), *[F.count_if(F.col("v") < F.col(p)).alias(f"below {p}") for p in ("p50", "p95")], *[F.count_if(F.col("v") <= F.col(p)).alias(f"upto {p}") for p in ("p50", "p95")])
    room = lambda p, x: (F.col(f"below {p}") <= F.col("n") * (x + S.RANK_ERROR) + 1) & (F.col(f"upto {p}") >= F.col("n") * (x - S.RANK_ERROR) - 1)
    return out.select(*keys, F.col("exact n").alias("n"), (room("p50", 0.5) & (F.col("n") == F.col("exact n"))).alias("p50_within"), room("p95", 0.95).alias("p95_within"))


CLOSED = "date_trunc('hour', captured_at) + interval 1 hour <= (select max(captured_at) - interval 1 hour from v_telemetry)"
SHARES = {"p50": 0.5, "p95": 0.95}


def _sketches(spark: SparkSession, sf: str) -> DataFrame:
    return S.drain(S.quantile_sketches(_telemetry_stream(spark, sf), ["model"], "captured_at", "runtime_seconds"))


def _exact(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    return fx.telemetry(spark, sf).select("model", F.date_trunc("hour", "captured_at").alias("hour"), F.date_trunc(unit, "captured_at").alias("bucket"), F.col("runtime_seconds").alias("v"))


@query(f"select model, date_trunc('hour', captured_at) as bucket, count(*) as n, true as p50_within, true as p95_within from v_telemetry where {CLOSED} group by 1, 2")
def stream_telemetry_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Quantile sketches of closed hours, held against the exact rows."""
    found = S.sketch_quantiles(_sketches(spark, sf), SHARES)
    return _within(found, _exact(spark, sf, "hour").drop("hour"), ["model", "bucket"])


@query(f"select model, date_trunc('day', captured_at) as bucket, count(*) as n, true as p50_within, true as p95_within from v_telemetry where {CLOSED} group by 1, 2")
def stream_telemetry_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Days merged from the sketches of their closed hours, held against the exact rows of those hours."""
    hours = _sketches(spark, sf)
    rows = _exact(spark, sf, "day").join(hours.select("model", F.col("bucket").alias("hour")), ["model", "hour"], "left_semi").drop("hour")
    return _within(S.sketch_quantiles(S.merged_sketches(hours, ["model"], "day"), SHARES), rows, ["model", "bucket"])
