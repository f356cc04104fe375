"""Inputs of the registered queries: views over the supplied tables, as DataFrames and as DuckDB text.

Clocks are pinned, as all functions of this library take the time as a parameter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"  # of events
AS_OF = "2001-08-02"  # of orders
# Prices and limits of the tiers; cluster rates a second.
TIER_PRICE = {"community": 0, "team": 49, "enterprise": 199}
TIER_LIMITS = [("community", "plan_run", 100), ("community", "ai_call", 50), ("community", "api_request", 1000), ("team", "plan_run", 1000), ("team", "ai_call", 500), ("team", "api_request", 10000)]
RATES = [("small", 0.0007), ("medium", 0.0028), ("large", 0.0112)]
TENANTS = [("t0", "community", 1200, None, None), ("t1", "team", None, 5.0, 120.0), ("t2", "enterprise", None, None, None), ("t3", "team", None, 900.0, 20000.0), ("t4", "community", None, None, None)]
TENANT_SCHEMA = "tenant_id string, tier string, plan_quota int, daily_budget double, monthly_budget double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(v: object) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def values(rows: list[tuple], columns: str) -> str:
    return f"(select * from (values {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) as v({columns}))"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def tenants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TENANTS, TENANT_SCHEMA)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e, u, i = events(spark, sf), F.col("user_id"), F.col("event_id")
    failed = (F.col("event_type") == "error") | ((u % 10 < 2) & F.col("event_type").isin("click", "view"))
    e = e.withColumn("status", F.when(failed, "FAIL").when(i % 97 == 0, "RUNNING").otherwise("SUCCESS"))
    done = i % 97 != 0
    return e.select(
        i.alias("run_id"), F.concat(F.lit("t"), u % 5).alias("tenant_id"), F.concat(F.lit("m"), u % 40).alias("model"), F.concat(F.lit("p"), i % 200).alias("plan_id"), "status",
        F.col("ts").alias("started_at"), F.when(done, F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000000).cast("long"))).alias("finished_at"), F.when(done, F.round(F.col("value") * 0.0028, 6)).alias("cost_usd"),
        F.when(F.col("event_type") == "error", F.when(i % 2 == 0, "timeout").otherwise("OutOfMemory")).alias("error_message"), F.col("value").alias("seconds"),
    )


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = events(spark, sf).join(runs(spark, sf).where("status <> 'RUNNING'").select(F.col("run_id").alias("event_id"), "tenant_id", "model", "status"), "event_id")
    return e.select(F.col("event_id").alias("run_id"), "tenant_id", "model", F.col("value").alias("runtime_seconds"), (k * 1000).alias("shuffle_bytes"), (k * 10).alias("input_rows"), k.alias("output_rows"), (1 + k % 8).alias("partition_count"), F.col("ts").alias("captured_at"), "event_type")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in USAGE_TYPES.items() for x in p])
    return events(spark, sf).select("event_id", F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), "user_id", kind[F.col("event_type")].alias("event_type"), (1 + F.col("event_id") % 3).alias("quantity"), F.col("ts").alias("created_at"))


USAGE_TYPES = {"view": "api_request", "click": "plan_run", "purchase": "ai_call", "signup": "model_loaded", "error": "backfill_run"}


def llm(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    n = F.length("text").cast("long")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), F.concat(F.lit("t"), F.col("conv_id") % 5).alias("tenant_id"), F.col("role").alias("call_type"), n.alias("input_tokens"), F.floor(n / 3).cast("long").alias("output_tokens"),
        ((F.col("conv_id") + F.col("turn")) % 11 != 0).alias("success"), F.expr("timestamp_micros(unix_micros(timestamp '2024-01-01 00:00:00') + (conv_id * 7 + turn) % 720 * 3600000000)").alias("created_at"), (F.col("conv_id") % 900 + 50).alias("latency_ms"),
    ).withColumn("cost_usd", F.round((F.col("input_tokens") * 3 + F.col("output_tokens") * 15) / 1e6, 6))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("dst"))
    two = p.select(F.floor(F.col("dst") / 2).alias("src"), "dst")
    three = p.where("dst >= 3 and dst % 5 = 0").select(F.floor(F.col("dst") / 3).alias("src"), "dst")
    return two.union(three).distinct()


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TRANSFORMS)), (F.col("dst") % 4 + 1).cast("int"))
    return edges(spark, sf).select(F.col("dst").alias("table"), F.concat(F.lit("c"), F.col("dst") % 3).alias("column"), F.col("src").alias("source_table"), F.concat(F.lit("c"), F.col("src") % 3).alias("source_column"), kind.alias("transform"))


TRANSFORMS = ["direct", "cast", "aggregate", "expression"]


def watermarks(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf).withColumn("d", F.to_date("o_orderdate"))
    return o.groupBy(F.col("o_custkey").alias("model"), F.year("d").alias("year")).agg(F.min("d").alias("partition_start"), F.max("d").alias("partition_end"), F.count("*").alias("row_count")).withColumn("last_updated", F.col("partition_end"))


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf).withColumn("d", F.to_date("o_orderdate"))
    c = o.groupBy(F.col("o_custkey").alias("model")).agg(F.min("d").alias("overall_start"), F.max("d").alias("overall_end"))
    status = F.element_at(F.array(F.lit("COMPLETED"), F.lit("FAILED"), F.lit("RUNNING")), (F.col("model") % 3 + 1).cast("int"))
    first = F.least(F.date_add("overall_start", 29), F.col("overall_end"))
    return c.withColumn("status", status).withColumn("completed_through", F.when(F.col("status") == "FAILED", first).when(F.col("status") == "COMPLETED", F.col("overall_end")))


def base(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).where("o_orderkey % 10 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def target(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders(spark, sf).where("o_orderkey % 10 <> 1").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"))


def observed(spark: SparkSession, sf: str) -> DataFrame:
    flip = F.when(F.col("run_id") % 13 == 0, F.when(F.col("status") == "SUCCESS", "FAIL").otherwise("SUCCESS")).otherwise(F.col("status"))
    return runs(spark, sf).where("run_id % 29 <> 0").select("run_id", flip.alias("observed"))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf).where("cost_usd is not null")
    p = F.round(F.col("cost_usd") * (1 + (F.col("run_id") % 5 - 2) / 10), 6)
    accepted = F.when(F.col("run_id") % 3 == 0, F.lit(True)).when(F.col("run_id") % 3 == 1, F.lit(False))
    out = r.select("run_id", "tenant_id", "model", "status", F.lit(0).alias("n"), p.alias("predicted"), F.col("cost_usd").alias("actual"), accepted.alias("accepted"), F.col("started_at").alias("created_at"))
    again = r.where("run_id % 4 = 0").select("run_id", "tenant_id", "model", "status", F.lit(1).alias("n"), F.round(p * 2, 6).alias("predicted"), F.col("cost_usd").alias("actual"), accepted.alias("accepted"), F.expr("started_at + interval 1 hour").alias("created_at"))
    return out.union(again)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("actual"), (F.col("n_chars") >= 600).cast("int").alias("predicted"), (F.least(F.col("n_chars"), F.lit(4000)) / 4000).alias("confidence"), F.col("lang").alias("category"))


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "event_type", F.lit("pending").alias("status"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 5 != 0).alias("handled"), F.col("ts").alias("created_at"))


# contracts of four tables: one column gone, one of another type, some under other names of their type, one that must not be null and is
SCHEMA_EXPECTED = [
    ("orders", "o_orderkey", "LONG", 0), ("orders", "o_custkey", "BIGINT", 0), ("orders", "o_orderstatus", "VARCHAR", 1), ("orders", "o_clerk", "STRING", 1), ("orders", "o_totalprice", "DECIMAL(14,4)", 0),
    ("customer", "C_CUSTKEY", "BIGINT", 0), ("customer", "c_name", "TEXT", 1), ("customer", "c_acctbal", "DOUBLE PRECISION", 1), ("amounts", "event_id", "LONG", 0), ("amounts", "user_id", "BIGINT", 0), ("amounts", "event_type", "STRING", 0), ("amounts", "amount", "DOUBLE", 0),
    ("nation", "n_nationkey", "INTEGER", 0), ("nation", "n_name", "CHAR", 0), ("nation", "n_regionkey", "INT", 1),
]
MEASURED = {"orders": ("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "orders"), "customer": ("c_custkey c_name c_nationkey c_acctbal c_mktsegment", "customer"), "nation": ("n_nationkey n_name n_regionkey", "nation"), "amounts": ("event_id user_id event_type amount", "(select event_id, user_id, event_type, case when event_id % 7 <> 0 then value end as amount from events)")}

VIEWS: dict[str, str] = {
    "v_tenants": "select tenant_id, tier, plan_quota::int as plan_quota, daily_budget::double as daily_budget, monthly_budget::double as monthly_budget from " + values(TENANTS, "tenant_id, tier, plan_quota, daily_budget, monthly_budget"),
    "v_runs": """select event_id as run_id, 't' || (user_id % 5) as tenant_id, 'm' || (user_id % 40) as model, 'p' || (event_id % 200) as plan_id,
      case when event_type = 'error' or (user_id % 10 < 2 and event_type in ('click', 'view')) then 'FAIL' when event_id % 97 = 0 then 'RUNNING' else 'SUCCESS' end as status, ts as started_at,
      case when event_id % 97 <> 0 then ts + to_microseconds(round(value * 1000000)::bigint) end as finished_at, case when event_id % 97 <> 0 then round(value * 0.0028, 6) end as cost_usd,
      case when event_type = 'error' then case when event_id % 2 = 0 then 'timeout' else 'OutOfMemory' end end as error_message, value as seconds from events""",
    "v_telemetry": """select r.run_id, r.tenant_id, r.model, e.value as runtime_seconds, k * 1000 as shuffle_bytes, k * 10 as input_rows, k as output_rows, 1 + k % 8 as partition_count, e.ts as captured_at, e.event_type
      from (select *, json_extract_string(props, '$.k')::bigint as k from events) e join v_runs r on r.run_id = e.event_id where r.status <> 'RUNNING'""",
    "v_usage": "select event_id, 't' || (user_id % 5) as tenant_id, user_id, case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in USAGE_TYPES.items()) + " end as event_type, 1 + event_id % 3 as quantity, ts as created_at from events",
    "v_llm": """select *, round((input_tokens * 3 + output_tokens * 15) / 1e6, 6) as cost_usd from (select conv_id * 1000 + turn as call_id, 't' || (conv_id % 5) as tenant_id, role as call_type, length(text) as input_tokens, length(text) // 3 as output_tokens,
      (conv_id + turn) % 11 <> 0 as success, timestamp '2024-01-01' + to_hours(((conv_id * 7 + turn) % 720)::int) as created_at, conv_id % 900 + 50 as latency_ms from conversations)""",
    "v_edges": "select distinct * from (select p_partkey // 2 as src, p_partkey as dst from part where p_partkey >= 2 union all select p_partkey // 3, p_partkey from part where p_partkey >= 3 and p_partkey % 5 = 0)",
    "v_lineage": "select dst as \"table\", 'c' || (dst % 3) as \"column\", src as source_table, 'c' || (src % 3) as source_column, list_extract([" + ", ".join(f"'{t}'" for t in TRANSFORMS) + "], (dst % 4 + 1)::int) as transform from v_edges",
    "v_watermarks": "select o_custkey as model, year(o_orderdate) as year, min(o_orderdate::date) as partition_start, max(o_orderdate::date) as partition_end, count(*) as row_count, max(o_orderdate::date) as last_updated from orders group by 1, 2",
    "v_checkpoints": """select *, case status when 'FAILED' then least(overall_start + 29, overall_end) when 'COMPLETED' then overall_end end as completed_through from
      (select o_custkey as model, min(o_orderdate::date) as overall_start, max(o_orderdate::date) as overall_end, list_extract(['COMPLETED', 'FAILED', 'RUNNING'], (o_custkey % 3 + 1)::int) as status from orders group by o_custkey)""",
    "v_base": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 0",
    "v_target": "select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 10 <> 1",
    "v_observed": "select run_id, case when run_id % 13 = 0 then case when status = 'SUCCESS' then 'FAIL' else 'SUCCESS' end else status end as observed from v_runs where run_id % 29 <> 0",
    "v_feedback": """select run_id, tenant_id, model, status, 0 as n, round(cost_usd * (1 + (run_id % 5 - 2) / 10), 6) as predicted, cost_usd as actual, case run_id % 3 when 0 then true when 1 then false end as accepted, started_at as created_at from v_runs where cost_usd is not null
      union all select run_id, tenant_id, model, status, 1, round(round(cost_usd * (1 + (run_id % 5 - 2) / 10), 6) * 2, 6), cost_usd, case run_id % 3 when 0 then true when 1 then false end, started_at + interval 1 hour from v_runs where cost_usd is not null and run_id % 4 = 0""",
    "v_predictions": "select doc_id, quality as actual, (n_chars >= 600)::int as predicted, least(n_chars, 4000) / 4000 as confidence, lang as category from labels join documents using (doc_id)",
    "v_outbox": "select event_id, event_type, 'pending' as status, event_id % 4 as attempts, event_id % 5 <> 0 as handled, ts as created_at from events",
    "v_expected": "select * from " + values(SCHEMA_EXPECTED, "table_name, column_name, data_type, nullable"),
    "v_actual": " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, any_value(typeof({c})) as data_type, (count(*) filter ({c} is null) > 0)::int as nullable from {src}" for t, (cols, src) in MEASURED.items() for c in cols.split()),
}


def with_views(sql: str) -> str:
    """sql after a WITH of the views it names, and of those that they name."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                visit(VIEWS[v])
                need.append(v)

    visit(sql)
    if not need:
        return sql
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in need)
    rest = sql.strip()
    recursive = rest.lower().startswith("with recursive")
    if m := re.match(r"with(\s+recursive)?\s", rest, re.I):
        return f"with {'recursive ' if recursive else ''}{head}, {rest[m.end() :]}"
    return f"with {head} {rest}"
