"""Cost, usage, quota, invoice and run-history reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import reports as R
from ..operators import runstats as W
from ..operators.select import latest, top_n
from ..operators.stats import quantiles
from ..registry import query

SINCE, UNTIL = "2024-01-05", "2024-01-25"
RANGE = f"started_at >= '{SINCE}' and started_at < '{UNTIL}'"
COST = "round(coalesce(sum(cost_usd), 0), 4) as cost, count(*) as runs"


@query(f"select model, {COST} from v_runs where {RANGE} group by 1")
def cost_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return R.cost_by(fx.runs(spark, sf), F.col("model"), "model", SINCE, UNTIL)


def _by_time(unit: str):
    return lambda spark, sf: R.cost_by(fx.runs(spark, sf), R.bucket("started_at", unit), "bucket", SINCE, UNTIL)


for _unit in R.BUCKETS:
    _f = _by_time(_unit)
    _f.__name__ = f"cost_by_{_unit}"
    query(f"select date_trunc('{_unit}', started_at)::date as bucket, {COST} from v_runs where {RANGE} group by 1")(_f)


@query("select user_id as actor, event_type as action, count(*) as n, max(ts) as last_at from events group by 1, 2")
def usage_by_actor(spark: SparkSession, sf: str) -> DataFrame:
    return fx.events(spark, sf).groupBy(F.col("user_id").alias("actor"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


LLM = "count(*) as calls, round(sum(cost_usd), 4) as cost, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens"


@query(f"select call_type, {LLM} from v_llm group by 1")
def llm_by_call_type(spark: SparkSession, sf: str) -> DataFrame:
    return R.llm_by_call_type(fx.llm(spark, sf))


@query("select date_trunc('week', created_at)::date as bucket, count(*) as calls, round(sum(cost_usd), 4) as cost from v_llm group by 1")
def llm_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return fx.llm(spark, sf).groupBy(R.bucket("created_at", "week").alias("bucket")).agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost"))


@query("select created_at::date as bucket, event_type, sum(quantity)::bigint as quantity, count(*) as events from v_usage group by 1, 2")
def usage_by_type_time(spark: SparkSession, sf: str) -> DataFrame:
    return R.usage_over_time(fx.usage(spark, sf), "day")


@query("select model, round(sum(cost_usd), 4) as cost, count(*) as runs from v_runs group by 1 union all select 'TOTAL', round(sum(cost_usd), 4), count(*) from v_runs")
def platform_cost(spark: SparkSession, sf: str) -> DataFrame:
    """One pass: the grand total comes from a rollup."""
    g = fx.runs(spark, sf).rollup("model").agg(F.round(F.sum("cost_usd"), 4).alias("cost"), F.count("*").alias("runs"), F.grouping("model").alias("all"))
    return g.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("model")).alias("model"), "cost", "runs")


@query("select strftime(date_trunc('week', started_at), '%Y-%m-%d') as bucket, round(sum(cost_usd), 4) as cost, count(*) as runs from v_runs group by 1 union all select 'TOTAL', round(sum(cost_usd), 4), count(*) from v_runs")
def platform_cost_by_week(spark: SparkSession, sf: str) -> DataFrame:
    """As platform_cost, by time bucket."""
    r = fx.runs(spark, sf).withColumn("bucket", F.date_format(F.date_trunc("week", "started_at"), "yyyy-MM-dd"))
    g = r.rollup("bucket").agg(F.round(F.sum("cost_usd"), 4).alias("cost"), F.count("*").alias("runs"), F.grouping("bucket").alias("all"))
    return g.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("bucket")).alias("bucket"), "cost", "runs")


@query("select (select count(*) from v_tenants) as tenants, count(distinct tenant_id) as active, (select count(*) from v_usage) as events, count(*) as runs, round(sum(cost_usd), 4) as cost from v_runs")
def platform_overview(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.tenants(spark).agg(F.count("*").alias("tenants"))
    r = fx.runs(spark, sf).agg(F.countDistinct("tenant_id").alias("active"), F.count("*").alias("runs"), F.round(F.sum("cost_usd"), 4).alias("cost"))
    u = fx.usage(spark, sf).agg(F.count("*").alias("events"))
    return r.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(u))  # one-row aggregates


@query("with t as (select case c_mktsegment when 'BUILDING' then 'team' when 'MACHINERY' then 'enterprise' when 'FURNITURE' then 'trial' else 'community' end as tier from customer), m as (select tier, count(*) as tenants, count(*) * case tier when 'team' then 49 when 'enterprise' then 199 else 0 end as mrr from t group by 1) select * from m union all select 'TOTAL', sum(tenants), sum(mrr) from m")
def mrr_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Customers play the tenants, their segments the tiers; one tier has no price."""
    segment = F.col("c_mktsegment")
    t = fx.table(spark, sf, "customer").select(F.when(segment == "BUILDING", "team").when(segment == "MACHINERY", "enterprise").when(segment == "FURNITURE", "trial").otherwise("community").alias("tier"))
    price = F.create_map(*[F.lit(x) for p in fx.TIER_PRICE.items() for x in p])
    m = t.groupBy("tier").agg(F.count("*").alias("tenants")).withColumn("mrr", F.col("tenants") * F.coalesce(price[F.col("tier")], F.lit(0)))
    return m.union(m.agg(F.lit("TOTAL"), F.sum("tenants"), F.sum("mrr")))


@query("""select round(avg((status = 'FAIL')::int), 6) as error_rate, round(quantile_cont(seconds, 0.95) filter (status <> 'RUNNING'), 6) as p95_runtime, (select round(count(*) filter (accepted) / count(*), 6) from v_feedback) as acceptance,
  (select round(avg(1 - abs(predicted - actual) / greatest(predicted, actual, 0.01)), 6) from v_feedback) as avg_accuracy from v_runs""")
def platform_health(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance is over all feedback rows, undecided ones included."""
    r = fx.runs(spark, sf).agg(F.round(F.avg((F.col("status") == "FAIL").cast("int")), 6).alias("error_rate"), F.lit(1).alias("one"))
    p = quantiles(fx.runs(spark, sf).where("status <> 'RUNNING'"), [], "seconds", {"p": 0.95}).select(F.round("p", 6).alias("p95_runtime"))
    f = fx.feedback(spark, sf).agg(F.round(F.count_if("accepted") / F.count("*"), 6).alias("acceptance"), F.round(F.avg(W.cost_accuracy("predicted", "actual")), 6).alias("avg_accuracy"))
    return r.drop("one").crossJoin(F.broadcast(p)).crossJoin(F.broadcast(f))  # one-row aggregates


@query("select tenant_id, event_type, sum(quantity)::bigint as quantity from v_usage where created_at >= '2024-01-01' and created_at < '2024-02-01' group by 1, 2")
def monthly_usage(spark: SparkSession, sf: str) -> DataFrame:
    return R.within(fx.usage(spark, sf), "created_at", "2024-01-01", "2024-02-01").groupBy("tenant_id", "event_type").agg(F.sum("quantity").alias("quantity"))


@query(f"""with used as (select tenant_id, event_type, sum(quantity)::bigint as used from v_usage where created_at >= '2024-01-01' and created_at < '2024-02-01' group by 1, 2),
  l as (select * from used join v_tenants using (tenant_id) left join (select * from {fx.values(fx.TIER_LIMITS, 'tier, event_type, tier_limit')}) using (tier, event_type)), x as (select *, coalesce(case when event_type = 'plan_run' then plan_quota end, tier_limit)::bigint as limit_value from l)
  select tenant_id, event_type, used, limit_value, case when limit_value is not null then greatest(0, limit_value - used) end as remaining, case when limit_value > 0 then round(used / limit_value * 100, 1) end as percent from x""")
def quota_usage(spark: SparkSession, sf: str) -> DataFrame:
    return R.quota_usage(fx.usage(spark, sf), fx.tenants(spark), spark.createDataFrame(fx.TIER_LIMITS, "tier string, event_type string, tier_limit int"), "2024-01-01", "2024-02-01")


@query("""select tenant_id, round(coalesce(sum(cost_usd) filter (started_at >= '2024-01-30'), 0), 4) as daily, round(coalesce(sum(cost_usd), 0), 4) as monthly, coalesce(round(coalesce(sum(cost_usd) filter (started_at >= '2024-01-30'), 0), 4) >= daily_budget, false) as over_daily,
  coalesce(round(coalesce(sum(cost_usd), 0), 4) >= monthly_budget, false) as over_monthly from v_runs join v_tenants using (tenant_id) group by tenant_id, daily_budget, monthly_budget""")
def budget_status(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("started_at") >= F.lit("2024-01-30").cast("timestamp")
    s = fx.runs(spark, sf).groupBy("tenant_id").agg(F.round(F.coalesce(F.sum(F.when(day, F.col("cost_usd"))), F.lit(0.0)), 4).alias("daily"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("monthly")).join(fx.tenants(spark), "tenant_id")
    over = lambda a, b: F.coalesce(F.col(a) >= F.col(b), F.lit(False))
    return s.select("tenant_id", "daily", "monthly", over("daily", "daily_budget").alias("over_daily"), over("monthly", "monthly_budget").alias("over_monthly"))


@query(f"select {LLM}, round(avg(latency_ms), 6) as avg_latency, round(avg(success::int), 6) as success_rate from v_llm")
def llm_usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return fx.llm(spark, sf).agg(*R.llm_totals(), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"))


@query("select call_id, round(input_tokens * 3 / 1e6 + output_tokens * 15 / 1e6, 8) as cost from v_llm")
def llm_call_cost(spark: SparkSession, sf: str) -> DataFrame:
    return fx.llm(spark, sf).select("call_id", F.round(F.col("input_tokens") * 3 / 1e6 + F.col("output_tokens") * 15 / 1e6, 8).alias("cost"))


@query("select round(avg(1 - abs(predicted - actual) / greatest(predicted, actual, 0.01)), 6) as avg_accuracy, round(count(*) filter (accepted) / count(accepted), 6) as acceptance, count(accepted) as decided, count(*) as total from v_feedback")
def feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance is over decided rows only."""
    return fx.feedback(spark, sf).agg(F.round(F.avg(W.cost_accuracy("predicted", "actual")), 6).alias("avg_accuracy"), F.round(F.count_if("accepted") / F.count("accepted"), 6).alias("acceptance"), F.count("accepted").alias("decided"), F.count("*").alias("total"))


# Prices of an invoice.
PRICES = {"plan_run": 0.05, "ai_call": 0.02, "api_request": 0.001}
LINES_SQL = f"""select * from (select tenant_id, event_type as item, sum(quantity)::double as quantity, round(sum(quantity) * case event_type {' '.join(f"when '{k}' then {v}::double" for k, v in PRICES.items())} end, 2) as amount from v_usage where event_type in ('plan_run', 'ai_call', 'api_request') group by 1, 2
  union all select tenant_id, 'compute_cost', count(cost_usd)::double, round(sum(cost_usd), 2) from v_runs group by 1 union all select tenant_id, 'llm_cost', count(cost_usd)::double, round(sum(cost_usd), 2) from v_llm group by 1) where amount > 0"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.invoice_lines(fx.usage(spark, sf), fx.runs(spark, sf), fx.llm(spark, sf), PRICES)


@query(LINES_SQL)
def invoice_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf)


@query(f"select 'INV-202401-' || lpad(row_number() over (order by tenant_id)::varchar, 4, '0') as number, tenant_id, round(sum(amount), 2) as total, list(item order by item) as items from ({LINES_SQL}) group by tenant_id")
def invoice_totals(spark: SparkSession, sf: str) -> DataFrame:
    g = _lines(spark, sf).groupBy("tenant_id").agg(F.round(F.sum("amount"), 2).alias("total"), F.sort_array(F.collect_list("item")).alias("items"))
    n = F.row_number().over(Window.partitionBy(F.lit("202401")).orderBy("tenant_id"))  # one row a tenant and month
    return g.select(F.concat(F.lit("INV-202401-"), F.lpad(n.cast("string"), 4, "0")).alias("number"), "tenant_id", "total", "items")


@query("select tenant_id, count(*) as n from v_usage where created_at >= '2024-01-30' and created_at < '2024-01-31' group by 1")
def metered_usage(spark: SparkSession, sf: str) -> DataFrame:
    return R.within(fx.usage(spark, sf), "created_at", "2024-01-30", "2024-01-31").groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("select event_type, sum(quantity)::bigint as quantity from v_usage where tenant_id = 't1' group by 1")
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fx.usage(spark, sf).where("tenant_id = 't1'").groupBy("event_type").agg(F.sum("quantity").alias("quantity"))


@query("select m as model, round(coalesce(avg((status = 'FAIL')::int), 0), 6) as failure_rate from (select 'm' || unnest(range(0, 45)) as m) left join v_runs on model = m group by 1")
def failure_rates(spark: SparkSession, sf: str) -> DataFrame:
    return W.failure_rates(spark.range(45).select(F.concat(F.lit("m"), "id").alias("model")), fx.runs(spark, sf))


@query("select model, count(*) filter (status = 'SUCCESS') as succeeded, count(*) filter (status = 'FAIL') as failed, count(*) filter (status = 'RUNNING') as running from v_runs group by 1")
def runs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.runs(spark, sf).groupBy("model").pivot("status", ["SUCCESS", "FAIL", "RUNNING"]).count().na.fill(0)
    return p.select("model", F.col("SUCCESS").alias("succeeded"), F.col("FAIL").alias("failed"), F.col("RUNNING").alias("running"))


@query("""select round(c, 4) as current_total, round(p, 4) as previous_total, round(round(c, 4) - round(p, 4), 4) as change, case when p <> 0 then round((round(c, 4) - round(p, 4)) / round(p, 4) * 100, 2) end as percent, case when c > p then 'up' when c < p then 'down' else 'flat' end as direction
  from (select coalesce(sum(cost_usd) filter (started_at >= '2024-01-16' and started_at < '2024-01-31'), 0) as c, coalesce(sum(cost_usd) filter (started_at >= '2024-01-01' and started_at < '2024-01-16'), 0) as p from v_runs)""")
def period_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return R.compare_periods(fx.runs(spark, sf), F.col("cost_usd"), "started_at", ("2024-01-16", "2024-01-31"), ("2024-01-01", "2024-01-16"))


@query("""select c as current_total, p as previous_total, c - p as change, case when p <> 0 then round((c - p) / p * 100, 2) end as percent, case when c > p then 'up' when c < p then 'down' else 'flat' end as direction
  from (select count(*) filter (created_at >= '2024-01-16' and created_at < '2024-01-31')::double as c, count(*) filter (created_at >= '2024-01-01' and created_at < '2024-01-16')::double as p from v_usage)""")
def usage_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """As period_comparison, of usage by its rows."""
    return R.compare_periods(fx.usage(spark, sf), F.lit(1.0), "created_at", ("2024-01-16", "2024-01-31"), ("2024-01-01", "2024-01-16"))


@query("select plan_id, round(coalesce(sum(cost_usd), 0), 4) as cost, count(*) as steps, count(*) filter (status = 'FAIL') as failed, count(error_message) as errors from v_runs group by 1")
def plan_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fx.runs(spark, sf).groupBy("plan_id").agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"), F.count("*").alias("steps"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count("error_message").alias("errors"))


@query("""select tenant_id, tier, coalesce(runs, 0) as runs, coalesce(cost, 0) as cost, coalesce(events, 0) as events, coalesce(calls, 0) as calls from v_tenants left join (select tenant_id, count(*) as runs, round(sum(cost_usd), 4) as cost from v_runs group by 1) using (tenant_id)
  left join (select tenant_id, count(*) as events from v_usage group by 1) using (tenant_id) left join (select tenant_id, count(*) as calls from v_llm group by 1) using (tenant_id)""")
def tenant_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.runs(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("runs"), F.round(F.sum("cost_usd"), 4).alias("cost"))
    u = fx.usage(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("events"))
    c = fx.llm(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("calls"))
    out = fx.tenants(spark).select("tenant_id", "tier")
    for part in (r, u, c):
        out = out.join(part, "tenant_id", "left")
    return out.na.fill(0)


@query("select run_id, model, seconds, round(greatest(seconds, 0) * case run_id % 3 when 0 then 0.0007 when 1 then 0.0028 else 0.0112 end, 6) as cost from v_runs")
def run_cost(spark: SparkSession, sf: str) -> DataFrame:
    size = F.element_at(F.array(*[F.lit(n) for n, _ in fx.RATES]), (F.col("run_id") % 3 + 1).cast("int"))
    return fx.runs(spark, sf).select("run_id", "model", "seconds", W.run_cost(F.col("seconds"), size, dict(fx.RATES)).alias("cost"))


@query("""select model, round(avg(seconds), 6) as avg_runtime, round(avg(cost_usd), 6) as avg_cost, count(*) as n from (select *, row_number() over (partition by model order by started_at desc, run_id desc) as rn from v_runs where status <> 'RUNNING' and finished_at is not null) where rn <= 30 group by 1""")
def run_stats_last30(spark: SparkSession, sf: str) -> DataFrame:
    done = fx.runs(spark, sf).where("status <> 'RUNNING' and finished_at is not null")
    return W.last_n_stats(done, 30)


@query("""select model, count(*) filter (ok = 0)::bigint as consecutive_failures from (select *, sum((status <> 'FAIL')::int) over (partition by model order by started_at desc, run_id desc) as ok, row_number() over (partition by model order by started_at desc, run_id desc) as rn from v_runs) where rn <= 20 group by 1""")
def consecutive_failures(spark: SparkSession, sf: str) -> DataFrame:
    return W.consecutive_failures(fx.runs(spark, sf), 20)


SUMMARY_SQL = """select *, round((recent_avg - avg_runtime) / avg_runtime, 6) as trend from (select model, count(*) as total, count(*) filter (status = 'FAIL') as failed, count(*) filter (started_at >= timestamp '2024-01-31' - interval 7 day) as recent, count(*) filter (status = 'FAIL' and started_at >= timestamp '2024-01-31' - interval 7 day) as recent_failed,
  round(avg(seconds) filter (status <> 'RUNNING'), 6) as avg_runtime, round(avg(seconds) filter (status <> 'RUNNING' and started_at >= timestamp '2024-01-31' - interval 7 day), 6) as recent_avg, round(epoch(timestamp '2024-01-31' - max(started_at) filter (status = 'SUCCESS')) / 3600, 6) as hours_since_success,
  case when arg_max(status, struct_pack(a := started_at, b := run_id)) = 'FAIL' then arg_max(coalesce(error_message, ''), struct_pack(a := started_at, b := run_id)) end as last_error from v_runs group by model)"""


@query(SUMMARY_SQL)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return W.run_summary(fx.runs(spark, sf), fx.NOW)


@query("select model, run_id, finished_at from (select *, row_number() over (partition by model order by finished_at desc nulls last, run_id) as rn from v_runs) where rn <= 5")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return top_n(fx.runs(spark, sf), ["model"], [F.col("finished_at").desc_nulls_last(), F.col("run_id")], 5).select("model", "run_id", "finished_at")


@query("""select run_id, predicted, accepted from (select *, row_number() over (partition by run_id order by created_at desc, n desc) as rn from v_feedback) where rn = 1 union all select run_id, null, null from v_runs where cost_usd is null""")
def feedback_outcome_join(spark: SparkSession, sf: str) -> DataFrame:
    newest = latest(fx.feedback(spark, sf), ["run_id"], [F.col("created_at").desc(), F.col("n").desc()]).select("run_id", "predicted", "accepted")
    return fx.runs(spark, sf).select("run_id").join(newest, "run_id", "left")


@query("select run_id, predicted, actual from v_feedback where predicted is not null and actual is not null and accepted is not null order by created_at desc, run_id desc, n desc limit 500")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.feedback(spark, sf).where("predicted is not null and actual is not null and accepted is not null").orderBy(F.desc("created_at"), F.desc("run_id"), F.desc("n")).limit(500).select("run_id", "predicted", "actual")


@query("select run_id, n, round(case when predicted <= 0 and actual <= 0 then 1 else greatest(0, least(1, 1 - abs(predicted - actual) / greatest(predicted, actual, 0.01))) end, 6) as cost_accuracy, round(case when status = 'SUCCESS' then 1 - (run_id % 11) / 10 else (run_id % 11) / 10 end, 6) as risk_accuracy from v_feedback")
def prediction_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    risk = (F.col("run_id") % 11) / 10
    return fx.feedback(spark, sf).select("run_id", "n", F.round(W.cost_accuracy("predicted", "actual"), 6).alias("cost_accuracy"), F.round(F.when(F.col("status") == "SUCCESS", 1 - risk).otherwise(risk), 6).alias("risk_accuracy"))


@query("""select status, count(*) as n from (select user_id, case when count(*) filter (event_type = 'error') * 5 > count(*) * 1.3 then 'churning' when count(*) filter (event_type = 'error') * 5 > count(*) then 'at_risk' else 'active' end as status from events group by 1) group by 1""")
def health_summary(spark: SparkSession, sf: str) -> DataFrame:
    share = F.count_if(F.col("event_type") == "error") * 5
    s = F.when(share > F.count("*") * 1.3, "churning").when(share > F.count("*"), "at_risk").otherwise("active")
    return fx.events(spark, sf).groupBy("user_id").agg(s.alias("status")).groupBy("status").agg(F.count("*").alias("n"))
