"""Statistics, scores and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import runstats as W
from ..operators import stats as S
from ..registry import query
from .reports import SUMMARY_SQL

ANOMALY = f"""with l as (select user_id, arg_max(value, struct_pack(a := ts, b := event_id)) as latest from events group by 1),
  g as (select user_id, count(*) as n, avg(value) as mu, stddev_pop(value) as sd, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, any_value(latest) as latest, count(*) filter (value < latest) as below, count(*) filter (value = latest) as eq from events join l using (user_id) group by 1 having count(*) >= 3),
  z as (select *, case when sd > 0 then (latest - mu) / sd else 0 end as z, latest < q1 - 1.5 * (q3 - q1) or latest > q3 + 1.5 * (q3 - q1) as outside from g), a as (select *, abs(z) >= 2 or outside as odd from z)
  select user_id, n, round(latest, 4) as latest, round(z, 4) as z, round((below + 0.5 * eq) / n * 100, 2) as percentile, odd as is_anomaly, case when odd then case when z > 0 then 'spike' else 'drop' end end as kind, case when odd then case when abs(z) >= 4 then 'critical' when abs(z) >= 3 then 'major' else 'minor' end end as severity from a"""


@query(ANOMALY)
def cost_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return S.cost_anomaly(fx.events(spark, sf), "user_id", "value", [F.col("ts").desc(), F.col("event_id").desc()])


FORECAST = """with h as (select user_id, list(value::double order by ts, event_id, value) as x from events where value is not null group by 1),
  f as (select user_id, len(x) as n, x[1] as x0, list_reduce(list_transform(x, lambda v: struct_pack(v := v, s := v, sum_s := v, e := 0::double, e2 := 0::double)), lambda a, p: struct_pack(v := p.v, s := 0.3::double * p.v + 0.7::double * a.s, sum_s := a.sum_s + 0.3::double * p.v + 0.7::double * a.s, e := a.e + abs(p.v - a.s), e2 := a.e2 + (p.v - a.s) * (p.v - a.s))) as a from h),
  m as (select user_id, a.s as s, case when n > 1 then 1.96 * sqrt(greatest(0, a.e2 / (n - 1) - (a.e / (n - 1)) * (a.e / (n - 1)))) * sqrt(7) else a.s * 3.5 end as margin, case when n > 1 and a.sum_s <> 0 then (a.s - x0) / (n - 1) / (a.sum_s / n) else 0 end as slope from f),
  out as (select user_id, round(s, 4) as forecast, round(s * 7, 4) as next_7d, round(s * 30, 4) as next_30d, round(greatest(0, s * 7 - margin), 4) as lower, round(s * 7 + margin, 4) as upper, case when slope > 0.05 then 'increasing' when slope < -0.05 then 'decreasing' else 'stable' end as trend from m) """


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    return S.ewma_forecast(fx.events(spark, sf), "user_id", "value", ["ts", "event_id"])


@query(FORECAST + "select * from out")
def cost_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(spark, sf)


@query(FORECAST + "select count(*) as keys, round(sum(next_7d), 2) as next_7d, round(sum(next_30d), 2) as next_30d, case when count(*) filter (trend = 'increasing') * 2 > count(*) then 'increasing' when count(*) filter (trend = 'decreasing') * 2 > count(*) then 'decreasing' else 'stable' end as trend from out")
def cost_forecast_total(spark: SparkSession, sf: str) -> DataFrame:
    return S.forecast_total(_forecast(spark, sf))


@query("""with r as (select *, row_number() over (partition by model order by started_at desc, run_id desc) as rn from v_runs where cost_usd is not null), g as (select model, coalesce(avg(cost_usd) filter (started_at >= timestamp '2024-01-31' - interval 7 day), 0) as r, avg(cost_usd) as h from r where rn <= 50 group by 1),
  c as (select *, case when h > 0.001 then (r - h) / h when r > 0.001 then 1.0 else 0.0 end as c from g) select model, round(c, 6) as change, case when c > 0.05 then 'up' when c < -0.05 then 'down' else 'flat' end as direction, round(r * 30, 4) as monthly, c > 0.3 as alert from c""")
def cost_trend(spark: SparkSession, sf: str) -> DataFrame:
    return S.cost_trend(fx.runs(spark, sf), fx.NOW)


RISK = f"""with s as ({SUMMARY_SQL}), c as (select model, count(*) filter (ok = 0) as cf from (select *, sum((status <> 'FAIL')::int) over (partition by model order by started_at desc, run_id desc) as ok, row_number() over (partition by model order by started_at desc, run_id desc) as rn from v_runs) where rn <= 20 group by 1),
  h as (select model, round(avg(shuffle_bytes), 6) as avg_shuffle, round(avg(shuffle_bytes) filter (captured_at >= timestamp '2024-01-31' - interval 7 day), 6) as rs from v_telemetry group by 1), j as (select *, failed / total as rate, case when recent > 0 then recent_failed / recent else 0 end as rr, (rs - avg_shuffle) / avg_shuffle as st from s join c using (model) left join h using (model)),
  x as (select model, 2.5 * least(rate / 0.3, 1) + case when rr > 1.5 * rate and recent_failed > 0 then 2.0 * least((rr - rate) / 0.2, 1) else 0 end + case when cf > 0 then 1.5 * least(cf / 3, 1) else 0 end + case when trend > 0.2 and avg_runtime > 0 then least(trend, 1) else 0 end
  + case when st > 0.3 and avg_shuffle > 0 then 0.8 * least(st / 1.5, 1) else 0 end + case when hours_since_success > 168 then 0.7 * least(hours_since_success / 720, 1) else 0 end + case when coalesce(last_error, '') not in ('', 'timeout') and cf > 0 then 0.5 else 0 end as score from j),
  y as (select *, 1 / (1 + exp(-greatest(-20, least(20, 1.2 * (score - 3.5))))) as p from x) select model, round(score, 6) as score, round(p, 6) as probability, case when p >= 0.6 then 'high' when p >= 0.3 then 'medium' else 'low' end as risk from y"""


@query(RISK)
def failure_risk(spark: SparkSession, sf: str) -> DataFrame:
    runs = fx.runs(spark, sf)
    week = F.col("captured_at") >= F.lit(fx.NOW).cast("timestamp") - F.expr("interval 7 days")
    shuffle = fx.telemetry(spark, sf).groupBy("model").agg(F.round(F.avg("shuffle_bytes"), 6).alias("avg_shuffle"), F.round(F.avg(F.when(week, F.col("shuffle_bytes"))), 6).alias("rs"))
    shuffle = shuffle.select("model", "avg_shuffle", ((F.col("rs") - F.col("avg_shuffle")) / F.col("avg_shuffle")).alias("shuffle_trend"))
    return S.failure_risk(W.run_summary(runs, fx.NOW).join(W.consecutive_failures(runs), "model").join(shuffle, "model", "left"))


@query("""select event_type as operation, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, min(value) as least, max(value) as most
  from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events) where rn <= 100 group by 1""")
def op_latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.latency_stats(fx.events(spark, sf).withColumnRenamed("event_type", "operation"), "operation", "value", [F.col("ts").desc(), F.col("event_id").desc()])


ROLLUP = """select model, date_trunc('{u}', captured_at) as bucket, count(*) as n, round(avg(runtime_seconds), 6) as avg_runtime, sum(shuffle_bytes)::bigint as shuffle_bytes, sum(input_rows)::bigint as input_rows, sum(output_rows)::bigint as output_rows, round(avg(partition_count), 6) as avg_partitions,
  list_sort(list(runtime_seconds))[least(floor(count(*) * 0.5)::bigint + 1, count(*))] as p50, list_sort(list(runtime_seconds))[least(floor(count(*) * 0.95::double)::bigint + 1, count(*))] as p95 from v_telemetry group by 1, 2"""


@query(ROLLUP.format(u="hour"))
def telemetry_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return S.rollup(fx.telemetry(spark, sf), "hour")


@query(ROLLUP.format(u="day"))
def telemetry_daily(spark: SparkSession, sf: str) -> DataFrame:
    return S.rollup(fx.telemetry(spark, sf), "day")


# KPIs with target, warning value and whether lower is better.
KPIS = [
    ("plan_generation_time_seconds", 30.0, 45.0, 1), ("plan_accuracy_percent", 95.0, 90.0, 0), ("cost_savings_percent", 15.0, 10.0, 0), ("semantic_diff_false_positive_rate", 10.0, 20.0, 1),
    ("api_p95_response_time_seconds", 2.0, 5.0, 1), ("planner_determinism_rate", 100.0, 100.0, 0), ("ai_suggestion_acceptance_rate", 60.0, 40.0, 0),
]
# events play the metrics: each type under one KPI, on its scale
MEASURED = {"view": ("plan_generation_time_seconds", 0.08), "click": ("plan_accuracy_percent", 0.4), "purchase": ("cost_savings_percent", 1.0), "signup": ("semantic_diff_false_positive_rate", 0.03), "error": ("planner_determinism_rate", 0.2)}
METRICS = "(select case event_type " + " ".join(f"when '{k}' then '{n}'" for k, (n, _) in MEASURED.items()) + " end as kpi, value * case event_type " + " ".join(f"when '{k}' then {x}::double" for k, (_, x) in MEASURED.items()) + " end as value from events)"


KPI_REPORT = f"""with g as (select kpi, count(value) as sample_size, list_sort(list(value))[least(floor(count(*) * 0.95::double)::bigint + 1, count(*))] as p95, avg(value) as mean from {METRICS} group by 1), j as (select *, case when lower_is_better = 1 then p95 else mean end as v from {fx.values(KPIS, 'kpi, target, warn, lower_is_better')} left join g using (kpi))
  select kpi, round(v, 6) as value, case when v is null then 'insufficient' when case when lower_is_better = 1 then v <= target else v >= target end then 'passing' when case when lower_is_better = 1 then v <= warn else v >= warn end then 'warning' else 'failing' end as status, coalesce(sample_size, 0) as sample_size from j"""


STATUSES = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("passing", "warning", "failing", "insufficient"))


@query(KPI_REPORT)
def kpi_report(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda k: F.create_map(*[F.lit(x) for name, v in MEASURED.items() for x in (name, v[k])])[F.col("event_type")]
    return S.kpi_report(fx.events(spark, sf).select(kind(0).alias("kpi"), (F.col("value") * kind(1)).alias("value")), spark.createDataFrame(KPIS, "kpi string, target double, warn double, lower_is_better int"))


@query(f"select count(*) as total, {STATUSES}, case when count(*) filter (status = 'failing') = 0 then 'healthy' when count(*) filter (status = 'failing') <= 2 then 'degraded' else 'unhealthy' end as health from ({KPI_REPORT})")
def kpi_health(spark: SparkSession, sf: str) -> DataFrame:
    return S.kpi_health(kpi_report(spark, sf))


@query("""with d as (select event_type, value * (1 + day(ts) / 30.0::double) as v, row_number() over (partition by event_type order by ts, event_id) as a, row_number() over (partition by event_type order by ts desc, event_id desc) as b, count(*) over (partition by event_type) as t from events),
  e as (select event_type, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) as q, count(*) as n from d where a <= 500 and t >= 100 group by 1), b as (select event_type, n, i, case when i = 1 then q[1] - 1e-8 else q[i] end as lo, case when i = 10 then q[11] + 1e-8 else q[i + 1] end as hi from e, (select unnest(range(1, 11)) as i)),
  c as (select b.event_type, i, any_value(n) as n, count(*) filter (a <= 500 and v >= lo and (v < hi or i = 10 and v = hi)) as ca, count(*) filter (d.b <= 500 and v >= lo and (v < hi or i = 10 and v = hi)) as cb from b join d on d.event_type = b.event_type group by 1, 2),
  p as (select event_type, sum((greatest(cb / n, 1e-6) - greatest(ca / n, 1e-6)) * ln(greatest(cb / n, 1e-6) / greatest(ca / n, 1e-6))) as psi from c group by 1) select event_type, round(psi, 6) as psi, case when psi < 0.1 then 'stable' when psi < 0.2 then 'warning' else 'drift' end as status from p""")
def psi_drift(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf).withColumn("v", F.col("value") * (1 + F.dayofmonth("ts") / F.lit(30.0)))
    return S.psi(e, "event_type", "v", ["ts", "event_id"])


@query("""with f as (select run_id, case when run_id % 3 > 0 then runtime_seconds end as r, partition_count as p, shuffle_bytes as s, run_id % 8 as w, (run_id % 10) / 10 as c from v_telemetry), x as (select *, greatest(30, coalesce(r, 300 + 30 * p) * (1 + ln(1 + s) / 50) * case when w > 1 then 1 / (1 + log2(w)) else 1 end) / 60 * 0.0028 as cost, case when c < 0.5 then 0.4 when c < 0.8 then 0.2 else 0.05 end as band from f)
  select run_id, round(cost, 6) as cost, round(cost * (1 - band), 6) as low, round(cost * (1 + band), 6) as high from x""")
def cost_predict(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("run_id")
    cols = S.cost_predict(F.when(i % 3 > 0, F.col("runtime_seconds")), F.col("partition_count"), F.col("shuffle_bytes"), i % 8, 0.0028, (i % 10) / 10)
    return fx.telemetry(spark, sf).select("run_id", *[c.alias(n) for n, c in cols.items()])


@query("""with t as (select run_id, runtime_seconds as y, output_rows::double as a, partition_count::double as b from v_telemetry), c as (select avg(y) as my, avg(a) as ma, avg(b) as mb, covar_pop(a, y) as ay, covar_pop(b, y) as yb, covar_pop(a, b) as ab, var_pop(a) as aa, var_pop(b) as bb from t),
  w as (select *, (ay * bb - yb * ab) / (aa * bb - ab * ab) as wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) as wb from c) select run_id, round(greatest(0, my + wa * (a - ma) + wb * (b - mb)), 3) as predicted from t, w""")
def cost_model_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Run times by a regression on two features that determine all others of the telemetry; the SQL solves the normal equations."""
    t = fx.telemetry(spark, sf).select("run_id", "runtime_seconds", F.col("output_rows").cast("double"), F.col("partition_count").cast("double"))
    return S.predict_cost(S.fit_cost_model(t, ["output_rows", "partition_count"], "runtime_seconds"), t).select("run_id", F.round("predicted", 3).alias("predicted"))


@query("select model, round(regr_slope(runtime_seconds, output_rows), 6) as slope, round(regr_intercept(runtime_seconds, output_rows), 6) as intercept from v_telemetry group by 1")
def cost_model_slope(spark: SparkSession, sf: str) -> DataFrame:
    return fx.telemetry(spark, sf).groupBy("model").agg(F.round(F.regr_slope("runtime_seconds", "output_rows"), 6).alias("slope"), F.round(F.regr_intercept("runtime_seconds", "output_rows"), 6).alias("intercept"))


@query("""with t as (select p_partkey, 'with x as (select * from ' || replace(p_brand, '#', '_') || ') select a, sum(b) over (partition by c) from x join ' || replace(p_type, ' ', '_') || case when p_size > 25 then ' left join x on 1 = 1' else '' end as s from part)
  select p_partkey, length(s) - length(replace(s, ' join ', ' join')) as joins, 1 as ctes, true as has_window, len(list_distinct(regexp_extract_all(upper(s), '\\b(?:FROM|JOIN)\\s+([A-Z_][A-Z0-9_.]*)', 1))) as tables, round(ln(1 + length(s)), 6) as volume from t""")
def sql_text_features(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(F.lit("with x as (select * from "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(") select a, sum(b) over (partition by c) from x join "), F.replace("p_type", F.lit(" "), F.lit("_")), F.when(F.col("p_size") > 25, " left join x on 1 = 1").otherwise(""))
    return fx.table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in S.sql_text_features(s).items()])


@query("select plan_id, model, round(coalesce(avg(seconds) filter (status <> 'RUNNING' and run_id % 2 = 0), 300) * 0.0007, 8) as estimate from v_runs group by 1, 2")
def step_cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.runs(spark, sf)
    stats = r.where("status <> 'RUNNING' and run_id % 2 = 0").groupBy("plan_id", "model").agg(F.avg("seconds").alias("avg_runtime"))
    steps = r.select("plan_id", "model").distinct()
    return steps.join(stats, ["plan_id", "model"], "left").select("plan_id", "model", F.round(F.coalesce("avg_runtime", F.lit(300.0)) * 0.0007, 8).alias("estimate"))


@query("select a as actual, p as predicted, count(doc_id) as n from (select unnest([0, 1]) as a), (select unnest([0, 1]) as p) left join v_predictions on actual = a and predicted = p group by 1, 2".replace("(select unnest([0, 1]) as a), (select unnest([0, 1]) as p) left", "((select unnest([0, 1]) as a) cross join (select unnest([0, 1]) as p)) left"))
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return S.confusion(fx.predictions(spark, sf), [0, 1])


PRF = """with c as (select l, count(*) filter (actual = l and predicted = l) as tp, count(*) filter (actual <> l and predicted = l) as fp, count(*) filter (actual = l and predicted <> l) as fn from v_predictions, (select unnest([0, 1]) as l) group by 1),
  r as (select l, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c), f as (select l::varchar as label, p, r, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from r)
  select label, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1 from (select * from f union all select 'macro', avg(p), avg(r), avg(f) from f)"""


@query(PRF)
def prf1(spark: SparkSession, sf: str) -> DataFrame:
    return S.prf1(fx.predictions(spark, sf), [0, 1])


@query("select round(avg(abs(predicted - actual)), 6) as mae, round(avg((predicted = actual)::int), 4) as accuracy from v_predictions")
def mae_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return fx.predictions(spark, sf).agg(F.round(F.coalesce(F.avg(F.abs(F.col("predicted") - F.col("actual"))), F.lit(0.0)), 6).alias("mae"), F.round(F.coalesce(F.avg((F.col("predicted") == F.col("actual")).cast("int")), F.lit(0.0)), 4).alias("accuracy"))


@query("select b as bucket, round(coalesce(avg((actual = predicted)::int), 0), 4) as accuracy, count(doc_id) as n from (select unnest([0, 1, 2, 3]) as b) left join v_predictions on b = case when confidence < 0.3 then 0 when confidence < 0.6 then 1 when confidence < 0.8 then 2 else 3 end group by 1")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return S.calibration(fx.predictions(spark, sf))


@query("select category, count(*) as n, round(avg((actual = predicted)::int), 4) as accuracy, list(doc_id order by doc_id) filter (actual <> predicted)[1:3] as failures from v_predictions group by 1".replace("list(doc_id order by doc_id) filter (actual <> predicted)[1:3]", "(list(doc_id order by doc_id) filter (actual <> predicted))[1:3]"))
def eval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.predictions(spark, sf)
    from ..operators.select import top_n

    failed = top_n(p.where("actual <> predicted"), ["category"], [F.col("doc_id")], 3).groupBy("category").agg(F.sort_array(F.collect_list("doc_id")).alias("failures"))
    g = p.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg((F.col("actual") == F.col("predicted")).cast("int")), 4).alias("accuracy"))
    return g.join(failed, "category", "left")


@query("select category, round(avg((actual = predicted)::int) - avg((actual = (confidence >= 0.3)::int)::int), 4) as delta from v_predictions group by 1")
def eval_delta(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.predictions(spark, sf)
    report = lambda pred, name: p.groupBy("category").agg(F.avg((F.col("actual") == pred).cast("int")).alias(name))
    return report(F.col("predicted"), "now").join(report((F.col("confidence") >= 0.3).cast("int"), "before"), "category").select("category", F.round(F.col("now") - F.col("before"), 4).alias("delta"))


def _recency(kind: str) -> str:
    d = f"(epoch_us(timestamp '{{now}}') - epoch_us(max(created_at) filter (event_type = '{kind}'))) / 86400000000"
    return f"round(case when {d} is null or {d} >= 30 then 0 when {d} <= 1 then 25 else 25.0::double * (30 - {d}) / 29 end, 2)"


_SCORE = "select user_id, round(" + " + ".join(map(_recency, ("api_request", "plan_run", "ai_call"))) + " + round(least(25, count(distinct event_type) filter (created_at >= timestamp '{now}' - interval 3 day) / 6 * 25), 2), 1) as score from v_usage where created_at < '{now}' group by 1"
HEALTH = f"select user_id, score, case when score >= 60 then 'active' when score >= 30 then 'at_risk' else 'churning' end as status, case when score - before > 5 then 'improving' when score - before < -5 then 'declining' else 'stable' end as trend from ({_SCORE.format(now=fx.NOW)}) left join (select user_id, score as before from ({_SCORE.format(now='2024-01-21 00:00:00')})) using (user_id)"


def _health(spark: SparkSession, sf: str) -> DataFrame:
    u = fx.usage(spark, sf)
    before = S.customer_health(u.where("created_at < '2024-01-21'"), "user_id", "2024-01-21", 3)
    return S.customer_health(u.where(f"created_at < '{fx.NOW}'"), "user_id", fx.NOW, 3, before)


@query(HEALTH)
def customer_health(spark: SparkSession, sf: str) -> DataFrame:
    return _health(spark, sf)


@query(f"select user_id, score, status from ({HEALTH}) order by score, user_id limit 20")
def health_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _health(spark, sf).orderBy("score", F.col("user_id").asc_nulls_last()).limit(20).select("user_id", "score", "status")


@query("select event_id, greatest(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0), 0) as shuffle_read, 5.0 as shuffle_write, greatest(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0), 0) + 5.0 as shuffle_bytes from events")
def metrics_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """The first alias present counts; shuffle is read plus write."""
    from ..functions.scalar import safe_number

    read = safe_number(F.coalesce(F.get_json_object("props", "$.shuffleReadBytes"), F.get_json_object("props", "$.k")))
    write = safe_number(F.coalesce(F.get_json_object("props", "$.shuffleWriteBytes"), F.get_json_object("props", "$.write"), F.lit("5")))
    return fx.events(spark, sf).select("event_id", read.alias("shuffle_read"), write.alias("shuffle_write"), (read + write).alias("shuffle_bytes"))
