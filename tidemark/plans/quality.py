"""Data tests, contracts, drift and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import quality as Q
from ..operators.select import top_n
from ..registry import query


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf)
    return e.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("amount"))


AMOUNTS = "(select event_id, user_id, event_type, case when event_id % 7 <> 0 then value end as amount from events)"


def _suite(spark: SparkSession, sf: str, checks: list[Q.Check]) -> DataFrame:
    return Q.run_suite(_amounts(spark, sf), checks, "amounts").select("kind", "column", "failures", "passed")


def _one(kind: str, column: str, failures: str) -> str:
    return f"select '{kind}' as kind, '{column}' as \"column\", f::bigint as failures, f = 0 as passed from (select {failures} as f from {AMOUNTS})"


NULLS = _one("NOT_NULL", "amount", "count(*) filter (amount is null)") + " union all " + _one("NOT_NULL", "event_id", "count(*) filter (event_id is null)")
TWICE = "select 'UNIQUE' as kind, '{c}' as \"column\", count(*) as failures, count(*) = 0 as passed from (select {c} from " + AMOUNTS + " group by 1 having count(*) > 1)"
UNIQUE = TWICE.format(c="event_id") + " union all " + TWICE.format(c="user_id") + " union all " + TWICE.format(c="amount")
COUNTS = _one("ROW_COUNT_MAX", "", "(count(*) > 100)::int") + " union all " + _one("ROW_COUNT_MIN", "", "(count(*) < 100)::int")
ACCEPTED = _one("ACCEPTED_VALUES", "event_type", "count(*) filter (event_type not in ('click', 'view'))") + " union all " + _one("ACCEPTED_VALUES", "event_type", "count(*) filter (event_type not in ('click', 'view', 'error', 'signup', 'purchase'))")
CUSTOM = _one("CUSTOM_SQL", "", "count(*) filter (amount > 400)") + " union all " + _one("CUSTOM_SQL", "", "count(*) filter (amount < 0)")
CHECKS = {
    "dq_not_null": ([Q.Check("NOT_NULL", "amount"), Q.Check("NOT_NULL", "event_id")], NULLS),
    "dq_unique": ([Q.Check("UNIQUE", "event_id"), Q.Check("UNIQUE", "user_id"), Q.Check("UNIQUE", "amount")], UNIQUE),
    "dq_row_count": ([Q.Check("ROW_COUNT_MIN", None, 100), Q.Check("ROW_COUNT_MAX", None, 100)], COUNTS),
    "dq_accepted_values": ([Q.Check("ACCEPTED_VALUES", "event_type", ("click", "view")), Q.Check("ACCEPTED_VALUES", "event_type", ("click", "view", "error", "signup", "purchase"))], ACCEPTED),
    "dq_custom_sql": ([Q.Check("CUSTOM_SQL", None, "select * from {model} where amount > 400"), Q.Check("CUSTOM_SQL", None, "select * from {model} where amount < 0")], CUSTOM),
}


def _register(name: str, checks: list[Q.Check], sql: str) -> None:
    f = lambda spark, sf: _suite(spark, sf, checks)
    f.__name__ = name
    query(sql)(f)


for _name, (_checks, _sql) in CHECKS.items():
    _register(_name, _checks, _sql)
_register("dq_suite", [c for cs, _ in CHECKS.values() for c in cs], " union all ".join(s for _, s in CHECKS.values()))

RESULTS = "(select event_type as test_id, 'p' || (event_id % 200) as plan_id, value > 2 as passed, ts as run_at, event_id from events)"
DEFS = [("click", "BLOCK"), ("view", "BLOCK"), ("error", "WARN"), ("signup", "BLOCK")]


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return fx.events(spark, sf).select(F.col("event_type").alias("test_id"), F.concat(F.lit("p"), F.col("event_id") % 200).alias("plan_id"), (F.col("value") > 2).alias("passed"), F.col("ts").alias("run_at"), "event_id")


@query(f"select plan_id, count(*) as total, count(*) filter (passed) as passed_tests, count(*) filter (not passed) as failed, count(*) filter (not passed and coalesce(severity, 'BLOCK') = 'BLOCK') as blocked from {RESULTS} left join {fx.values(DEFS, 'test_id, severity')} using (test_id) group by 1")
def dq_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.suite_summary(_results(spark, sf), spark.createDataFrame(DEFS, "test_id string, severity string"), ["test_id"], ["plan_id"])


@query(f"select test_id, event_id, passed from (select *, row_number() over (partition by test_id order by run_at desc, event_id desc) as rn from {RESULTS}) where rn <= 10")
def dq_history(spark: SparkSession, sf: str) -> DataFrame:
    return top_n(_results(spark, sf), ["test_id"], [F.col("run_at").desc(), F.col("event_id").desc()], 10).select("test_id", "event_id", "passed")


STATES = "(select *, case when value < 5 then 'ERROR' when value < 10 then 'FAIL' when value < 15 then 'WARN' when event_id % 50 = 0 then 'SKIP' else 'PASS' end as state, list_extract(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], (event_id % 4 + 1)::int) as severity from events)"


@query(f"select event_type as check_name, {', '.join(f'''count(*) filter (state = '{s}') as {s.lower()}_n''' for s in ('PASS', 'FAIL', 'WARN', 'ERROR', 'SKIP'))}, count(*) filter (state = 'FAIL' and severity in ('CRITICAL', 'HIGH')) as blocking from {STATES} group by 1")
def dq_check_rollup(spark: SparkSession, sf: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    state = F.when(v < 5, "ERROR").when(v < 10, "FAIL").when(v < 15, "WARN").when(i % 50 == 0, "SKIP").otherwise("PASS")
    e = fx.events(spark, sf).withColumn("state", state).withColumn("severity", F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), (i % 4 + 1).cast("int")))
    counts = [F.count_if(F.col("state") == s).alias(f"{s.lower()}_n") for s in ("PASS", "FAIL", "WARN", "ERROR", "SKIP")]
    return e.groupBy(F.col("event_type").alias("check_name")).agg(*counts, F.count_if((F.col("state") == "FAIL") & F.col("severity").isin("CRITICAL", "HIGH")).alias("blocking"))


TYPE = "coalesce(" + "case upper(trim({c})) " + " ".join(f"when '{a}' then '{b}'" for a, b in Q.ALIASES.items()) + " end, upper(trim({c})))"
PAIRED = f"(select table_name, column_name, e.t as et, a.t as aty, e.nullable as en, a.nullable as an from (select table_name, lower(column_name) as column_name, {TYPE.format(c='data_type')} as t, nullable from v_expected) e full join (select table_name, lower(column_name) as column_name, {TYPE.format(c='data_type')} as t, nullable from v_actual) a using (table_name, column_name))"
VIOLATIONS = f"""select table_name, column_name, 'COLUMN_REMOVED' as violation, 'BREAKING' as severity from {PAIRED} where aty is null union all select table_name, column_name, 'COLUMN_ADDED', 'INFO' from {PAIRED} where et is null
  union all select table_name, column_name, 'TYPE_CHANGED', 'BREAKING' from {PAIRED} where et <> aty union all select table_name, column_name, 'NULLABLE_TIGHTENED', 'BREAKING' from {PAIRED} where et is not null and aty is not null and en = 0 and an = 1"""
SCHEMA = "table_name string, column_name string, data_type string, nullable int"


def _schemas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Declared schemas, and those measured on the rows of the tables."""
    tables = {"orders": fx.orders(spark, sf), "customer": fx.table(spark, sf, "customer"), "amounts": _amounts(spark, sf), "nation": fx.table(spark, sf, "nation")}
    actual = None
    for name, df in tables.items():
        one = Q.measured_schema(df, name).drop("ordinal")
        actual = one if actual is None else actual.union(one)
    return spark.createDataFrame(fx.SCHEMA_EXPECTED, SCHEMA), actual


@query(VIOLATIONS)
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    return Q.contract_violations(*_schemas(spark, sf))


@query(f"select table_name, count(*) filter (severity = 'BREAKING') as breaking, count(*) filter (severity = 'WARNING') as warning, count(*) filter (severity = 'INFO') as info from ({VIOLATIONS}) group by 1")
def contract_batch(spark: SparkSession, sf: str) -> DataFrame:
    return Q.contract_batch(Q.contract_violations(*_schemas(spark, sf)))


DRIFT = f"select table_name, column_name, case when an is null then 'REMOVED' when en is null then 'ADDED' else 'TYPE_CHANGED' end as drift, et as expected_type, aty as actual_type from {PAIRED} where an is null or en is null or et <> aty"


@query(DRIFT)
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    return Q.schema_drift(*_schemas(spark, sf))


@query(f"select table_name, coalesce(case min(case drift when 'REMOVED' then 0 when 'TYPE_CHANGED' then 1 when 'ADDED' then 2 end) when 0 then 'REMOVED' when 1 then 'TYPE_CHANGED' when 2 then 'ADDED' end, 'NONE') as drift_class from (select distinct table_name from v_expected) left join ({DRIFT}) using (table_name) group by 1")
def drift_class(spark: SparkSession, sf: str) -> DataFrame:
    e, a = _schemas(spark, sf)
    return Q.drift_class(e.select("table_name").distinct(), Q.schema_drift(e, a))


RECON = """(select run_id, started_at, case when status = observed then null when status = 'SUCCESS' and observed = 'FAIL' then 'phantom_success' when status = 'FAIL' and observed = 'SUCCESS' then 'missed_success' when status = 'RUNNING' and observed = 'SUCCESS' then 'stale_running'
  when status = 'RUNNING' and observed = 'FAIL' then 'stale_running_failed' when status = 'PENDING' then 'stale_pending' else 'status_mismatch' end as discrepancy from v_runs join v_observed using (run_id))"""


def _recon(spark: SparkSession, sf: str) -> DataFrame:
    return Q.reconcile(fx.runs(spark, sf), fx.observed(spark, sf), "run_id")


@query(f"select run_id, discrepancy from {RECON}")
def recon_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _recon(spark, sf)


@query(f"select discrepancy, count(*) as n from {RECON} where discrepancy is not null group by 1")
def recon_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _recon(spark, sf).where("discrepancy is not null").groupBy("discrepancy").agg(F.count("*").alias("n"))


@query(f"select count(*) as checks, count(discrepancy) as discrepancies, count(*) filter (discrepancy is not null and run_id % 2 = 1) as unresolved, count(*) filter (discrepancy is not null and run_id % 2 = 0) as resolved from {RECON}")
def recon_stats(spark: SparkSession, sf: str) -> DataFrame:
    open_ = F.col("discrepancy").isNotNull()
    return _recon(spark, sf).agg(F.count("*").alias("checks"), F.count("discrepancy").alias("discrepancies"), F.count_if(open_ & (F.col("run_id") % 2 == 1)).alias("unresolved"), F.count_if(open_ & (F.col("run_id") % 2 == 0)).alias("resolved"))


@query(f"select run_id, discrepancy from {RECON} where discrepancy is not null and run_id % 2 = 1 order by started_at desc, run_id desc limit 25")
def recon_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    r = _recon(spark, sf).where("discrepancy is not null and run_id % 2 = 1").join(fx.runs(spark, sf).select("run_id", "started_at"), "run_id")
    return r.orderBy(F.desc("started_at"), F.desc("run_id")).limit(25).select("run_id", "discrepancy")
