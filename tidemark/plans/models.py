"""Transformation models (staging and analytics) and the predicates, joins and pages they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.scalar import safe_divide, value_tier
from ..operators import materialize as M
from ..operators.select import contains_ignoring_case, half_open, keyset_page, latest, offset_page
from ..operators.versions import StoredTable
from ..registry import query

START, END = "1995-01-01", "2001-08-02"
STG_SQL = """select o_orderkey as order_id, o_custkey as customer_id, o_orderdate::date as order_date, o_orderstatus as status, o_totalprice as total_amount, o_orderpriority as priority, c_mktsegment as segment, n_name as country
  from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey where o_orderdate >= '1995-01-01' and o_orderdate < '2001-08-02'"""


def staged_orders(spark: SparkSession, sf: str, start: str = START, end: str = END) -> DataFrame:
    o = fx.orders(spark, sf).where(half_open("o_orderdate", start, end))
    c, n = fx.table(spark, sf, "customer"), fx.table(spark, sf, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("country"))


@query(STG_SQL)
def stg_orders(spark: SparkSession, sf: str) -> DataFrame:
    return staged_orders(spark, sf)


DAILY_SQL = f"""select order_date, country, segment, count(distinct order_id) as orders, count(distinct customer_id) as customers, round(sum(total_amount), 2) as gross, round(avg(total_amount), 6) as avg_amount,
  count(*) filter (status = 'F') as filled, count(*) filter (status = 'O') as open_orders,
  round(coalesce(sum(total_amount) filter (status <> 'P'), 0) - coalesce(sum(total_amount) filter (status = 'P'), 0), 2) as net from ({STG_SQL}) group by all"""


def daily_orders(stg: DataFrame) -> DataFrame:
    amount, status = F.col("total_amount"), F.col("status")
    part = lambda c: F.coalesce(F.sum(F.when(c, amount)), F.lit(0.0))
    return stg.groupBy("order_date", "country", "segment").agg(
        F.countDistinct("order_id").alias("orders"), F.countDistinct("customer_id").alias("customers"), F.round(F.sum(amount), 2).alias("gross"), F.round(F.avg(amount), 6).alias("avg_amount"),
        F.count_if(status == "F").alias("filled"), F.count_if(status == "O").alias("open_orders"), F.round(part(status != "P") - part(status == "P"), 2).alias("net"),
    )


@query(DAILY_SQL)
def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Built by overwriting the days of a written table, then read back."""
    target = M.scratch(spark)
    M.overwrite_partitions(daily_orders(staged_orders(spark, sf)).withColumn("month", F.date_format("order_date", "yyyy-MM")), target, ["month"])
    return spark.read.parquet(target).drop("month")


@query("""select c_custkey as customer_id, c_mktsegment as segment, count(distinct o_orderkey) as orders, round(coalesce(sum(o_totalprice), 0), 2) as lifetime_value, round(avg(o_totalprice), 6) as avg_order, min(o_orderdate)::date as first_order, max(o_orderdate)::date as last_order,
  date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date) as tenure_days, case when round(coalesce(sum(o_totalprice), 0), 2) >= 3000000 then 'platinum' when round(coalesce(sum(o_totalprice), 0), 2) >= 2400000 then 'gold' when round(coalesce(sum(o_totalprice), 0), 2) >= 1800000 then 'silver' else 'bronze' end as tier
  from customer left join orders on o_custkey = c_custkey group by 1, 2""")
def customer_lifetime_value(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.table(spark, sf, "customer").join(fx.orders(spark, sf), F.col("c_custkey") == F.col("o_custkey"), "left")
    g = j.groupBy(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment")).agg(
        F.countDistinct("o_orderkey").alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("lifetime_value"), F.round(F.avg("o_totalprice"), 6).alias("avg_order"), F.to_date(F.min("o_orderdate")).alias("first_order"), F.to_date(F.max("o_orderdate")).alias("last_order"))
    return g.withColumn("tenure_days", F.datediff("last_order", "first_order").cast("long")).withColumn("tier", value_tier(F.col("lifetime_value"), [("platinum", 3e6), ("gold", 2.4e6), ("silver", 1.8e6)], "bronze"))


@query("""select user_id, count(distinct event_id) filter (event_type = 'purchase') as purchases, count(distinct event_id) filter (event_type = 'view') as views, coalesce(sum(json_extract_string(props, '$.k')::bigint) filter (event_type = 'purchase'), 0)::bigint as amount,
  min(ts) as first_seen, max(ts) as last_seen, date_diff('day', min(ts)::date, max(ts)::date) as active_days from events group by 1""")
def user_metrics(spark: SparkSession, sf: str) -> DataFrame:
    kind, amount = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    one = lambda t: F.countDistinct(F.when(kind == t, F.col("event_id")))
    g = fx.events(spark, sf).groupBy("user_id").agg(one("purchase").alias("purchases"), one("view").alias("views"), F.coalesce(F.sum(F.when(kind == "purchase", amount)), F.lit(0)).alias("amount"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return g.withColumn("active_days", F.datediff("last_seen", "first_seen").cast("long"))


@query("""select ts::date as day, count(*) as purchases, sum(json_extract_string(props, '$.k')::bigint)::bigint as amount, round(avg(json_extract_string(props, '$.k')::bigint), 4) as avg_amount from events where event_type = 'purchase' group by 1""")
def purchases_daily(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return fx.events(spark, sf).where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("purchases"), F.sum(k).alias("amount"), F.round(F.avg(k), 4).alias("avg_amount"))


@query("""select c_mktsegment as segment, round(sum(o_totalprice), 2) as revenue, round(sum(o_totalprice) / nullif(t.total, 0), 6) as share, round(sum(o_totalprice) / nullif(t.pending - t.pending, 0), 6) as undefined_share
  from orders join customer on c_custkey = o_custkey cross join (select sum(o_totalprice) as total, sum(case when o_orderstatus = 'P' then o_totalprice end) as pending from orders) t group by c_mktsegment, t.total, t.pending""")
def revenue_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The one-row total is broadcast: an aggregate without keys has one row."""
    o = fx.orders(spark, sf)
    total = o.agg(F.sum("o_totalprice").alias("total"))
    g = o.join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("o_totalprice").alias("r"))
    return g.crossJoin(F.broadcast(total)).select("segment", F.round("r", 2).alias("revenue"), F.round(safe_divide(F.col("r"), F.col("total")), 6).alias("share"), F.round(safe_divide(F.col("r"), F.col("total") - F.col("total")), 6).alias("undefined_share"))


@query("""select c_custkey, max(o_orderdate)::date as last_order, case when max(o_orderdate)::date >= date '2001-08-02' - 90 then 'active' when max(o_orderdate)::date >= date '2001-08-02' - 365 then 'at_risk' else 'churned' end as lifecycle from customer join orders on o_custkey = c_custkey group by 1""")
def customer_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    last = fx.orders(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).alias("last_order"))
    as_of = F.lit(fx.AS_OF).cast("date")
    stage = F.when(F.col("last_order") >= F.date_sub(as_of, 90), "active").when(F.col("last_order") >= F.date_sub(as_of, 365), "at_risk").otherwise("churned")
    return fx.table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey").withColumn("lifecycle", stage)


@query("select event_id, user_id, event_type, ts from events where ts >= '2024-01-10' and ts < '2024-01-12'")
def filter_time_range(spark: SparkSession, sf: str) -> DataFrame:
    return fx.events(spark, sf).where(half_open("ts", "2024-01-10", "2024-01-12")).select("event_id", "user_id", "event_type", "ts")


@query("select p_partkey, p_name, p_brand from part where p_size = 10 and p_type is not null and contains(lower(p_name), lower('A'))")
def search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    wanted: list[Column] = [F.col("p_size") == 10, F.col("p_type").isNotNull(), contains_ignoring_case("p_name", "A")]
    out = fx.table(spark, sf, "part")
    for c in wanted:
        out = out.where(c)
    return out.select("p_partkey", "p_name", "p_brand")


@query("select event_id, user_id, event_type, ts from events where event_type = 'error' and user_id < 50 order by ts desc, event_id desc limit 40 offset 10")
def audit_query(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf).where("event_type = 'error' and user_id < 50").select("event_id", "user_id", "event_type", "ts")
    return offset_page(e, [F.col("ts").desc(), F.col("event_id").desc()], 40, 10)


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal is not null)")
def semi_in_list(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal is not null").select(F.col("c_custkey").alias("o_custkey"))
    return fx.orders(spark, sf).join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select event_id, lower(event_type) as event_type, coalesce(case when event_id % 7 <> 0 then value end, 0) as amount from events")
def events_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return fx.events(spark, sf).select("event_id", F.lower("event_type").alias("event_type"), F.coalesce(raw, F.lit(0.0)).alias("amount"))


@query("select event_id, case when ts + interval 10 day <= timestamp '2024-01-31' then timestamp '2024-01-31' end as deleted_at from events")
def expire_rows(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(fx.NOW).cast("timestamp")
    return fx.events(spark, sf).select("event_id", F.when(F.col("ts") + F.expr("interval 10 days") <= now, now).alias("deleted_at"))


@query("select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1".replace("select * from", "select o_custkey, o_orderkey, o_totalprice from", 1))
def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(fx.orders(spark, sf), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def page_offset(spark: SparkSession, sf: str) -> DataFrame:
    return offset_page(fx.orders(spark, sf).select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50, 100)


@query("select event_id, ts from events where ts < '2024-01-15' or (ts = '2024-01-15' and event_id < 100) order by ts desc, event_id desc limit 50")
def page_keyset(spark: SparkSession, sf: str) -> DataFrame:
    return keyset_page(fx.events(spark, sf).select("event_id", "ts"), "ts", "event_id", ("2024-01-15 00:00:00", 100), 50)


@query("select 'only_base' as side, o_orderkey from v_base where o_orderkey not in (select o_orderkey from v_target) union all select 'only_target', o_orderkey from v_target where o_orderkey not in (select o_orderkey from v_base) union all (select 'both', o_orderkey from v_base intersect select 'both', o_orderkey from v_target)")
def key_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    a, b = fx.base(spark, sf).select("o_orderkey"), fx.target(spark, sf).select("o_orderkey")
    side = lambda name, d: d.select(F.lit(name).alias("side"), "o_orderkey")
    return side("only_base", a.subtract(b)).union(side("only_target", b.subtract(a))).union(side("both", a.intersect(b)))


@query("select event_id, case when substr(v, 1, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then '''' || v else v end as v from (select event_id, substr('=+-@ab', (event_id % 6 + 1)::int, 1) || event_type as v from events)")
def csv_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat(F.expr("substr('=+-@ab', cast(event_id % 6 + 1 as int), 1)"), "event_type")
    return M.csv_sanitize(fx.events(spark, sf).select("event_id", v.alias("v")), ["v"])


@query("select o_orderkey, sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus) as fingerprint from orders")
def row_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return M.row_fingerprint(fx.orders(spark, sf), ["o_orderkey", "o_custkey", "o_orderstatus"]).select("o_orderkey", "fingerprint")


@query("select o_orderkey, o_totalprice from orders where o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01' and o_totalprice >= 1000")
def param_model(spark: SparkSession, sf: str) -> DataFrame:
    fx.orders(spark, sf).createOrReplaceTempView("param_model_orders")
    sql = "select o_orderkey, o_totalprice from param_model_orders where o_orderdate >= cast(:start_date as timestamp) and o_orderdate < cast(:end_date as timestamp) and o_totalprice >= :least"
    return spark.sql(sql, args={"start_date": "1996-01-01", "end_date": "1997-01-01", "least": 1000})


@query(STG_SQL.replace("'1995-01-01'", "'2000-01-01'"))
def mat_view(spark: SparkSession, sf: str) -> DataFrame:
    staged_orders(spark, sf, "2000-01-01").createOrReplaceTempView("stg_orders_view")
    return spark.table("stg_orders_view")


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def mat_full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    target, o = M.scratch(spark), fx.orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    M.full_refresh(o.where("o_orderkey < 50"), target)
    M.full_refresh(o, target)
    return spark.read.parquet(target)


INCREMENT_SQL = "select o_orderkey, o_totalprice, o_orderdate::date as day from orders where o_orderdate >= '1998-01-01' and o_orderdate < '1998-04-01'"


def _order_days(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.orders(spark, sf)
    return o.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query(INCREMENT_SQL)
def mat_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranges, the second run twice: a rerun replaces what it wrote."""
    target, body = M.scratch(spark), lambda s, e: _order_days(spark, sf).where(half_open("day", s, e))
    for start, end in (("1998-01-01", "1998-02-28"), ("1998-03-01", "1998-03-31"), ("1998-03-01", "1998-03-31")):
        M.incremental(body, start, end, target, ["month"])
    return spark.read.parquet(target).drop("month")


@query("select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_totalprice from orders where o_orderkey % 3 = 0")
def mat_append(spark: SparkSession, sf: str) -> DataFrame:
    target, o = M.scratch(spark), fx.orders(spark, sf).select("o_orderkey", "o_totalprice")
    M.append(o.where("o_orderkey % 2 = 0"), target)
    M.append(o.where("o_orderkey % 3 = 0"), target)
    return spark.read.parquet(target)


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from v_target union all select * from v_base where o_orderkey not in (select o_orderkey from v_target)")
def mat_merge_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge_by_key(fx.base(spark, sf), fx.target(spark, sf), ["o_orderkey"])


@query(INCREMENT_SQL.replace("o_totalprice,", "case when month(o_orderdate) = 2 then 0 else o_totalprice end as o_totalprice,"))
def mat_insert_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    target, rows = M.scratch(spark), _order_days(spark, sf).where(half_open("day", "1998-01-01", "1998-04-01"))
    M.overwrite_partitions(rows, target, ["month"])
    M.overwrite_partitions(rows.where("month = '1998-02'").withColumn("o_totalprice", F.lit(0.0)), target, ["month"])
    return spark.read.parquet(target).drop("month")


@query("select b.o_orderkey, b.o_custkey, b.o_orderstatus, coalesce(t.o_totalprice, b.o_totalprice) as o_totalprice from v_base b left join v_target t using (o_orderkey) union all select * from v_target where o_orderkey not in (select o_orderkey from v_base)")
def state_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = fx.target(spark, sf).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderstatus")).otherwise("X"))
    return M.merge_by_key(fx.base(spark, sf), new, ["o_orderkey"], update_cols=["o_totalprice"])


@query("select * from v_base union all select * from v_target where o_orderkey not in (select o_orderkey from v_base)")
def state_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    return M.insert_if_absent(fx.base(spark, sf), fx.target(spark, sf), ["o_orderkey"])


@query("select env, snapshot_id, promoted_at from (select 'env' || (user_id % 3) as env, event_id as snapshot_id, ts as promoted_at, row_number() over (partition by user_id % 3 order by ts desc, event_id desc) as rn from events where event_type = 'signup') where rn = 1")
def env_current_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.events(spark, sf).where("event_type = 'signup'").select(F.concat(F.lit("env"), F.col("user_id") % 3).alias("env"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("promoted_at"))
    return latest(p, ["env"], [F.col("promoted_at").desc(), F.col("snapshot_id").desc()])




def _stored(spark: SparkSession, df: DataFrame) -> StoredTable:
    """A stored table of orders in parts of 8,192 keys."""
    t = StoredTable(spark, M.scratch(spark), ("o_orderkey",), F.concat(F.lit("k"), F.floor(F.col("o_orderkey") / 8192).cast("string")))
    t.create(df)
    return t


LATE = "o_orderkey % 8192 < 4096"


@query(f"select o_orderkey, o_custkey, o_orderstatus, coalesce(t.o_totalprice, b.o_totalprice) as o_totalprice from v_base b left join (select * from v_target where {LATE}) t using (o_orderkey, o_custkey, o_orderstatus) union all select * from v_target where {LATE} and o_orderkey not in (select o_orderkey from v_base)")
def mat_merge_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stored, then merged with some of their changes: prices of known ones, new ones whole."""
    t = _stored(spark, fx.base(spark, sf))
    t.merge(fx.target(spark, sf).where(LATE), update_cols=["o_totalprice"])
    return t.read()


@query("""with v as (select 1 as version, * from v_base union all select 2, o_orderkey, o_custkey, o_orderstatus, o_totalprice from v_target union all select 2, * from v_base where o_orderkey not in (select o_orderkey from v_target)),
  g as (select version, count(*) as n, round(sum(o_totalprice), 2) as price from v group by 1)
  select env, moment, n, price from g join (select * from (values ('dev', 'merged', 2), ('prod', 'merged', 1), ('prod', 'promoted', 2), ('prod', 'rolled back', 1)) as m(env, moment, version)) using (version)""")
def env_versions(spark: SparkSession, sf: str) -> DataFrame:
    """What two environments read of one stored table: after a merge in dev, after its promotion, and after going back."""
    t = _stored(spark, fx.base(spark, sf))
    t.point("dev", 1)
    t.point("prod", 1)
    t.point("dev", t.merge(fx.target(spark, sf)).version)
    seen = []

    def see(env: str, moment: str) -> None:
        seen.append(t.read(env=env).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")).select(F.lit(env).alias("env"), F.lit(moment).alias("moment"), "n", "price"))

    see("dev", "merged")
    see("prod", "merged")
    t.promote("dev", "prod")
    see("prod", "promoted")
    t.roll_back("prod")
    see("prod", "rolled back")
    return seen[0].union(seen[1]).union(seen[2]).union(seen[3])


@query("select 'k' || (o_orderkey // 8192) as part, count(*) as n, min(o_orderkey) as low, max(o_orderkey) as high from v_base group by 1")
def version_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of a stored table's version."""
    return _stored(spark, fx.base(spark, sf)).manifest().select("part", F.col("rows").alias("n"), "low", "high")
