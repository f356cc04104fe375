"""Incremental state and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import materialize as M
from ..operators import state as S
from ..operators.select import top_n
from ..registry import query

LATEST = "(select * from (select *, row_number() over (partition by model order by last_updated desc, partition_start desc) as rn from v_watermarks) where rn = 1)"


@query(f"select model, partition_start, partition_end, row_count from {LATEST}")
def wm_latest(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest_watermark(fx.watermarks(spark, sf)).select("model", "partition_start", "partition_end", "row_count")


@query("select model, partition_start, partition_end, row_count from v_watermarks order by model, partition_start")
def wm_history(spark: SparkSession, sf: str) -> DataFrame:
    return fx.watermarks(spark, sf).select("model", "partition_start", "partition_end", "row_count").orderBy("model", "partition_start")


@query(f"""with l as (select * from {LATEST}), m as (select p_partkey as model from part), up as (select dst as model, min(partition_start) as up_start from v_edges join l on model = src group by 1)
  select model, least(coalesce(least(coalesce(partition_end, date '2001-08-02' - 30), up_start), coalesce(partition_end, date '2001-08-02' - 30)), date '2001-08-02') as start, date '2001-08-02' as "end" from m left join l using (model) left join up using (model)""")
def wm_pending_range(spark: SparkSession, sf: str) -> DataFrame:
    models = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("model"))
    return S.pending_ranges(models, fx.watermarks(spark, sf), fx.edges(spark, sf), fx.AS_OF)


CHUNKS = "select model, c::date as chunk_start, least(c::date + {n}, e) as chunk_end from (select model, e, unnest(generate_series(s, e, interval {d} day)) as c from ({src}))"


@query(CHUNKS.format(n=29, d=30, src="select model, overall_start as s, overall_end as e from v_checkpoints"))
def backfill_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.date_chunks(fx.checkpoints(spark, sf).select("model", F.col("overall_start").alias("start"), F.col("overall_end").alias("end")), 30).select("model", "chunk_start", "chunk_end")


@query(CHUNKS.format(n=29, d=30, src="select model, coalesce(completed_through + 1, overall_start) as s, overall_end as e from v_checkpoints where status <> 'COMPLETED' and coalesce(completed_through + 1, overall_start) <= overall_end"))
def backfill_resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    return S.resume_plan(fx.checkpoints(spark, sf), 30).select("model", "chunk_start", "chunk_end")


@query("select model, status, overall_start from v_checkpoints where status in ('FAILED', 'RUNNING') order by overall_start desc, model")
def backfill_resumable(spark: SparkSession, sf: str) -> DataFrame:
    return fx.checkpoints(spark, sf).where("status in ('FAILED', 'RUNNING')").select("model", "status", "overall_start").orderBy(F.desc("overall_start"), "model")


@query("""select model, status, count(*) as chunks, count(*) filter (chunk_end <= completed_through) as done, list(strftime(chunk_start, '%Y-%m-%d') order by chunk_start)[1:3] as first_chunks from v_checkpoints join (""" + CHUNKS.format(n=29, d=30, src="select model, overall_start as s, overall_end as e from v_checkpoints") + ") using (model) group by 1, 2")
def backfill_status(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.checkpoints(spark, sf)
    chunks = S.date_chunks(c.select("model", F.col("overall_start").alias("start"), F.col("overall_end").alias("end")), 30).select("model", "chunk_start", "chunk_end")
    first = top_n(chunks, ["model"], [F.col("chunk_start")], 3).groupBy("model").agg(F.sort_array(F.collect_list(F.col("chunk_start").cast("string"))).alias("first_chunks"))
    g = c.join(chunks, "model").groupBy("model", "status").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_end") <= F.col("completed_through")).alias("done"))
    return g.join(first, "model")


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as orders, round(sum(o_totalprice), 2) as total, 'COMPLETED' as status from orders group by 1")
def backfill_run(spark: SparkSession, sf: str) -> DataFrame:
    """All years of orders, one chunk after another, into a table by month; the built table's months with the status of their chunk."""
    target, progress = M.scratch(spark), M.scratch(spark)
    o = fx.orders(spark, sf).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    ends = o.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    chunks = [(f"{y}-01-01", f"{y}-12-31") for y in range(ends[0], ends[1] + 1)]
    body = lambda s, e: o.where((F.col("o_orderdate") >= F.lit(s).cast("timestamp")) & (F.col("o_orderdate") < F.lit(e).cast("timestamp")))
    done = S.run_backfill(spark, chunks, lambda s, e: M.incremental(body, s, e, target, ["month"]), progress)
    built = spark.read.option("basePath", target).schema(o.schema).parquet(target).groupBy("month").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return built.join(done.select(F.substring("start", 1, 4).alias("year"), "status"), F.substring("month", 1, 4) == F.col("year")).select("month", "orders", "total", "status")


@query("select distinct plan_id, model from v_runs where (plan_id, model) not in (select (plan_id, model) from v_runs where status = 'SUCCESS')")
def steps_todo(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.runs(spark, sf)
    return S.steps_todo(r.select("plan_id", "model").distinct(), r, ["plan_id", "model"])


@query("select o_orderkey, case when b.o_totalprice is null then 'added' when t.o_totalprice is null then 'removed' else 'modified' end as change from v_base b full join v_target t using (o_orderkey) where b.o_totalprice is null or t.o_totalprice is null or b.o_totalprice <> t.o_totalprice")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    return S.snapshot_diff(M.row_fingerprint(fx.base(spark, sf), cols), M.row_fingerprint(fx.target(spark, sf), cols), "o_orderkey", "fingerprint")


@query("select model, partition_end + 1 as gap_start, next_start - 1 as gap_end from (select *, lead(partition_start) over (partition by model order by partition_start) as next_start from v_watermarks) where next_start > partition_end + 1")
def wm_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.coverage_gaps(fx.watermarks(spark, sf))
