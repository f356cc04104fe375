"""Watermarks, ranges, chunks, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .select import latest


def latest_watermark(wm: DataFrame) -> DataFrame:
    """Of each model the watermark updated last (not the one that ends last); ties by the later start."""
    return latest(wm, ["model"], [F.col("last_updated").desc(), F.col("partition_start").desc()])


def pending_ranges(models: DataFrame, wm: DataFrame, edges: DataFrame, as_of: str, lookback: int = 30) -> DataFrame:
    """(model, start, end): from the model's own watermark, or lookback days before as_of; earlier if an upstream's watermark starts earlier than that."""
    last = latest_watermark(wm)
    end = F.lit(as_of).cast("date")
    up = edges.join(last.select(F.col("model").alias("src"), F.col("partition_start").alias("up_start")), "src").groupBy(F.col("dst").alias("model")).agg(F.min("up_start").alias("up_start"))
    j = models.join(last.select("model", "partition_end"), "model", "left").join(up, "model", "left")
    start = F.least(F.coalesce("partition_end", F.date_sub(end, lookback)), F.col("up_start"))  # least skips nulls
    return j.select("model", F.least(start, end).alias("start"), end.alias("end"))


def date_chunks(ranges: DataFrame, days: int) -> DataFrame:
    """Inclusive chunks of `days` days for each row's start and end; the last one is clipped. Empty ranges give none."""
    r = ranges.where("start <= end").withColumn("chunk_start", F.explode(F.sequence("start", "end", F.expr(f"interval {days} days"))))
    return r.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("end")))


def resume_plan(checkpoints: DataFrame, days: int) -> DataFrame:
    """Chunks of what is left: from the day after completed_through, else from the start; finished backfills give none."""
    start = F.coalesce(F.date_add("completed_through", 1), F.col("overall_start"))
    return date_chunks(checkpoints.where("status <> 'COMPLETED'").select("model", start.alias("start"), F.col("overall_end").alias("end")), days)


def steps_todo(steps: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Steps without a successful run."""
    return steps.join(runs.where("status = 'SUCCESS'").select(*keys).distinct(), keys, "left_anti")


def snapshot_diff(base: DataFrame, target: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, change): added, removed or modified."""
    b, t = base.select(key, F.col(hash_col).alias("hb")), target.select(key, F.col(hash_col).alias("ht"))
    kind = F.when(F.col("hb").isNull(), "added").when(F.col("ht").isNull(), "removed").when(F.col("hb") != F.col("ht"), "modified")
    return b.join(t, key, "full").select(key, kind.alias("change")).where("change is not null")


def coverage_gaps(wm: DataFrame) -> DataFrame:
    """Days between one partition's end and the next one's start."""
    w = Window.partitionBy("model").orderBy("partition_start")
    g = wm.withColumn("next_start", F.lead("partition_start").over(w)).where("next_start > date_add(partition_end, 1)")
    return g.select("model", F.date_add("partition_end", 1).alias("gap_start"), F.date_sub("next_start", 1).alias("gap_end"))


def run_backfill(spark: SparkSession, chunks: list[tuple], write: Callable[[str, str], None], progress: str) -> DataFrame:
    """Runs chunks (start, end) in order and stops at the first that fails; each result is appended to the progress table, which is returned.

    The chunks of one backfill are a plan, as long as its days, and run one after another on the cluster.
    """
    for n, (start, end) in enumerate(chunks):
        try:
            write(str(start), str(end))
            status, error = "COMPLETED", None
        except Exception as e:  # noqa: BLE001 whatever a body raises fails its chunk
            status, error = "FAILED", str(e)[:200]
        spark.createDataFrame([(n, str(start), str(end), status, error)], "chunk int, start string, end string, status string, error string").write.mode("append").parquet(progress)
        if error:
            break
    return spark.read.parquet(progress)


