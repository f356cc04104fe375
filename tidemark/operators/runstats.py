"""Statistics over run records, one conditional aggregate or one window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import top_n


def _newest() -> list[Column]:
    return [F.col("started_at").desc(), F.col("run_id").desc()]


def cost_accuracy(predicted: str, actual: str) -> Column:
    """1 - |p - a| / max(p, a, 0.01), in 0 to 1; 1 if neither is above 0."""
    p, a = F.col(predicted), F.col(actual)
    return F.when((p <= 0) & (a <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(p - a) / F.greatest(p, a, F.lit(0.01)))))


def run_cost(seconds: Column, size: Column, rates: dict[str, float]) -> Column:
    rate = F.create_map(*[F.lit(x) for p in rates.items() for x in p])
    return F.round(F.greatest(seconds, F.lit(0.0)) * rate[size], 6)


def last_n_stats(done: DataFrame, n: int = 30) -> DataFrame:
    """Mean runtime and cost of each model's newest n finished runs."""
    return top_n(done, ["model"], _newest(), n).groupBy("model").agg(F.round(F.avg("seconds"), 6).alias("avg_runtime"), F.round(F.avg("cost_usd"), 6).alias("avg_cost"), F.count("*").alias("n"))


def consecutive_failures(runs: DataFrame, n: int = 20) -> DataFrame:
    """Failures from the newest run back to the first that didn't fail, among the newest n."""
    w = Window.partitionBy("model").orderBy(*_newest())
    recent = top_n(runs, ["model"], _newest(), n).withColumn("ok", F.sum((F.col("status") != "FAIL").cast("int")).over(w))
    return recent.groupBy("model").agg(F.count_if(F.col("ok") == 0).alias("consecutive_failures"))


def failure_rates(models: DataFrame, runs: DataFrame) -> DataFrame:
    """Share of failed runs; 0 for models without runs."""
    rate = runs.groupBy("model").agg(F.avg((F.col("status") == "FAIL").cast("int")).alias("rate"))
    return models.join(rate, "model", "left").select("model", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("failure_rate"))


def run_summary(runs: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    week, done, failed = F.col("started_at") >= at - F.expr("interval 7 days"), F.col("status") != "RUNNING", F.col("status") == "FAIL"
    order = F.struct("started_at", "run_id")
    g = runs.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.count_if(week).alias("recent"), F.count_if(week & failed).alias("recent_failed"),
        F.round(F.avg(F.when(done, F.col("seconds"))), 6).alias("avg_runtime"), F.round(F.avg(F.when(done & week, F.col("seconds"))), 6).alias("recent_avg"),
        F.round((F.unix_micros(at) - F.unix_micros(F.max(F.when(F.col("status") == "SUCCESS", F.col("started_at"))))) / 3.6e9, 6).alias("hours_since_success"),
        F.max_by(F.struct("status", F.coalesce("error_message", F.lit("")).alias("error")), order).alias("last"),
    )
    return g.withColumn("last_error", F.when(F.col("last.status") == "FAIL", F.col("last.error"))).drop("last").withColumn("trend", F.round((F.col("recent_avg") - F.col("avg_runtime")) / F.col("avg_runtime"), 6))
