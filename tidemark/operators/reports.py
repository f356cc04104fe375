"""Usage, cost and quota reports over run and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import half_open

BUCKETS = ("day", "week", "month")


def bucket(ts: str, unit: str) -> Column:
    """Start of the day, week (Monday) or month; an unknown unit counts as day."""
    return F.to_date(F.date_trunc(unit if unit in BUCKETS else "day", F.col(ts)))


def within(df: DataFrame, ts: str, since: str | None, until: str | None) -> DataFrame:
    return df.where(half_open(ts, since, until)) if since and until else df


def cost_by(runs: DataFrame, by: Column, name: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Summed cost and runs of each value of by."""
    return within(runs, "started_at", since, until).groupBy(by.alias(name)).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"), F.count("*").alias("runs"))


def usage_over_time(usage: DataFrame, unit: str, ts: str = "created_at") -> DataFrame:
    return usage.groupBy(bucket(ts, unit).alias("bucket"), "event_type").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("events"))


def llm_totals() -> list[Column]:
    return [F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")]


def llm_by_call_type(calls: DataFrame) -> DataFrame:
    return calls.groupBy("call_type").agg(*llm_totals())


def unpivot(df: DataFrame, keys: list[str], names: list[str], label: str, value: str) -> DataFrame:
    """A row for each key and named column."""
    return df.unpivot(keys, names, label, value)


def quota_usage(usage: DataFrame, tenants: DataFrame, limits: DataFrame, since: str, until: str) -> DataFrame:
    """Used, limit, remaining and percent of each tenant and type. An explicit plan quota goes before the tier's limit; none is unlimited."""
    used = within(usage, "created_at", since, until).groupBy("tenant_id", "event_type").agg(F.sum("quantity").alias("used"))
    j = used.join(tenants, "tenant_id").join(limits, ["tier", "event_type"], "left")
    limit = F.coalesce(F.when(F.col("event_type") == "plan_run", F.col("plan_quota")), F.col("tier_limit")).cast("long")
    j = j.withColumn("limit_value", limit)
    return j.select("tenant_id", "event_type", "used", "limit_value", F.greatest(F.lit(0).cast("long"), F.col("limit_value") - F.col("used")).alias("remaining"), F.when(F.col("limit_value") > 0, F.round(F.col("used") / F.col("limit_value") * 100, 1)).alias("percent")).withColumn("remaining", F.when(F.col("limit_value").isNotNull(), F.col("remaining")))


def compare_periods(df: DataFrame, value: Column, ts: str, current: tuple[str, str], previous: tuple[str, str]) -> DataFrame:
    """Totals of two windows, their difference, percent (null if the earlier is 0) and direction; one pass."""
    part = lambda w: F.coalesce(F.sum(F.when(half_open(ts, *w), value)), F.lit(0.0))
    t = df.agg(F.round(part(current), 4).alias("current_total"), F.round(part(previous), 4).alias("previous_total"))
    diff = F.col("current_total") - F.col("previous_total")
    direction = F.when(diff > 0, "up").when(diff < 0, "down").otherwise("flat")
    return t.select("*", F.round(diff, 4).alias("change"), F.when(F.col("previous_total") != 0, F.round(diff / F.col("previous_total") * 100, 2)).alias("percent"), direction.alias("direction"))


def invoice_lines(usage: DataFrame, runs: DataFrame, llm: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Line items of each tenant: usage by its prices, compute and model cost as spent; only what is above 0."""
    u = usage.where(F.col("event_type").isin(*prices)).groupBy("tenant_id", F.col("event_type").alias("item")).agg(F.sum("quantity").cast("double").alias("quantity"))
    price = F.create_map(*[F.lit(x) for p in prices.items() for x in p])
    lines = u.select("tenant_id", "item", "quantity", F.round(F.col("quantity") * price[F.col("item")], 2).alias("amount"))
    spent = lambda df, name: df.groupBy("tenant_id").agg(F.count("cost_usd").cast("double").alias("quantity"), F.round(F.sum("cost_usd"), 2).alias("amount")).select("tenant_id", F.lit(name).alias("item"), "quantity", "amount")
    return lines.union(spent(runs, "compute_cost")).union(spent(llm, "llm_cost")).where("amount > 0")
