"""Building tables: full refresh, time ranges, append, merge by key; exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .select import latest


@dataclass(frozen=True)
class TableSpec:
    """A named table and its body (spark, start, end) -> DataFrame. Time ranges need a time column, merges a key."""

    name: str
    body: Callable[[SparkSession, str, str], DataFrame]
    kind: str = "FULL_REFRESH"
    time_column: str | None = None
    unique_key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("FULL_REFRESH", "INCREMENTAL_BY_TIME_RANGE", "APPEND_ONLY", "MERGE_BY_KEY"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind == "INCREMENTAL_BY_TIME_RANGE" and not self.time_column:
            raise ValueError("a time range needs a time column")
        if self.kind == "MERGE_BY_KEY" and not self.unique_key:
            raise ValueError("a merge needs a unique key")

    def resolve(self, env: dict[str, str], name: str) -> str:
        """Path of the table in an environment."""
        return f"{env[name].rstrip('/')}/{self.name}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one for a local master; elsewhere executors couldn't share it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none where there is no folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def full_refresh(df: DataFrame, target: str) -> None:
    df.write.mode("overwrite").parquet(target)


def append(df: DataFrame, target: str) -> None:
    df.write.mode("append").parquet(target)


def overwrite_partitions(df: DataFrame, target: str, partition_by: list[str]) -> None:
    """Replaces the partitions that df has rows of, and no others. Rows are brought together by partition first, large ones over several tasks, so that a partition has few files."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(target)


def incremental(body: Callable[[str, str], DataFrame], start: str, end: str, target: str, partition_by: list[str]) -> None:
    """Runs body over [start, end + 1 day) and replaces its partitions, so that a rerun changes nothing. Ranges are whole partitions."""
    overwrite_partitions(body(start, str(date.fromisoformat(end) + timedelta(days=1))), target, partition_by)


def merge_by_key(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str] | None = None, order_by: list[Column] | None = None) -> DataFrame:
    """Target with source's rows: new keys are inserted, known ones take update_cols (all by default) from source; a null key equals a null key.

    Of several source rows of a key the first in order_by counts (newest first, say), by default
    that of the greatest other columns. Target has one row a key.
    """
    rest = [c for c in target.columns if c not in keys]
    source = latest(source, keys, order_by or [F.col(c).desc() for c in rest] or [F.col(c) for c in keys])
    take = set(rest if update_cols is None else update_cols)
    t, s = target.withColumn("in_target", F.lit(True)).alias("t"), source.withColumn("in_source", F.lit(True)).alias("s")
    j = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full")
    pick = lambda c: F.when(F.col("in_target").isNull() | (F.col("in_source").isNotNull() & F.lit(c in take)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return j.select(*[F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys], *map(pick, rest))


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def row_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """SHA-256 of the columns' text with a separator; nulls count as empty."""
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256))


def csv_sanitize(df: DataFrame, cols: list[str]) -> DataFrame:
    """An apostrophe before texts that a spreadsheet would take for a formula."""
    for c in cols:
        df = df.withColumn(c, F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(F.col(c)))
    return df


def export(df: DataFrame, target: str, kind: str) -> None:
    """csv (guarded, with a header) or json lines."""
    if kind == "csv":
        csv_sanitize(df, [c for c, t in df.dtypes if t == "string"]).write.mode("overwrite").option("header", True).csv(target)
    elif kind == "json":
        df.write.mode("overwrite").json(target)
    else:
        raise ValueError(f"unknown format {kind}")
