"""Readers and writers of tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A table; json and csv need a schema, as inferring one reads everything twice."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    r = spark.read.format(kind).option("header", True)
    return (r.schema(schema) if schema is not None else r).load(path)


def write_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines."""
    events.write.mode("append").json(path)
