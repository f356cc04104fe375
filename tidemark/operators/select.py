"""Filters, top-N and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_open(column: str, start: str, end: str) -> Column:
    """start <= column < end; plain comparisons, so that they reach the scan."""
    return (F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp"))


def contains_ignoring_case(column: str, part: str) -> Column:
    """ILIKE '%part%' with part taken literally."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark drops rows beyond n before the shuffle."""
    rn = "row number in top_n"
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(f"`{rn}`") <= n).drop(rn)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def offset_page(df: DataFrame, order: list[Column], size: int, offset: int = 0, most: int = 500) -> DataFrame:
    """order needs a unique tiebreak; pages hold at most `most` rows."""
    return df.orderBy(*order).offset(offset).limit(min(size, most))


def keyset_page(df: DataFrame, ts: str, key: str, cursor: tuple[str, int] | None, size: int) -> DataFrame:
    """The page after cursor (ts, key), newest first."""
    if cursor:
        at = F.lit(cursor[0]).cast("timestamp")
        df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < cursor[1])))
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(size)
