"""Column functions that models share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def value_tier(value: Column, tiers: list[tuple[str, float]], rest: str) -> Column:
    """The first tier whose lower bound the value reaches; tiers from the highest bound down."""
    out = None
    for name, least in tiers:
        out = (F.when if out is None else out.when)(value >= least, name)
    return out.otherwise(rest) if out is not None else F.lit(rest)


def safe_number(value: Column, default: float = 0.0) -> Column:
    """A number of at least 0; what can't be read as one is the default."""
    return F.greatest(F.coalesce(F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double"), F.lit(default)), F.lit(0.0))


def rounded(value: Column, places: int) -> Column:
    """value * 10^places rounded half up, over 10^places, as DuckDB rounds doubles. F.round goes by a double's shortest decimal text, so a sum just under a half (14.649999999999999) goes down where this goes up."""
    return F.round(value * 10.0**places) / 10.0**places


def floor_index(values: Column, p: float) -> Column:
    """Element int(n * p), at most the last, of an array's sorted values: neither linear nor SQL's discrete percentile."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, F.least(F.floor(F.size(values) * F.lit(p)) + 1, F.size(values)).cast("int"))
