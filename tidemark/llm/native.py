"""Column helpers for operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, with value computed once a row, not once an element of a lambda inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def running(lens: Column, block: int = 128) -> Column:
    """Sum of the elements before each, for an array of ints; in blocks, so that long arrays cost little more than their length."""

    def starts(blocks: Column) -> Column:
        return let(
            F.transform(blocks, total),
            lambda sums: F.flatten(F.transform(blocks, lambda b, j: let(total(F.slice(sums, F.lit(1), j)), lambda s: F.transform(b, lambda _, i: s + total(F.slice(b, F.lit(1), i)))))),
        )

    return let(
        lens,
        lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(
            let(F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(block)), lambda at: F.slice(x, at + 1, F.lit(block))), starts)
        ),
    )


def row_key(id_col: Column, text: Column) -> Column:
    """A long that equal (id, text) share; for marks that only say which rows are looked at once more."""
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """Two longs, k1 and k2, that equal (id, text) share: 128 bits, so that unlike rows don't share both."""
    i, t = F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    return [F.xxhash64(i, t).alias("k1"), F.xxhash64(F.lit(1), t, i).alias("k2")]
