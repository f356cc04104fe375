"""Query name to builder and to the DuckDB text it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import with_views

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under its name; sql may use the fixture views."""

    def add(f: Builder) -> Builder:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def load() -> None:
    from .plans import graphs, models, quality, reports, states, statistics, streams  # noqa: F401


load()
