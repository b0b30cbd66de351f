"""Registered queries: a name, a Spark plan and, where DuckDB can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowgauge.suite.sql_views import oracle, recursive
from flowgauge.suite.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Dates and moments as text and 32-bit counts as they are, so both engines print the same values."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def query(name: str, sql: str | None = None, walk: str | None = None, **extra: str):
    """Register ``build(views)`` under ``name``; ``sql`` is its DuckDB twin over the derived views.

    ``walk`` is the body of a recursive table the twin reads under that name.
    """

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: flat(build(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = recursive(walk, sql, **extra) if walk else oracle(sql, **extra)
        return build

    return register
