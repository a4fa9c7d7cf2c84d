"""Named queries over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.sources import read_dataset

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_dataset(spark, root, name)


def number_where(condition: str, key: str) -> Column:
    """A number; where the condition does not hold, one below zero, which nothing matches."""
    return F.expr(f"CASE WHEN {condition} THEN {key} ELSE -1 - {key} END")


def text_where(condition: str, key: str) -> Column:
    """A text; where the condition does not hold, behind a tilde, so that nothing matches."""
    return F.expr(f"CASE WHEN {condition} THEN {key} ELSE concat('~', {key}) END")


def exact(name: str) -> Column:
    """A double as a decimal, so that sums do not depend on the order of the rows."""
    return F.col(name).cast("decimal(18,4)")


def as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})
