"""Column names and types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type names of the data model and the Spark types that hold them.
TYPE_NAMES = {
    "string": "string",
    "real": "double",
    "integer": "bigint",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
}


def spark_type(name: str) -> str:
    """The Spark type for a data-model type name; any Spark type name passes through."""
    return TYPE_NAMES.get(name, name)


def col(name: str) -> Column:
    """Reference a column by its exact name, dots and brackets included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def as_pairs(on: str | Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    """Join keys as (left, right) pairs."""
    items = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in items]


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: no column {missing} among {df.columns}")


def require_distinct(names: Sequence[str], what: str) -> None:
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"{what}: the result would have several columns named {twice}")
