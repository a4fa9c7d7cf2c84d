"""Row concatenation with field mapping."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import col, require_columns, require_distinct

TABLE_NAMES = "Table Names"


def union_mapped(
    inputs: Mapping[str, DataFrame], mappings: Mapping[str, Mapping[str, str]] | None = None
) -> DataFrame:
    """Stack named inputs. ``mappings[input]`` sends that input's columns to result columns;
    columns without an entry keep their names, columns an input lacks are null. The column
    ``Table Names`` tells the input a row came from."""
    if not inputs:
        raise ValueError("union_mapped: no inputs")
    mappings = mappings or {}
    parts = []
    for name, df in inputs.items():
        mapping = mappings.get(name, {})
        require_columns(df, mapping, f"union_mapped, input {name}")
        columns = [mapping.get(c, c) for c in df.columns]
        require_distinct(columns, f"union_mapped, input {name}")
        parts.append(
            df.select(*[col(c).alias(n) for c, n in zip(df.columns, columns, strict=True)],
                      F.lit(name).alias(TABLE_NAMES))
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def self_union(
    df: DataFrame,
    branch_a: Callable[[DataFrame], DataFrame],
    branch_b: Callable[[DataFrame], DataFrame],
    names: tuple[str, str] = ("branch_a", "branch_b"),
) -> DataFrame:
    """One source cleaned in two ways and stacked again."""
    return union_mapped({names[0]: df.transform(branch_a), names[1]: df.transform(branch_b)})
