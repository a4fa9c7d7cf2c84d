"""Parity between an old and a new table.

Both tables are stacked with a side mark and grouped once, so a comparison costs one
shuffle, copies of a row collapse before it, and no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.functions.names import as_list, col, require_columns
from layerflow.operators.joins import attach, missing_from


def _profile(df: DataFrame, distinct: bool) -> DataFrame:
    """One row per column: nulls, distinct values, smallest and largest value as text."""
    measures = []
    for i, name in enumerate(df.columns):
        measures += [
            F.count_if(col(name).isNull()).alias(f"n{i}"),
            F.min(col(name)).cast("string").alias(f"a{i}"),
            F.max(col(name)).cast("string").alias(f"z{i}"),
        ]
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"n{i}").alias("nulls"),
            F.col(f"a{i}").alias("min"),
            F.col(f"z{i}").alias("max"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    profile = df.agg(*measures).select(F.inline(F.array(*rows)))
    if not distinct:
        return profile.withColumn("distinct", F.lit(None).cast("bigint"))
    # Values as text, by column: one hash aggregate removes repeats before anything is shuffled.
    cells = [F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("cell")) for n in df.columns]
    apart = df.select(F.inline(F.array(*cells))).where(F.col("cell").isNotNull()).distinct()
    counts = apart.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return profile.join(counts, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def column_diff(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per column of either table: where it exists, its type and profile on each
    side, and ``same``. Names must match exactly. Columns must be orderable. Distinct values
    are told apart by their text, in a pass of their own; ``distinct=False`` leaves it out."""
    parts = ("type", "nulls", "distinct", "min", "max")
    sides = [
        _profile(df, distinct).select(
            "column", F.lit(True).alias(f"in_{s}"), *[col(p).alias(f"{p}_{s}") for p in parts]
        )
        for df, s in ((a, "a"), (b, "b"))
    ]
    both = sides[0].join(sides[1], "column", "full_outer")
    agree = [col(f"{p}_a").eqNullSafe(col(f"{p}_b")) for p in parts]
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for test in agree:
        same = same & test
    here = {f"in_{s}": F.coalesce(col(f"in_{s}"), F.lit(False)) for s in "ab"}
    return both.withColumn("same", same).withColumns(here)


def _stack(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("__b", F.lit(0)).unionByName(b.withColumn("__b", F.lit(1)))


def count_diff(a: DataFrame, b: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Row counts of both sides, in all or per group, and ``b - a``."""
    keys = as_list(by)
    marked = _stack(a.select(*[col(k) for k in keys]), b.select(*[col(k) for k in keys]))
    counts = marked.groupBy(*[col(k) for k in keys]).agg(
        F.count_if(F.col("__b") == 0).alias("rows_a"), F.count_if(F.col("__b") == 1).alias("rows_b")
    )
    return counts.withColumn("difference", F.col("rows_b") - F.col("rows_a"))


def _unequal(field: T.StructField, x: Column, y: Column, tol: float) -> Column:
    if tol and isinstance(field.dataType, T.NumericType):
        near = F.abs(x.cast("double") - y.cast("double")) <= F.lit(float(tol))
        return ~(x.eqNullSafe(y) | F.coalesce(near, F.lit(False)))
    return ~x.eqNullSafe(y)


def value_diff(
    a: DataFrame, b: DataFrame, key: str | Sequence[str] | None = None, tol: float = 0.0
) -> DataFrame:
    """Rows that differ; an empty result is parity.

    Without ``key``: every distinct row whose number of copies differs, with ``copies_a`` and
    ``copies_b``. With ``key``: one row per key that differs, with ``status`` (``only_a``,
    ``only_b``, ``differs``, or ``repeated_key`` where a side has the key several times and
    rows cannot be paired) and the ``columns`` that differ by more than ``tol``.
    """
    if set(a.columns) != set(b.columns):
        raise ValueError("value_diff: column names differ; see column_diff")
    if key is None:
        counts = _stack(a, b.select(*[col(c) for c in a.columns])).groupBy(*[col(c) for c in a.columns]).agg(
            F.count_if(F.col("__b") == 0).alias("copies_a"),
            F.count_if(F.col("__b") == 1).alias("copies_b"),
        )
        return counts.where(F.col("copies_a") != F.col("copies_b"))
    keys = as_list(key)
    require_columns(a, keys, "value_diff")
    fields = [f for f in a.schema.fields if f.name not in keys]
    held = [col(f.name) for f in fields] or [F.lit(0).alias("none")]
    packed = [df.select(*[col(k) for k in keys], F.struct(*held).alias("__row")) for df in (a, b)]
    in_a, in_b = F.col("__b") == 0, F.col("__b") == 1
    met = _stack(*packed).groupBy(*[col(k) for k in keys]).agg(
        F.count_if(in_a).alias("__n_a"),
        F.count_if(in_b).alias("__n_b"),
        F.first(F.when(in_a, F.col("__row")), ignorenulls=True).alias("__row_a"),
        F.first(F.when(in_b, F.col("__row")), ignorenulls=True).alias("__row_b"),
    )
    differing = [
        F.when(
            _unequal(f, F.col("__row_a").getField(f.name), F.col("__row_b").getField(f.name), tol),
            F.lit(f.name),
        )
        for f in fields
    ]
    names = F.array_sort(F.array_compact(F.array(*differing))) if differing else F.array().cast("array<string>")
    status = (
        F.when((F.col("__n_a") > 1) | (F.col("__n_b") > 1), F.lit("repeated_key"))
        .when(F.col("__n_b") == 0, F.lit("only_a"))
        .when(F.col("__n_a") == 0, F.lit("only_b"))
        .when(F.size(names) > 0, F.lit("differs"))
    )
    judged = met.select(*[col(k) for k in keys], status.alias("status"), names.alias("columns"))
    empty = F.array().cast("array<string>")
    return judged.where(F.col("status").isNotNull()).withColumn(
        "columns", F.when(F.col("status") == "differs", F.col("columns")).otherwise(empty)
    )


def resolve_pairs(original: DataFrame, successors: DataFrame, name: str, declared: str, successor: str) -> DataFrame:
    """Original outputs and the successors that name them, one row per pair: one original may
    have several successors. An original nobody names, and a successor naming an unknown
    original, come out alone; nothing is paired by resemblance. Successors with a null
    declaration replace nothing and are left out.

    Columns: original, successor, status (``paired``, ``no_successor``, ``unknown_original``).
    """
    known = original.select(col(name).alias("original")).where(F.col("original").isNotNull()).distinct()
    claims = successors.select(col(declared).alias("original"), col(successor).alias("successor")).where(
        F.col("original").isNotNull()
    )
    paired = attach(claims, known, "original", found="__known", unique=True).select(
        "original",
        "successor",
        F.when(F.col("__known"), F.lit("paired")).otherwise(F.lit("unknown_original")).alias("status"),
    )
    alone = missing_from(known, claims, "original").select(
        "original",
        F.lit(None).cast(successors.schema[successor].dataType).alias("successor"),
        F.lit("no_successor").alias("status"),
    )
    return paired.unionByName(alone)
