"""Values computed over groups and placed on every row, safe for hot groups.

A window hands one whole group to one task. ``fixed`` avoids the window: it aggregates (with
map-side combine) and joins back. Row numbers and running sums need the order, so groups are
measured first: those within ``spark.layerflow.maxGroupRows`` use the plain window, larger
ones are range-split, numbered piece by piece, and moved up by the size of earlier pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerflow.functions.groups import hot_groups, hot_keys
from layerflow.functions.names import as_list, col, require_columns
from layerflow.operators.joins import match_struct
from layerflow.session import cut, max_group_rows

# Rows of an ungrouped table up to which one task may number them.
TINY_ROWS = 100_000

Order = str | tuple[str, str] | Sequence[str | tuple[str, str]]


def _order_pairs(order: Order) -> list[tuple[str, str]]:
    """``"c"``, ``("c", "desc")``, or a list of these, as (column, direction) pairs."""
    one = isinstance(order, str) or (
        isinstance(order, tuple) and len(order) == 2 and order[1] in ("asc", "desc")
    )
    return [(o, "asc") if isinstance(o, str) else (o[0], o[1]) for o in ([order] if one else order)]


def _sorting(order: Order) -> list[Column]:
    """Sort keys; nulls sort lowest."""
    return [col(c).desc() if d == "desc" else col(c).asc() for c, d in _order_pairs(order)]


def fixed(df: DataFrame, by: str | Sequence[str], agg: str, column: str, name: str) -> DataFrame:
    """Fixed level of detail: an aggregate per ``by`` on every row. Nulls form a group."""
    from layerflow.operators.aggregates import aggregate

    keys = as_list(by)
    per_group = aggregate(df, keys, {name: (agg, column)})
    return match_struct(df, per_group, [(k, k) for k in keys], "left")


def _accumulate(df: DataFrame, by: list[str], sorting: list[Column], value: str | None, name: str) -> DataFrame:
    window = Window.partitionBy(*[col(k) for k in by]).orderBy(*sorting)
    if value is None:
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(col(value)).over(running))


def _accumulate_split(
    df: DataFrame, by: list[str], sorting: list[Column], value: str | None, name: str, n_rows: int
) -> DataFrame:
    """The same over groups of any size. Range partitions follow (by, order), so a group
    covers a run of partitions. Their bounds come from sampling; the result is written so
    that every later step sees one and the same placement."""
    spark = df.sparkSession
    even = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(even, ceil(n_rows / max_group_rows(spark)))
    placed = df.repartitionByRange(pieces, *[col(k).asc() for k in by], *sorting)
    placed = cut(placed.withColumn("__piece", F.spark_partition_id()))
    amount = F.count(F.lit(1)) if value is None else F.sum(col(value))
    totals = placed.groupBy(*[col(k) for k in by], "__piece").agg(amount.alias("__amount"))
    earlier = (
        Window.partitionBy(*[col(k) for k in by])
        .orderBy("__piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Only a group running on from an earlier piece has an offset: one per piece at most, so
    # this side never has more rows than there are pieces.
    offsets = totals.select(
        *[col(k) for k in by], "__piece", F.sum("__amount").over(earlier).alias("__offset")
    ).where(F.col("__offset").isNotNull())
    local = _accumulate(placed, [*by, "__piece"], sorting, value, name)
    keys = [(k, k) for k in [*by, "__piece"]]
    moved = match_struct(local, offsets, keys, "left")
    # A piece that begins with nulls has no sum yet; what the pieces before hold stands there.
    total = F.coalesce(col(name) + F.col("__offset"), col(name), F.col("__offset"))
    return moved.withColumn(name, total).drop("__piece", "__offset")


def accumulate(df: DataFrame, by: Sequence[str], order: Order, name: str, value: str | None = None) -> DataFrame:
    """Row number (``value=None``) or running sum per group, in an order that tells all rows
    of a group apart. Only the rows of hot groups are range-split; without ``by`` the whole
    table is one group, and is split unless it is measured to be tiny."""
    keys, sorting = list(by), _sorting(order)
    if not keys:
        n_rows = df.count()
        if n_rows <= min(TINY_ROWS, max_group_rows(df.sparkSession)):
            return _accumulate(df, keys, sorting, value, name)
        return _accumulate_split(df, keys, sorting, value, name, n_rows)
    n_hot, n_rows = hot_groups(df, keys)
    if not n_hot:
        return _accumulate(df, keys, sorting, value, name)
    hot = hot_keys(df, keys)
    pairs = [(k, k) for k in keys]
    cold_rows = match_struct(df, hot, pairs, "left_anti")
    hot_rows = match_struct(df, hot, pairs, "left_semi")
    return _accumulate(cold_rows, keys, sorting, value, name).unionByName(
        _accumulate_split(hot_rows, keys, sorting, value, name, n_rows)
    )


def row_number(df: DataFrame, by: str | Sequence[str], order: Order, name: str) -> DataFrame:
    """Number the rows of each group from 1. The order must end in a column that tells rows
    apart, or the numbers are not repeatable."""
    return accumulate(df, as_list(by), order, name)


def renumber(df: DataFrame, by: str | Sequence[str], order: Order, name: str) -> DataFrame:
    """Number again after filtering: the old number gives the order unless one is given, and
    is replaced. Column order stays."""
    require_columns(df, [name], "renumber")
    kept = df.withColumnRenamed(name, "__old")
    keys = [("__old", d) if c == name else (c, d) for c, d in _order_pairs(order or name)]
    return row_number(kept, by, keys, name).select(*[col(c) for c in df.columns])
