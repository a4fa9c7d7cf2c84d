"""Pivots and generated rows.

New rows are found from the gaps between neighbouring steps, never by crossing keys with a
calendar: rows are first reduced to one per group and step, each gap is exploded where it
stands, and the original rows pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.functions.names import as_list, col, require_columns
from layerflow.functions.periods import index_start, period_index
from layerflow.operators.aggregates import Aggs, _parts, _SIMPLE
from layerflow.operators.joins import match_struct
from layerflow.session import cut

# Steps per window group while looking for gaps; a longer series is handled in chunks.
CHUNK_STEPS = 100_000
# Steps that one row is exploded into at a time; longer gaps become several rows first, which
# are spread over tasks.
EXPLODE_STEPS = 10_000


def pivot(df: DataFrame, by: str | Sequence[str], column: str, values: Sequence[Any], aggs: Aggs) -> DataFrame:
    """Rows to columns for the given values: one shuffle, no pass to find the values."""
    parts = _parts(aggs)
    if "median" in {fn for fn, _ in parts.values()}:
        raise ValueError("pivot: aggregate the median first, then pivot it with max")
    measures = [_SIMPLE[fn](v).alias(n) for n, (fn, v) in parts.items()]
    return df.groupBy(*[col(k) for k in as_list(by)]).pivot(column, list(values)).agg(*measures)


def unpivot(
    df: DataFrame, ids: str | Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Columns to rows; null values keep their rows."""
    return df.unpivot([col(c) for c in as_list(ids)], [col(c) for c in columns], name, value)


def _explode_steps(df: DataFrame, name: str, first: Column, last: Column, step: int) -> DataFrame:
    """A row for each of ``first``, ``first + step``, … up to ``last``, for a run of any length."""
    span = F.lit(step * EXPLODE_STEPS).cast("bigint")
    runs = df.withColumns({"__from": first.cast("bigint"), "__upto": last.cast("bigint")}).where("__from <= __upto")
    runs = runs.withColumn("__from", F.explode(F.sequence("__from", "__upto", span))).hint("rebalance")
    upto = F.least(F.col("__from") + span - step, F.col("__upto"))
    return runs.withColumn(name, F.explode(F.sequence("__from", upto, F.lit(step).cast("bigint")))).drop("__from", "__upto")


def _gaps(present: DataFrame, by: list[str], step: int) -> DataFrame:
    """Missing ``__step`` values between neighbours of a table with one row per group and
    step. Other columns are those of the row before the gap."""
    chunked = present.withColumn("__chunk", F.floor(F.col("__step") / (CHUNK_STEPS * step)))
    keys = [col(k) for k in by]
    firsts = chunked.groupBy(*keys, "__chunk").agg(F.min("__step").alias("__first"))
    after = Window.partitionBy(*keys).orderBy("__chunk")
    onward = firsts.select(*keys, "__chunk", F.lead("__first").over(after).alias("__onward"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__step")
    stepped = chunked.withColumn("__next", F.lead("__step").over(inside))
    linked = match_struct(stepped, onward, [(k, k) for k in [*by, "__chunk"]], "left")
    following = F.coalesce(F.col("__next"), F.col("__onward"))
    open_ = linked.withColumn("__next", following).where(F.col("__next") > F.col("__step") + step)
    filled = _explode_steps(open_, "__step", F.col("__step") + step, F.col("__next") - 1, step)
    return filled.drop("__chunk", "__next", "__onward")


def _fill(df: DataFrame, by: list[str], column: str, index: Column, back: Column, step: int, fill: str) -> DataFrame:
    if fill not in ("null", "carry"):
        raise ValueError("fill must be 'null' or 'carry'")
    others = [c for c in df.columns if c not in by and c != column]
    indexed = df.where(col(column).isNotNull()).withColumn("__step", index)
    groups = indexed.groupBy(*[col(k) for k in by], "__step")
    if fill == "carry":  # the latest row of a step stands for it
        latest = F.max(F.struct(col(column).alias("__at"), *[col(c) for c in others])).alias("__row")
        present = groups.agg(latest)
        values = {c: F.col("__row").getField(c) for c in others}
    else:
        present = groups.agg(F.lit(None).cast("int").alias("__row"))
        values = {c: F.lit(None) for c in others}
    missing = _gaps(present, by, step)
    made = {**{k: col(k) for k in by}, column: back, **values}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.unionByName(missing.select(*[made[c].cast(kinds[c]).alias(c) for c in df.columns]))


def fill_dates(
    df: DataFrame, by: str | Sequence[str], ts: str, step: str = "day", fill: str = "null"
) -> DataFrame:
    """Add a row for every calendar step a group skips between its first and last.

    New rows stand at the start of their step. Other columns are null, or with
    ``fill="carry"`` those of the latest row before the gap.
    """
    keys = as_list(by)
    require_columns(df, [*keys, ts], "fill_dates")
    return _fill(df, keys, ts, period_index(col(ts), step), index_start(F.col("__step"), step), 1, fill)


def fill_sequence(
    df: DataFrame,
    by: str | Sequence[str],
    column: str,
    step: int = 1,
    lo: int | None = None,
    hi: int | None = None,
    fill: str = "null",
) -> DataFrame:
    """Add a row for every number a group skips, counting by ``step`` from its smallest (or
    ``lo``) to its largest (or ``hi``). Groups must lie on the grid the step draws."""
    keys = as_list(by)
    require_columns(df, [*keys, column], "fill_sequence")
    value = col(column).cast("bigint")
    filled = _fill(df, keys, column, value, F.col("__step"), step, fill)
    if lo is None and hi is None:
        return filled
    ends = df.groupBy(*[col(k) for k in keys]).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    made_of = []
    if lo is not None:
        made_of.append(F.struct(F.lit(lo).cast("bigint").alias("__first"), (F.col("__lo") - step).alias("__last")))
    if hi is not None:
        made_of.append(F.struct((F.col("__hi") + step).alias("__first"), F.lit(hi).cast("bigint").alias("__last")))
    sides = ends.select(*[col(k) for k in keys], F.inline(F.array(*made_of)))
    outer = _explode_steps(sides, column, F.col("__first"), F.col("__last"), step)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    made = [
        (col(c) if c in keys or c == column else F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns
    ]
    return filled.unionByName(outer.select(*made))


#: Members of a domain table are numbered in parts of about this size.
DOMAIN_PART = 100_000


def _every_member(groups: DataFrame, key: str, domain: DataFrame, kind: T.DataType) -> DataFrame:
    """Each group with each member of a domain table: members are numbered from 1 within hash
    parts, the numbers are exploded where the group stands, and an equi-join on part and number
    brings the member. Only the parts' sizes reach the driver."""
    members = cut(domain.select(col(domain.columns[0]).cast(kind).alias("__member")).where("__member is not null").distinct())
    parts = members.count() // DOMAIN_PART + 1
    place = F.pmod(F.xxhash64("__member"), F.lit(parts))
    order = Window.partitionBy("__part").orderBy("__member")
    numbered = members.withColumn("__part", place).withColumn("__number", F.row_number().over(order).cast("bigint"))
    sizes = [(r["__part"], r["count"]) for r in numbered.groupBy("__part").count().collect()]
    listed = F.array(*[F.struct(F.lit(p).cast("bigint").alias("__part"), F.lit(n).cast("bigint").alias("__size")) for p, n in sizes])
    if not sizes:
        return groups.where(F.lit(False)).withColumn(key, F.lit(None).cast(kind))
    spread = groups.select("*", F.inline(listed))
    spread = _explode_steps(spread, "__number", F.lit(1), F.col("__size"), 1).drop("__size")
    met = spread.join(numbered, ["__part", "__number"])
    return met.withColumnRenamed("__member", key).drop("__part", "__number")


def add_missing_rows(
    df: DataFrame, by: str | Sequence[str], key: str, values: Sequence[Any] | DataFrame
) -> DataFrame:
    """A row, null elsewhere, for every value of ``key`` in the declared domain ``values`` that
    a ``by`` group lacks. The domain is a list, or a table whose first column holds it. Null is
    not a member of the domain and repeated members count once.

    Groups are reduced to one row each, the domain is exploded where the group stands, and
    what the group has is taken away; the rows of ``df`` pass through untouched.
    """
    keys = as_list(by)
    require_columns(df, [*keys, key], "add_missing_rows")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    have = df.where(col(key).isNotNull()).select(*[col(k) for k in keys], col(key)).distinct()
    groups = df.select(*[col(k) for k in keys]).distinct()
    if isinstance(values, DataFrame):
        wanted = _every_member(groups, key, values, kinds[key])
    else:
        listed = F.array(*[F.lit(v).cast(kinds[key]) for v in dict.fromkeys(values) if v is not None])
        wanted = groups.withColumn(key, F.explode(listed.cast(f"array<{kinds[key].simpleString()}>")))
    missing = match_struct(wanted, have, [(k, k) for k in [*keys, key]], "left_anti")
    return df.unionByName(
        missing.select(
            *[(col(c) if c in keys or c == key else F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns]
        )
    )
