"""Aggregate steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.functions.groups import hot_groups
from layerflow.functions.names import as_list, col
from layerflow.functions.periods import period_start
from layerflow.operators.joins import Keys, attach, match_struct
from layerflow.operators.windows import accumulate

Aggs = Mapping[str, str | tuple[str, str | Column]]

_SIMPLE = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "countd": F.countDistinct,
}


def _parts(aggs: Aggs) -> dict[str, tuple[str, Column]]:
    """``{"x": "sum"}`` sums column x into x; ``{"total": ("sum", "x")}`` names the result."""
    parts = {}
    for name, spec in aggs.items():
        fn, source = (spec, name) if isinstance(spec, str) else spec
        if fn not in _SIMPLE and fn != "median":
            raise ValueError(f"unknown aggregate {fn!r}")
        parts[name] = (fn, col(source) if isinstance(source, str) else source)
    return parts


def exact_median(df: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Exact median per group for groups of any size.

    Spark's own median keeps all distinct values of a group in one buffer. Here values are
    counted first, running counts come from the split window, and the one or two values in
    the middle are averaged.
    """
    keys = [col(k) for k in by]
    counts = (
        df.select(*keys, value.cast("double").alias("__value"))
        .where(F.col("__value").isNotNull())
        .groupBy(*keys, "__value")
        .agg(F.count(F.lit(1)).alias("__rows"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("__rows").alias("__all"))
    ranked = accumulate(counts, by, "__value", "__upto", "__rows")
    if by:
        ranked = match_struct(ranked, totals, [(k, k) for k in by], "left")
    else:
        ranked = ranked.withColumn("__all", F.lit(totals.first()[0]))
    low = F.floor((F.col("__all") + 1) / 2)
    high = F.floor((F.col("__all") + 2) / 2)
    before = F.col("__upto") - F.col("__rows")
    hits = [(before < rank) & (rank <= F.col("__upto")) for rank in (low, high)]
    return (
        ranked.where(hits[0] | hits[1])
        .groupBy(*keys)
        .agg(
            (
                (F.max(F.when(hits[0], F.col("__value"))) + F.max(F.when(hits[1], F.col("__value")))) / 2
            ).alias(name)
        )
    )


def aggregate(df: DataFrame, by: str | Sequence[str], aggs: Aggs) -> DataFrame:
    """Group and summarise: sum, avg, min, max, count, countd, median (exact)."""
    keys, parts = as_list(by), _parts(aggs)
    medians = {n: v for n, (fn, v) in parts.items() if fn == "median"}
    grouped = df.groupBy(*[col(k) for k in keys])
    if not medians or not hot_groups(df, keys)[0]:
        return grouped.agg(
            *[(F.median(v) if fn == "median" else _SIMPLE[fn](v)).alias(n) for n, (fn, v) in parts.items()]
        )
    simple = [_SIMPLE[fn](v).alias(n) for n, (fn, v) in parts.items() if fn != "median"]
    result = grouped.agg(*simple) if simple else df.select(*[col(k) for k in keys]).distinct()
    for name, value in medians.items():
        part = exact_median(df, keys, value, name)
        if keys:
            result = match_struct(result, part, [(k, k) for k in keys], "left")
        else:
            result = result.withColumn(name, F.lit(part.first()[0]))
    return result.select(*[col(c) for c in [*keys, *parts]])


def rollup_grain(
    df: DataFrame, ts: str, grain: str, by: str | Sequence[str], measures: Aggs, period: str = "period"
) -> DataFrame:
    """Pre-aggregate a fact to a calendar grain."""
    dated = df.withColumn(period, period_start(col(ts), grain))
    return aggregate(dated, [*as_list(by), period], measures)


def recompute_check(
    stored: DataFrame, fact: DataFrame, by: str | Sequence[str], measures: Aggs, tol: float = 0.0
) -> DataFrame:
    """Groups where a stored aggregate does not equal re-aggregation of the atomic fact."""
    from layerflow.operators.parity import value_diff

    keys = as_list(by)
    again = aggregate(fact, keys, measures)
    return value_diff(stored.select(*[col(c) for c in again.columns]), again, key=keys, tol=tol)


def classify_max(
    df: DataFrame, rules: DataFrame, key: Keys, group: str | Sequence[str], rank: str = "rank", label: str = "class"
) -> DataFrame:
    """Class of each group: rows get a class from ``rules`` (key, class, rank), the class
    with the highest rank stands for the group. Groups without any ruled row have null."""
    ruled = attach(df, rules, key)
    ranked = F.when(col(rank).isNotNull(), F.struct(col(rank), col(label)))
    best = ruled.groupBy(*[col(g) for g in as_list(group)]).agg(F.max(ranked).alias("__top"))
    return best.select(
        *[col(g) for g in as_list(group)],
        F.col("__top")[label].alias(label),
        F.col("__top")[rank].alias(rank),
    )
