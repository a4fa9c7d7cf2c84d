"""Metric series and the consumers of published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerflow.functions.names import as_list, col
from layerflow.functions.periods import index_start, period_index
from layerflow.operators.aggregates import aggregate
from layerflow.operators.joins import attach, exists_in, match_struct
from layerflow.operators.windows import accumulate


def metric(
    df: DataFrame,
    measure: str | Column,
    agg: str,
    ts: str,
    grain: str,
    filters: Sequence[str | Column] = (),
    dims: str | Sequence[str] = (),
    running_total: bool = False,
    compare: str | None = None,
) -> DataFrame:
    """A measure by period, split by dimensions: ``dims…, period, value``.

    ``running_total`` adds the sum so far (sums and counts only); ``compare="previous"`` adds
    the value of the calendar period before, the change, and the ratio (null on a zero or
    missing base). A running total over dimensions is a window on the aggregated series, which
    has one row per period of the calendar; the total of everything, whose series at a fine
    grain has no bound, is summed piece by piece. The period before is looked up by a join.
    """
    keys = as_list(dims)
    if running_total and agg not in ("sum", "count"):
        raise ValueError(f"a running total of {agg!r} is not additive")
    if compare not in (None, "previous"):
        raise ValueError("compare must be None or 'previous'")
    rows = df
    for test in filters:
        rows = rows.where(test)
    rows = rows.withColumn("__index", period_index(col(ts), grain))
    series = aggregate(rows, [*keys, "__index"], {"value": (agg, measure)})
    out = series.withColumn("period", index_start(F.col("__index"), grain))
    if running_total and keys:
        split = Window.partitionBy(*[col(k) for k in keys]).orderBy("__index")
        so_far = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("running_total", F.sum("value").over(so_far))
    elif running_total:
        out = accumulate(out, [], "__index", "running_total", "value")
    if compare:
        before = series.select(*[col(k) for k in keys], (F.col("__index") + 1).alias("__index"), F.col("value").alias("previous"))
        out = match_struct(out, before, [(k, k) for k in [*keys, "__index"]], "left")
        out = out.withColumns(
            {
                "change": F.col("value") - F.col("previous"),
                "ratio": F.try_divide(F.col("value").cast("double"), F.col("previous").cast("double")),
            }
        )
    order = [*keys, "period", "value", *[c for c in out.columns if c not in keys]]
    return out.select(*[col(c) for c in dict.fromkeys(order) if c != "__index"])


# What to do about the consumers of a table.
REPOINT, CLEANUP_ONLY, NONE = "repoint", "cleanup_only", "none"


def consumer_impact(
    targets: DataFrame,
    reports: DataFrame,
    definitions: DataFrame,
    metrics: DataFrame,
    subscriptions: DataFrame,
    dataset: str = "dataset",
) -> DataFrame:
    """Consumers per target table and the verdict.

    ``reports`` (dataset, …), ``definitions`` (definition, dataset), ``metrics`` (definition,
    metric), ``subscriptions`` (metric). A definition is followed when any of its metrics is
    subscribed to. Reports or followed definitions: repoint; only unfollowed definitions:
    cleanup_only; nothing: none.
    """
    names = ("reports", "definitions", "definitions_followed")

    def ones(rows: DataFrame, counted: str) -> DataFrame:
        return rows.select(col(dataset), *[F.lit(int(n == counted)).alias(n) for n in names])

    followed = exists_in(definitions, exists_in(metrics, subscriptions, "metric"), "definition")
    stacked = ones(reports, names[0]).unionByName(ones(definitions, names[1])).unionByName(ones(followed, names[2]))
    counts = stacked.groupBy(col(dataset)).agg(*[F.sum(n).alias(n) for n in names])
    counted = attach(targets, counts, dataset, unique=True)
    counted = counted.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in names})
    verdict = (
        F.when((F.col("reports") > 0) | (F.col("definitions_followed") > 0), F.lit(REPOINT))
        .when(F.col("definitions") > 0, F.lit(CLEANUP_ONLY))
        .otherwise(F.lit(NONE))
    )
    return counted.withColumn("recommendation", verdict)
