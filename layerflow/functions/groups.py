"""Measuring how rows spread over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import col
from layerflow.session import cut, max_group_rows


def _large(df: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*[col(k) for k in by]).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.where(F.col("__rows") > max_group_rows(df.sparkSession))


def hot_groups(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """How many groups exceed what one task should hold, and the rows they have. Reads the
    keys only and combines counts before the shuffle."""
    n_hot, n_rows = _large(df, by).agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    return n_hot, n_rows


def hot_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The keys of such groups, written down: at most (all rows / maxGroupRows) of them."""
    return cut(_large(df, by).drop("__rows"))
