"""Python script steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from layerflow.functions.names import as_list, col

Script = Callable[[pd.DataFrame], pd.DataFrame]
Schema = str | T.StructType

# Partial rows a task holds before it combines them.
BUFFERED_ROWS = 100_000


def script(df: DataFrame, fn: Script, schema: Schema, columns: Sequence[str] | None = None) -> DataFrame:
    """Run a Python function over the table, one Arrow batch at a time. The function must
    treat rows independently; ``columns`` limits what is sent to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    sent = df if columns is None else df.select(*[col(c) for c in columns])
    return sent.mapInPandas(run, schema)


def script_by(
    df: DataFrame, by: str | Sequence[str], fn: Script, combine: Script, schema: Schema
) -> DataFrame:
    """Run a Python function per group, for groups of any size.

    Both functions get rows of many groups at once and work per group themselves, as pandas
    ``groupby`` does. ``fn`` turns part of the table (group columns included) into rows of
    ``schema``; ``combine`` merges rows of ``schema``, and gives the same result in whatever
    order and portions it is applied. Parts are merged inside each task first, so a group
    that fills a third of the table sends a few rows per task and is never gathered. Merging
    then streams over sorted partitions and holds one batch and one open group.
    """
    keys = as_list(by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(fn(batch))
            if sum(len(h) for h in held) > BUFFERED_ROWS:
                merged = combine(pd.concat(held, ignore_index=True))
                held = [merged]
                if len(merged) > BUFFERED_ROWS / 2:  # mostly different groups: pass them on
                    yield merged
                    held = []
        if held:
            yield combine(pd.concat(held, ignore_index=True))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
            last = rows[keys].iloc[-1]
            open_group = (rows[keys].eq(last) | (rows[keys].isna() & last.isna())).all(axis=1)
            if not open_group.all():
                yield combine(rows[~open_group])
            carried = combine(rows[open_group])
        if carried is not None and len(carried):
            yield carried

    gathered = df.mapInPandas(partial, schema).repartition(*[col(k) for k in keys])
    return gathered.sortWithinPartitions(*[col(k) for k in keys]).mapInPandas(merge, schema)
