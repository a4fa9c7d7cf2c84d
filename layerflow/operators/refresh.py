"""Publishing tables, appending, incremental refresh and seeding history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import as_list, col
from layerflow.operators.joins import attach

# Fixed values.
LAYERS = ("staging", "intermediate", "marts")
APPEND = "outputOperationTypeAppend"


def _write(df: DataFrame, path: str, mode: str, partition_by: str | Sequence[str] | None) -> None:
    """Store a table. With partition columns the rows are rebalanced on them first: a value
    with few rows makes one file, a value with very many is split over several tasks."""
    columns = as_list(partition_by)
    if not columns:
        df.write.mode(mode).parquet(path)
        return
    df.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns).parquet(path)


def _read_back(df: DataFrame, path: str) -> DataFrame:
    """The stored table with the columns, order and types of the DataFrame written."""
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return stored.select(*[col(c) for c in df.columns])


def publish(
    df: DataFrame,
    root: str,
    layer: str,
    name: str,
    partition_by: str | Sequence[str] | None = None,
    bucket_by: str | Sequence[str] | None = None,
    buckets: int = 200,
) -> DataFrame:
    """Full refresh of a published table; gives back the stored table. Publishing a table
    read from another layer unchanged is a thin republish.

    ``partition_by`` lays the table out for filters. ``bucket_by`` stores it bucketed and
    sorted under its name in the session catalog: tables with the same bucket keys and number
    are joined and grouped on those keys without a shuffle.
    """
    if layer not in LAYERS:
        raise ValueError(f"layer must be one of {LAYERS}")
    path = f"{root}/{layer}/{name}"
    keys = as_list(bucket_by)
    if not keys:
        _write(df, path, "overwrite", partition_by)
        return _read_back(df, path)
    if partition_by is not None:
        raise ValueError("publish: choose partition columns or bucket columns")
    # One task per bucket writes one file per bucket; the join later reads it as it lies.
    placed = df.repartition(buckets, *[col(k) for k in keys])
    writer = placed.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """A live table: the column mapping stays a view and nothing is stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_extract(df: DataFrame, path: str) -> DataFrame:
    _write(df, path, "overwrite", None)
    return _read_back(df, path)


def stored_table(df: DataFrame, path: str, partition_by: str | Sequence[str] | None = None) -> DataFrame | None:
    """The table at ``path``, or None when nothing has been written there yet. Partition
    columns come with the types they have in ``df``, as paths do not tell types."""
    try:
        stored = df.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    kinds = {f.name: f.dataType for f in df.schema.fields}
    named = [c for c in as_list(partition_by) if c in stored.columns and c in kinds]
    return stored.withColumns({c: col(c).cast(kinds[c]) for c in named})


def _require_fit(df: DataFrame, stored: DataFrame) -> None:
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    if mine != theirs:
        differing = sorted(n for n in mine.keys() | theirs.keys() if mine.get(n) != theirs.get(n))
        raise ValueError(f"append: columns {differing} do not fit the stored table")


def append(df: DataFrame, path: str, partition_by: str | Sequence[str] | None = None) -> None:
    """Append all rows. Appending a whole snapshot to a filled output stores it twice."""
    stored = stored_table(df, path, partition_by)
    if stored is not None:
        _require_fit(df, stored)
    _write(df, path, "append", partition_by)


def newer_rows(src: DataFrame, stored: DataFrame | None, control: str, output_field: str) -> DataFrame:
    """Rows of ``src`` past the largest control value stored, strictly. The value becomes a
    literal, so the filter reaches the Parquet reader and skips row groups. With nothing
    stored every row is new."""
    if control not in src.columns:
        raise ValueError(f"incremental refresh: control column {control!r} is gone from the source")
    if stored is None:
        return src
    if output_field not in stored.columns:
        raise ValueError(f"incremental refresh: the output has no column {output_field!r}")
    mark = stored.agg(F.max(col(output_field))).first()[0]
    return src if mark is None else src.where(col(control) > F.lit(mark))


def incremental_append(
    src: DataFrame,
    out: str,
    control: str,
    output_field: str | None = None,
    mode: str = "incremental",
    partition_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Append to ``out`` and give back the stored table.

    ``mode="incremental"`` appends only rows whose control value is above everything stored
    in ``output_field``; ties with the mark count as known. ``mode="full"`` appends the whole
    snapshot, which stores known rows again. Schema and control column are checked before
    anything is written. One writer at a time: the mark is read before the append. Only the
    control column of the output is read for the mark; ``partition_by`` stores the output by
    columns, for readers that filter on them.
    """
    if mode not in ("incremental", "full"):
        raise ValueError("mode must be 'incremental' or 'full'")
    stored = stored_table(src, out, partition_by)
    if stored is not None:
        _require_fit(src, stored)
    fresh = src if mode == "full" else newer_rows(src, stored, control, output_field or control)
    _write(fresh, out, "append", partition_by)
    return _read_back(src, out)


def refresh_settings(settings: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each refresh setting with its output: all columns of ``settings``, then ``status`` and
    ``is_incremental_default``.

    A setting is ``effective`` when it is enabled and names control field and output, ``inert``
    when it is enabled and lacks one of them, ``off`` otherwise. ``outputs`` has one row per
    output_node_id; a setting whose output is unknown has a null default.
    """
    def given(name: str):
        return F.coalesce(col(name), F.lit("")) != ""

    enabled = F.coalesce(col("incremental_enabled"), F.lit(False))
    complete = given("control_field") & given("output_node_id")
    status = F.when(~enabled, F.lit("off")).when(complete, F.lit("effective")).otherwise(F.lit("inert"))
    defaults = outputs.select(col("output_node_id").alias("__output"), "is_incremental_default")
    return attach(settings.withColumn("status", status), defaults, [("output_node_id", "__output")], unique=True)


def refresh_mode(settings: DataFrame, outputs: DataFrame, by: str) -> DataFrame:
    """Full or incremental, per table (column ``by``), and the control fields in use.

    ``settings``: incremental_enabled, control_field, output_node_id; ``outputs``:
    output_operation_type, incremental_output_operation_type. Incremental needs an enabled
    setting that names both control field and output, and an output that appends in either
    kind of run. An enabled setting that lacks one of them is inert: counted and ignored.
    Settings and outputs are stacked, so one grouping serves both.
    """
    def given(name: str):
        return F.coalesce(col(name), F.lit("")) != ""

    enabled = F.coalesce(col("incremental_enabled"), F.lit(False))
    complete = given("control_field") & given("output_node_id")
    appends = (col("output_operation_type") == APPEND) | (col("incremental_output_operation_type") == APPEND)
    asked = settings.select(
        col(by),
        (enabled & complete).alias("effective"),
        (enabled & ~complete).alias("inert"),
        F.lit(False).alias("appends"),
        F.when(enabled & complete, col("control_field")).alias("control_field"),
    )
    offered = outputs.select(
        col(by),
        F.lit(False).alias("effective"),
        F.lit(False).alias("inert"),
        F.coalesce(appends, F.lit(False)).alias("appends"),
        F.lit(None).cast("string").alias("control_field"),
    )
    found = asked.unionByName(offered).groupBy(col(by)).agg(
        F.count_if("effective").alias("n_effective"),
        F.count_if("inert").alias("n_inert"),
        F.bool_or("appends").alias("has_append"),
        # distinct column names of one table: a short list
        F.array_join(F.array_sort(F.collect_set("control_field")), ", ").alias("control_fields"),
    )
    incremental = (F.col("n_effective") > 0) & F.col("has_append")
    return found.withColumn("run_type", F.when(incremental, F.lit("incremental")).otherwise(F.lit("full")))


def backfill(new: DataFrame, old: DataFrame, control: str) -> DataFrame:
    """The new output with the old output's rows from before the new one's first control
    value. With an empty new output all old rows are taken."""
    first = new.agg(F.min(col(control))).first()[0]
    older = old if first is None else old.where(col(control) < F.lit(first))
    return older.select(*[col(c) for c in new.columns]).unionByName(new)
