"""Streams into versioned tables: every batch is one commit, and none reads the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.functions.names import as_list, col, require_columns
from layerflow.operators.versions import append_version, current_version, read_version


def version_stream(
    spark: SparkSession,
    src_dir: str,
    path: str,
    control: str,
    checkpoint: str,
    schema: T.StructType | str,
    late: str = "drop",
    files_per_batch: int | None = None,
    partition_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Append the files that have arrived in ``src_dir`` since the last call to the versioned
    table at ``path``, and give it back.

    Each micro-batch becomes one version that holds its rows, the new mark and the batch's
    number, so a batch that is replayed after a failure is recognised and skipped. With
    ``late="drop"`` rows at or below the mark are left out, with ``late="keep"`` all are kept.
    The mark comes from the newest version, never from the table's rows. A lost checkpoint
    replays all files: ``late="drop"`` then still adds nothing, ``late="keep"`` needs the
    checkpoint kept with the table.
    """
    if late not in ("drop", "keep"):
        raise ValueError("late must be 'drop' or 'keep'")
    mode = "incremental" if late == "drop" else "full"

    def take(batch: DataFrame, batch_id: int) -> None:
        append_version(batch, path, control, mode, partition_by, batch=(checkpoint, batch_id))

    _run(spark, src_dir, schema, files_per_batch, checkpoint, take)
    return spark.createDataFrame([], schema) if current_version(spark, path) is None else read_version(spark, path)


def _run(spark, src_dir, schema, files_per_batch, checkpoint, take, shape=lambda rows: rows, mode="append") -> None:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        shape(reader.parquet(src_dir))
        .writeStream.foreachBatch(take)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_rows(changes: DataFrame, key: str | Sequence[str], ts: str) -> DataFrame:
    """The latest row of each key in a log of changes; of equal times the larger row stands."""
    keys = as_list(key)
    rest = [c for c in changes.columns if c not in keys and c != ts]
    top = F.max(F.struct(col(ts), *[col(c) for c in rest])).alias("__row")
    found = changes.groupBy(*[col(k) for k in keys]).agg(top)
    return found.select(*[col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in changes.columns])


def ledger_stream(
    spark: SparkSession,
    src_dir: str,
    path: str,
    checkpoint: str,
    schema: T.StructType | str,
    key: str | Sequence[str],
    ts: str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Keep the latest row of each key over arriving files of run records, and give the ledger
    back.

    The state store of the stream holds the ledger, one row for each key, so a batch is merged
    with its own keys' states only: no batch reads what is stored. Batches add the keys that
    changed to a versioned log, one commit each, with the batch's number against replays; the
    ledger is the log's latest row of each key. Late rows lose against later ones and ties
    are settled by the larger row, so order and repeats of files do not matter. Rows with a null
    time lose against all others; a null key is a key. ``compact_ledger`` shortens the log.
    """
    keys = as_list(key)
    empty = spark.createDataFrame([], schema)
    require_columns(empty, [*keys, ts], "ledger_stream")

    def shape(rows: DataFrame) -> DataFrame:
        return latest_rows(rows, keys, ts)

    def take(batch: DataFrame, batch_id: int) -> None:
        append_version(batch, path, ts, "full", batch=(checkpoint, batch_id))

    _run(spark, src_dir, schema, files_per_batch, checkpoint, take, shape, "update")
    return empty if current_version(spark, path) is None else latest_rows(read_version(spark, path), keys, ts)


def compact_ledger(spark: SparkSession, path: str, key: str | Sequence[str], ts: str) -> DataFrame:
    """Store the log's latest rows only, as the next version; batches stay known."""
    from layerflow.operators.versions import publish_version

    return publish_version(latest_rows(read_version(spark, path), key, ts), path)
