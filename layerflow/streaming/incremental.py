"""Incremental refresh over a stream of arriving files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from layerflow.functions.names import as_list, col
from layerflow.operators.refresh import incremental_append, stored_table

# The folders of batches that are kept whole.
BATCH = "batch_id"


def incremental_stream(
    spark: SparkSession,
    src_dir: str,
    out: str,
    control: str,
    checkpoint: str,
    schema: T.StructType | str,
    output_field: str | None = None,
    files_per_batch: int | None = None,
    partition_by: str | Sequence[str] | None = None,
    late: str = "drop",
) -> DataFrame:
    """Append every file that has arrived in ``src_dir`` since the last call, batch by batch,
    and give back the stored table.

    With ``late="drop"`` each micro-batch is an incremental append, so a batch that is replayed
    after a failure finds its rows at or below the mark and adds nothing. The result equals the
    batch refresh when files arrive in control order; a row at or below the mark, also one that
    ties with it in a later file, is late and is left out.

    With ``late="keep"`` every row is kept, whatever its control value: each batch has a folder
    of its own in ``out``, named by the batch, and a replayed batch replaces its folder, so it
    is stored once. The output is not read, and the checkpoint must be kept with it. Outputs of
    the two kinds do not mix. ``checkpoint`` and ``out`` must lie in storage all executors reach.
    """
    if late not in ("drop", "keep"):
        raise ValueError("late must be 'drop' or 'keep'")
    columns = as_list(partition_by)
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, batch_id: int) -> None:
        if late == "drop":
            incremental_append(batch, out, control, output_field, partition_by=partition_by)
            return
        if control not in batch.columns:
            raise ValueError(f"incremental refresh: control column {control!r} is gone from the source")
        batch.write.mode("overwrite").partitionBy(*columns).parquet(f"{out}/{BATCH}={batch_id}")

    query = (
        reader.parquet(src_dir)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if late == "keep":
        empty = spark.createDataFrame([], schema)
        if stored_table(empty, out, [BATCH, *columns]) is None:
            return empty
        kinds = T.StructType([*empty.schema.fields, T.StructField(BATCH, T.LongType())])
        return spark.read.schema(kinds).parquet(out).select(*[col(c) for c in empty.columns])
    stored = stored_table(spark.createDataFrame([], schema), out, partition_by)
    return spark.createDataFrame([], schema) if stored is None else stored
