"""Session settings, the shared scratch folder and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A group with more rows than this is not handed to a single task.
GROUP_ROWS_CONF = "spark.layerflow.maxGroupRows"
DEFAULT_GROUP_ROWS = 5_000_000


def build_session(app: str = "layerflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution does the run-time sizing: it coalesces small shuffle partitions,
    turns joins with a small measured side into broadcast joins, and splits hot partitions
    of sort-merge joins. Further settings are keywords with ``__`` for each dot:
    ``spark__sql__shuffle__partitions="4000"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names
    one. Only a local master, where driver and executors share one disk, may fall back to a
    temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="layerflow-")
    spark.sparkContext.setCheckpointDir(made)
    return made


# By this setting Spark removes an execution's shuffle files at its end.
FREE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each result computed within the block as soon as it is there.

    Otherwise they stay until the driver happens to collect its garbage, and the disk must hold
    those of all steps at once. What is computed after the block is not affected.
    """
    before = spark.conf.get(FREE_CONF, None)
    spark.conf.set(FREE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_CONF) if before is None else spark.conf.set(FREE_CONF, before)


# The paths made in each open scope, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what operators wrote to the shared folder within the block.

    Tables that were cut are read when a result is computed, so write or collect the result
    inside the block. Nothing but paths made in it is removed.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from there.

    The lineage ends, so a lost executor costs a read instead of a recomputation, and every
    later step sees the same rows. Unlike an opaque checkpoint the table has a known size, by
    which Spark decides about broadcasts, and its columns can be pruned.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
