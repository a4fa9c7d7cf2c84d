"""Shards by jump consistent hashing (Lamping and Veach 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerflow.llm.common import expand, packed, query, table, text_or_empty

SHARDS = 8

#: Fixed values of the published generator: multiplier and increment of the 64-bit sequence.
MULTIPLIER, INCREMENT = 2862933555777941757, 1


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. Every key draws a rising sequence of shard numbers that
    does not depend on the number of shards, and stays at the last one that exists; so a new
    shard only ever takes keys away from old ones."""
    state, at = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    shard, going = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
    while len(going):
        shard[going] = at[going]
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        at[going] = ((shard[going] + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[at[going] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard (int, from 0) of a key column of 64-bit integers. A null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in keys:
            yield pd.Series(jump(batch.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def _key(docs: DataFrame, key: str) -> Column:
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.col(key) if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """All rows with their shard in the column ``into``, which replaces one of that name.

    Only the key decides: rows of one key stay together, whatever else they hold. Integer
    keys are used as they are, others by their 64-bit hash; null keys count as the key 0.
    Nothing is shuffled. An empty table gives an empty table.
    """
    rows = packed(docs.drop(into), shard=shard_of(_key(docs, key), shards))
    return rows.select("row.*", F.col("shard").alias(into))


def number_in_shards(rows: DataFrame, shard: str, by: list[str], into: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in an order that is the same in
    every run: by the MD5 of the columns ``by``, which must decide all columns of ``rows``.

    Equal rows are counted before the shuffle and expanded afterwards. No window receives a
    shard: rows are numbered within 4096 hash buckets of each shard and moved up by the sizes
    of the buckets before.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__copies"))
    counted = counted.withColumn("__order", F.md5(text)).withColumn("__bucket", F.substring("__order", 1, 3))
    inside = Window.partitionBy(shard, "__bucket").orderBy("__order", *by)
    numbered = counted.withColumn(
        "__before", F.coalesce(F.sum("__copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    sizes = counted.groupBy(shard, "__bucket").agg(F.sum("__copies").alias("__n"))
    below = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "__bucket", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__offset"))
    moved = expand(numbered.join(offsets, [shard, "__bucket"]), "__copies", "__copy")
    slot = (F.col("__offset") + F.col("__before") + F.col("__copy")).cast("long")
    return moved.select(*rows.columns, slot.alias(into))


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the law ``key``, with what a ninth would take."""
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), SHARDS).alias("shard"),
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
    numbered = number_in_shards(rows, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
