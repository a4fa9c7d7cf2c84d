"""Reading tables and choosing columns, rows, limits and samples while reading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.functions.names import as_list, col
from layerflow.session import cut

# Fixed value: rows an input shows at design time.
DESIGN_ROW_LIMIT = 393216

# Up to so many ordered rows are merged in one task.
SMALL_LIMIT = 10_000
# Keys a threshold is found from, and rows of a range of the rows below it.
THRESHOLD_SAMPLE = 20_000
ROWS_IN_RANGE = 100_000
# Parts in which a group is ranked before it is ranked whole.
SAMPLE_PARTS = 64


def read_dataset(spark: SparkSession, root: str | None, name: str, layer: str | None = None) -> DataFrame:
    """A published table of a layer, or (``layer=None``) a pre-existing table in ``root``.
    With ``root=None`` the name is looked up in the session: live and bucketed tables."""
    if root is None:
        return spark.table(name)
    path = f"{root}/{layer}/{name}" if layer else f"{root}/{name}.parquet"
    return spark.read.parquet(path)


def read_sql(
    spark: SparkSession,
    sql: str,
    args: Mapping[str, Any] | Sequence[Any] | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """A SQL query; ``{name}`` in the text stands for a DataFrame passed by that name and
    ``:name`` for a value in ``args``."""
    return spark.sql(sql, args=args, **tables)


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True,
    mode: str = "PERMISSIVE", **options: str,
) -> DataFrame:
    """CSV with a declared schema, so that no pass over the data is spent on inference."""
    return spark.read.options(**options).csv(path, schema=schema, header=header, mode=mode)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan(
    df: DataFrame, columns: Sequence[str] | None = None, where: Column | str | None = None
) -> DataFrame:
    """Selected columns and a filter at read time; both reach the Parquet reader."""
    rows = df if where is None else df.where(where)
    return rows if columns is None else rows.select(*[col(c) for c in columns])


def limit_rows(df: DataFrame, n: int = DESIGN_ROW_LIMIT, order_by: str | Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows; inputs show DESIGN_ROW_LIMIT at design time. With an order that
    names every row apart the choice is repeatable.

    Up to SMALL_LIMIT ordered rows each task keeps its own best ``n`` and one task merges these.
    Beyond that see ``first_rows``, which leaves no task more than its share.
    """
    order = as_list(order_by)
    if not order or n <= SMALL_LIMIT:
        return (df.orderBy(*[col(c) for c in order]) if order else df).limit(n)
    return first_rows(df, n, order)


def first_rows(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ascending order (nulls first), for any ``n``.

    A bounded sample of the order columns gives a threshold that about ``n`` rows lie below; it
    is raised until enough do, each time by one counting pass over these columns. The rows up
    to it, a little more than ``n``, are dealt into ranges and written; ranges are counted, all
    before the one in which the n-th row lies are taken whole, and that one is numbered. Rows
    that tie over all order columns beyond the n-th place are told apart by their hash.
    """
    order = as_list(order_by)
    key = F.struct(*[col(c) for c in order])
    total = df.count()
    if n >= total:
        return df
    keys = df.select(key.alias("key"), F.xxhash64(*[col(c) for c in order], F.lit("draw")).alias("draw"))
    # every key is drawn by its own hash, so the sample is the same in every run
    drawn = keys.orderBy("draw", "key").limit(THRESHOLD_SAMPLE).withColumn("place", F.row_number().over(Window.orderBy("key")))
    drawn, near = cut(drawn.select("key", "place")), None
    for spare in (1.02, 1.1, 1.5, 3.0):
        place = int(min(total, THRESHOLD_SAMPLE) * n / total * spare) + 64
        if place >= min(total, THRESHOLD_SAMPLE):
            break
        below = df.where(key <= drawn.where(F.col("place") == place).select("key").scalar())
        if below.count() >= n:
            near = below
            break
    rows = df if near is None else near
    tie = F.xxhash64(*[col(c) for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))])
    parts = max(2, min(10_000, n // ROWS_IN_RANGE + 2))
    placed = rows.withColumn("__tie", tie).repartitionByRange(parts, *[col(c) for c in order], "__tie")
    held = cut(placed.withColumn("__range", F.spark_partition_id()))
    sizes = sorted(held.groupBy("__range").count().collect())
    before, last = 0, None
    for number, size in sizes:
        if before + size >= n:
            last = number
            break
        before += size
    own = Window.partitionBy("__range").orderBy(*[col(c) for c in order], "__tie")
    edge = held.where(F.col("__range") == last).withColumn("__place", F.row_number().over(own)).where(F.col("__place") <= n - before)
    whole = held.where(F.col("__range") < last)
    return whole.select(*[col(c) for c in df.columns]).unionByName(edge.select(*[col(c) for c in df.columns]))


def sample_groups(df: DataFrame, k: int, by: str | Sequence[str], key: str | Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly min(k, rows of the group) rows of each group: those whose keys have the lowest
    hashes, so the same rows come back whatever the partitioning. ``key`` tells rows apart; rows
    of one key tie by their hash. Null is a group.

    Each task passes on at most ``k`` rows of a group, and these are ranked within parts of the
    group before the group itself, so a group of any size meets in one task as k rows a part.
    """
    groups = [col(c) for c in as_list(by)]
    plain = [col(c) for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    order = [_uniform([col(c) for c in as_list(key)], seed), F.xxhash64(*plain)]
    drawn = df.withColumns({"__draw": order[0], "__tie": order[1]}).withColumn("__part", F.pmod("__tie", F.lit(SAMPLE_PARTS)))
    for parts in ([*groups, F.col("__part")], groups):
        own = Window.partitionBy(*parts).orderBy("__draw", "__tie")
        drawn = drawn.withColumn("__place", F.row_number().over(own)).where(F.col("__place") <= k).drop("__place")
    return drawn.select(*[col(c) for c in df.columns])


def _uniform(key: Sequence[Column], seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def sample_rows(
    df: DataFrame,
    fraction: float | Mapping[Any, float],
    seed: int = 0,
    by: str | None = None,
    key: str | Sequence[str] | None = None,
) -> DataFrame:
    """Keep each row with probability ``fraction``.

    With ``key`` (columns that tell rows apart) the choice hangs on the key alone: the same
    rows come back whatever the partitioning, and after a task is run again. With ``by``,
    ``fraction`` may map group values to fractions; groups not named are left out.
    """
    if isinstance(fraction, Mapping) and by is None:
        raise ValueError("fractions per group need the group column in 'by'")
    if key is None:
        if by is None:
            return df.sample(fraction=fraction, seed=seed)
        if not isinstance(fraction, Mapping):
            raise ValueError("sampling by group without a key needs a fraction per group")
        return df.sampleBy(by, dict(fraction), seed)
    draw = _uniform([col(k) for k in as_list(key)], seed)
    if not isinstance(fraction, Mapping):
        return df.where(draw < F.lit(float(fraction)))
    keep = F.lit(False)
    for value, share in fraction.items():
        keep = keep | (col(by).eqNullSafe(F.lit(value)) & (draw < F.lit(float(share))))
    return df.where(keep)
