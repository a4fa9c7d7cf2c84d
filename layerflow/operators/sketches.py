"""Column profiles by sketches that can be kept and merged.

A profile is one row with a struct for each column: row and null counts, exact smallest and
largest value, and two sketches of fixed size, for distinct values (HyperLogLog) and quantiles
(KLL). It is made in one pass; profiles of parts, days or appended rows are
merged without reading the rows again, and two stored profiles are compared without any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.functions.names import col

#: log2 of the HyperLogLog buckets, and the standard error of its estimates: 1.04 / sqrt(2^14).
DISTINCT_BITS = 14
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_BITS / 2)
#: KLL parameter, and the largest error of a rank at 99 % confidence, as a share of the rows.
QUANTILE_K, RANK_ERROR = 400, 0.0085
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Groups in which tasks' sketches are merged before one task merges these.
MERGE_GROUPS = 64


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return "value" if isinstance(kind, T.AtomicType) else "other"


def _parts(field: T.StructField) -> dict[str, Column]:
    """The measures of one column over rows."""
    value, kind = col(field.name), _kind(field.dataType)
    parts = {"nulls": F.count_if(value.isNull())}
    if kind != "other":
        parts |= {"min": F.min(value), "max": F.max(value), "hll": F.hll_sketch_agg(value.cast("string"), DISTINCT_BITS)}
    if kind == "number":
        parts["kll"] = F.kll_sketch_agg_double(value.cast("double"), QUANTILE_K)
    return parts


#: How a measure of several profiles becomes that of all.
_MERGE = {
    "nulls": F.sum,
    "min": F.min,
    "max": F.max,
    "hll": lambda c: F.hll_union_agg(c),
    "kll": lambda c: F.kll_merge_agg_double(c),
}


def column_profile(df: DataFrame) -> DataFrame:
    """The profile of a table: one row, ``__rows`` and a struct for each column. Columns of
    complex types have their nulls counted only. One pass; sketches of tasks are merged in
    MERGE_GROUPS groups first, so that no task receives one for every other task."""
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("__group")
    flat = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[c.alias(f"{i}_{n}") for i, f in enumerate(df.schema.fields) for n, c in _parts(f).items()],
    )
    kinds = {f"{i}_{n}": n for i, f in enumerate(df.schema.fields) for n in _parts(f)}
    whole = flat.agg(F.coalesce(F.sum("__rows"), F.lit(0).cast("long")).alias("__rows"), *[_MERGE[n](F.col(c)).alias(c) for c, n in kinds.items()])
    return whole.select(
        "__rows", *[F.struct(*[F.col(f"{i}_{n}").alias(n) for n in _parts(f)]).alias(f.name) for i, f in enumerate(df.schema.fields)]
    )


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all rows of several tables from their profiles; columns must agree. A
    DataFrame may hold several profiles, one in each row."""
    both = profiles[0]
    for other in profiles[1:]:
        both = both.unionByName(other)
    fields = [f for f in both.schema.fields if f.name != "__rows"]
    measures = [
        F.struct(*[_MERGE[p.name](col(f.name).getField(p.name)).alias(p.name) for p in f.dataType.fields]).alias(f.name) for f in fields
    ]
    return both.agg(F.coalesce(F.sum("__rows"), F.lit(0).cast("long")).alias("__rows"), *measures)


def read_profile(profile: DataFrame) -> DataFrame:
    """One row per column: (column, type, rows, nulls, distinct, min, max, quantiles).

    ``distinct`` is an estimate with standard error DISTINCT_ERROR, ``quantiles`` the values at
    QUANTILES with ranks within RANK_ERROR; both are null where a column's type has none, and
    so are quantiles without values. Other numbers are exact.
    """
    rows = []
    for field in profile.schema.fields:
        if field.name == "__rows":
            continue
        has = {f.name: f.dataType for f in field.dataType.fields}
        held = col(field.name)
        text, none = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
        quantiles = none
        if "kll" in has:
            sketch = held.getField("kll")
            ranks = F.array(*[F.lit(q) for q in QUANTILES])
            empty = sketch.isNull() | (F.kll_sketch_get_n_double(sketch) == 0)
            quantiles = F.when(~empty, F.kll_sketch_get_quantile_double(sketch, ranks))
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(has["min"].simpleString() if "min" in has else "complex").alias("type"),
                F.col("__rows").alias("rows"),
                F.coalesce(held.getField("nulls"), F.lit(0).cast("long")).alias("nulls"),
                (F.coalesce(F.hll_sketch_estimate(held.getField("hll")), F.lit(0).cast("long")) if "hll" in has else F.lit(None).cast("long")).alias("distinct"),
                (held.getField("min").cast("string") if "min" in has else text).alias("min"),
                (held.getField("max").cast("string") if "max" in has else text).alias("max"),
                quantiles.alias("quantiles"),
            )
        )
    return profile.select(F.inline(F.array(*rows)))


def profile_diff(a: DataFrame, b: DataFrame, errors: float = 4.0) -> DataFrame:
    """Two profiles compared, one row per column of either: where it exists, its figures on
    each side, and ``same``. Types, nulls, smallest and largest values must be equal; numbers
    of distinct values may differ by ``errors`` standard errors, as far as estimates can tell.
    Reads the profiles only. ``column_diff`` is the exact comparison, over the tables."""
    parts = ("type", "rows", "nulls", "distinct", "min", "max")
    sides = [read_profile(p).select("column", F.lit(True).alias(f"in_{s}"), *[col(n).alias(f"{n}_{s}") for n in parts]) for p, s in ((a, "a"), (b, "b"))]
    both = sides[0].join(sides[1], "column", "full_outer")
    apart = F.abs(F.col("distinct_a") - F.col("distinct_b"))
    near = F.coalesce(apart <= F.lit(errors * DISTINCT_ERROR) * F.greatest("distinct_a", "distinct_b"), F.col("distinct_a").eqNullSafe(F.col("distinct_b")))
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & near
    for name in ("type", "nulls", "min", "max"):
        same = same & F.col(f"{name}_a").eqNullSafe(F.col(f"{name}_b"))
    here = {f"in_{s}": F.coalesce(F.col(f"in_{s}"), F.lit(False)) for s in "ab"}
    return both.withColumn("same", same).withColumns(here)


def frequent_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, n): the ``k`` most frequent values of a column, exact, most frequent first, ties
    to the smaller value; null is no value. Values are counted with a map-side combine, and
    each task passes on its own best k only."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)
