"""Row-level cleaning and the clean step, an ordered list of actions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from layerflow.functions.names import as_list, col, require_columns
from layerflow.functions.text import split_literal, title_case
from layerflow.operators.joins import attach

def _typed(value: Any, kind: str) -> Any:
    """A Python value as one that a column of this type holds."""
    if value is None:
        return None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(value)
    if kind in ("float", "double"):
        return float(value)
    return str(value) if kind == "string" else Decimal(str(value)) if kind.startswith("decimal") else value


WHITE_SPACE = " \t\n\x0b\f\r"


def value_filter(
    df: DataFrame,
    column: str,
    keep: Iterable[Any] | None = None,
    exclude: Iterable[Any] | None = None,
    not_null: bool = False,
) -> DataFrame:
    """Filter on the values of one column. ``None`` inside a list stands for null; excluding
    values does not remove nulls unless null is named."""
    value = col(column)
    tests: list[Column] = []
    if keep is not None:
        wanted = list(keep)
        test = value.isin([v for v in wanted if v is not None])
        tests.append(test | value.isNull() if None in wanted else test)
    if exclude is not None:
        unwanted = list(exclude)
        named = value.isin([v for v in unwanted if v is not None])
        tests.append(value.isNotNull() & ~named if None in unwanted else value.isNull() | ~named)
    if not_null:
        tests.append(value.isNotNull())
    return reduce(lambda rows, test: rows.where(test), tests, df)


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.where(condition)


def add_column(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    value = F.expr(expression) if isinstance(expression, str) else expression
    return df.withColumn(name, value)


def add_row_unit(df: DataFrame) -> DataFrame:
    """The implicit constant column that counts rows when summed."""
    return df.withColumn("Number of Rows", F.lit(1))


def group_values(df: DataFrame, column: str, mapping: Mapping[Any, Any] | DataFrame) -> DataFrame:
    """Bring many spellings to one. ``mapping`` is a dict, or a DataFrame (spelling, value)
    with one row per spelling. Spellings and values take the column's type; a null spelling
    and a spelling mapped to null change nothing. Unmapped values stay. Both forms are looked up
    by one join. A dict is unique by nature and becomes a local relation, whose size Spark knows
    when it plans: the rows of ``df`` are not shuffled. A table is checked and measured first."""
    require_columns(df, [column], "group_values")
    kind = df.schema[column].dataType.simpleString()
    if isinstance(mapping, Mapping):
        typed = [{"__spelling": _typed(k, kind), "__value": _typed(v, kind)} for k, v in mapping.items() if k is not None]
        names = T.StructType([T.StructField(n, df.schema[column].dataType) for n in ("__spelling", "__value")])
        known = df.sparkSession.createDataFrame(pa.Table.from_pylist(typed, schema=to_arrow_schema(names)))
        joined = df.join(known, col(column) == F.col("__spelling"), "left")
        return joined.withColumn(column, F.coalesce("__value", col(column))).drop("__spelling", "__value")
    spelling, value = mapping.columns
    looked_up = mapping.select(
        col(spelling).cast(kind).alias("__spelling"), col(value).cast(kind).alias("__value")
    ).where(F.col("__spelling").isNotNull())
    joined = attach(df, looked_up, [(column, "__spelling")])
    return joined.withColumn(column, F.coalesce(col("__value"), col(column))).drop("__value")


def split_column(df: DataFrame, column: str, sep: str, n: int, prefix: str | None = None) -> DataFrame:
    """The first ``n`` parts as ``<prefix>_1`` … ``<prefix>_n``; null where there is no part."""
    parts = split_literal(col(column), sep)
    stem = prefix or column
    return df.withColumns({f"{stem}_{i + 1}": F.get(parts, F.lit(i)) for i in range(n)})


def trim_whitespace(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Cut white space (blanks, tabs, line ends) off both ends."""
    return df.withColumns({c: F.btrim(col(c), F.lit(WHITE_SPACE)) for c in as_list(columns)})


def fix_case(df: DataFrame, columns: str | Iterable[str], mode: str) -> DataFrame:
    change = {"upper": F.upper, "lower": F.lower, "title": title_case}[mode]
    return df.withColumns({c: change(col(c)) for c in as_list(columns)})


def replace_value(df: DataFrame, column: str, old: Any, new: Any, exact: bool = True) -> DataFrame:
    """Replace a whole value (null included, as ``None``) or, with ``exact=False``, every
    occurrence of a piece of text."""
    value = col(column)
    if exact:
        changed = F.when(value.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(value)
    else:
        changed = F.replace(value, F.lit(old), F.lit(new))
    return df.withColumn(column, changed)


Action = Callable[[DataFrame], DataFrame]


def action(operator: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> Action:
    """An operator with its arguments, waiting for its table."""
    return lambda df: operator(df, *args, **kwargs)


def clean(df: DataFrame, actions: Sequence[Action], indices: Iterable[int] | None = None) -> DataFrame:
    """Run a list of actions in order. ``indices`` picks a slice of the list: the slice runs
    in list order whatever the order of the indices, and running complementary slices one
    after the other equals running the whole list when the first holds the earlier actions.
    """
    chosen = range(len(actions)) if indices is None else sorted(set(indices))
    outside = [i for i in chosen if not 0 <= i < len(actions)]
    if outside:
        raise IndexError(f"clean: action indices {outside} are outside 0..{len(actions) - 1}")
    return reduce(lambda rows, i: rows.transform(actions[i]), chosen, df)
