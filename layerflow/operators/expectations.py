"""Data-quality expectations. Each gives the rows, keys or values that break it; an empty
result is a pass. ``run_expectations`` reports every violation of every rule in one table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.functions.names import as_list, as_pairs, col
from layerflow.functions.text import BUILTIN_COLUMNS, field_tokens
from layerflow.operators.joins import Keys, attach, exists_in, missing_from

# How layered tables are named. Scratch and retired tables have their own
# prefixes.
NAME_RULES = {
    "prefix": r"^(stg|int|fct|dim|rpt|agg|_scratch|_deprecated)_",
    "snake_case": r"^_?[a-z][a-z0-9_]*$",
    "staging_source": r"^(?!stg_)|^stg_[a-z0-9]+(_[a-z0-9]+)*__[a-z0-9]+(_[a-z0-9]+)*$",
    "no_version": r"^(?!.*_v[0-9]+$)",
}
STEP_NAME = r"^(.*)_step([0-9]+)(_|$)"


class RowRule(NamedTuple):
    """A rule each row passes or fails by itself."""

    name: str
    violated: Column
    message: str


class TableRule(NamedTuple):
    """A rule about the whole table: ``find`` gives (key, message) rows."""

    name: str
    find: Callable[[DataFrame], DataFrame]


def _any(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests)


def _empty(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return col(name).isNull() | (col(name) == "")
    return col(name).isNull()


def expect_required(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Rows where a required column is null or empty text."""
    return df.where(_any(_empty(df, c) for c in as_list(columns)))


def _not_in(column: str, values: Iterable[Any]) -> Column:
    """A value that is not among the accepted ones. A null in the list stands for nothing: with
    it, ``NOT IN`` would be unknown for every other value."""
    return ~col(column).isin([v for v in values if v is not None])


def expect_in(df: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    """Rows whose value is not accepted. Null passes; require it separately."""
    return df.where(_not_in(column, values))


def expect_unique(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys held by several rows, with their row count. Nulls count as values."""
    counts = df.groupBy(*[col(k) for k in as_list(keys)]).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > 1)


def expect_when(df: DataFrame, condition: str | Column, requirement: str | Column) -> DataFrame:
    """Rows that meet the condition but not the requirement (unknown is not met)."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    need = F.expr(requirement) if isinstance(requirement, str) else requirement
    return df.where(cond & ~F.coalesce(need, F.lit(False)))


def expect_ref(df: DataFrame, column: Keys, other: DataFrame, key: Keys) -> DataFrame:
    """Rows whose reference is not found in ``other``; a null reference passes."""
    mine, theirs = as_list(column), as_list(key)
    set_rows = df.where(reduce(Column.__and__, [col(c).isNotNull() for c in mine]))
    return missing_from(set_rows, other, list(zip(mine, theirs, strict=True)))


def expect_range(df: DataFrame, column: str, lo: Any = None, hi: Any = None) -> DataFrame:
    """Rows outside ``lo <= value < hi``; null passes."""
    tests = []
    if lo is not None:
        tests.append(col(column) < F.lit(lo))
    if hi is not None:
        tests.append(col(column) >= F.lit(hi))
    return df.where(_any(tests)) if tests else df.where(F.lit(False))


def expect_disjoint(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """Keys that occur on both sides."""
    mine = [l for l, _ in as_pairs(keys)]
    return exists_in(a.select(*[col(k) for k in mine]).distinct(), b, keys)


def expect_count(df: DataFrame, n: int) -> DataFrame:
    """One row (expected, found) when the number of rows is not ``n``."""
    found = df.agg(F.count(F.lit(1)).alias("found"))
    return found.select(F.lit(n).cast("bigint").alias("expected"), "found").where(F.col("found") != n)


def expect_pattern(df: DataFrame, column: str, rules: Mapping[str, str] = NAME_RULES) -> DataFrame:
    """One row per value and broken rule: all columns of ``df`` plus ``rule``."""
    broken = [F.when(~col(column).rlike(p), F.lit(n)) for n, p in rules.items()]
    return df.withColumn("rule", F.explode(F.array_compact(F.array(*broken))))


def expect_padded_steps(df: DataFrame, column: str) -> DataFrame:
    """Step names of one digit in chains that have ten steps or more."""
    step = F.regexp_extract(col(column), STEP_NAME, 2)
    steps = df.withColumns({"__chain": F.regexp_extract(col(column), STEP_NAME, 1), "__step": step})
    steps = steps.where(F.col("__step") != "")
    long = steps.groupBy("__chain").agg(F.max(F.length(F.ltrim(F.col("__step"), F.lit("0")))).alias("digits")).where("digits > 1")
    short = steps.where(F.length("__step") == 1)
    return exists_in(short, long, "__chain").drop("__chain", "__step")


# --- the same rules, for run_expectations ---------------------------------------------

def required(name: str, df: DataFrame, columns: str | Sequence[str]) -> RowRule:
    named = as_list(columns)
    return RowRule(name, _any(_empty(df, c) for c in named), f"needs a value: {', '.join(named)}")


def accepted(name: str, column: str, values: Sequence[Any]) -> RowRule:
    return RowRule(name, _not_in(column, values), f"{column} is not an accepted value")


def within(name: str, column: str, lo: Any, hi: Any) -> RowRule:
    outside = (col(column) < F.lit(lo)) | (col(column) >= F.lit(hi))
    return RowRule(name, outside, f"{column} is out of range")


def implied(name: str, condition: str, requirement: str) -> RowRule:
    broken = F.expr(condition) & ~F.coalesce(F.expr(requirement), F.lit(False))
    return RowRule(name, broken, f"when {condition}, must hold: {requirement}")


def unique(name: str, keys: str | Sequence[str]) -> TableRule:
    named = as_list(keys)

    def find(df: DataFrame) -> DataFrame:
        text = F.concat_ws(", ", *[col(k).cast("string") for k in named])
        return expect_unique(df, named).select(
            text.alias("key"), F.concat(F.lit("rows: "), F.col("rows").cast("string")).alias("message")
        )

    return TableRule(name, find)


def refers(name: str, key: str, column: str, other: DataFrame, other_key: str) -> TableRule:
    def find(df: DataFrame) -> DataFrame:
        return expect_ref(df, column, other, other_key).select(
            col(key).cast("string").alias("key"),
            F.concat(F.lit(f"{column} not found: "), col(column).cast("string")).alias("message"),
        )

    return TableRule(name, find)


def counted(name: str, n: int) -> TableRule:
    def find(df: DataFrame) -> DataFrame:
        return expect_count(df, n).select(
            F.lit(None).cast("string").alias("key"),
            F.concat(F.lit("rows: "), F.col("found").cast("string")).alias("message"),
        )

    return TableRule(name, find)


def disjoint(name: str, other: DataFrame, keys: Keys) -> TableRule:
    mine = [l for l, _ in as_pairs(keys)]

    def find(df: DataFrame) -> DataFrame:
        text = F.concat_ws(", ", *[col(k).cast("string") for k in mine])
        return expect_disjoint(df, other, keys).select(
            text.alias("key"), F.lit("occurs on both sides").alias("message")
        )

    return TableRule(name, find)


def patterned(name: str, key: str, column: str, rules: Mapping[str, str] = NAME_RULES) -> TableRule:
    def find(df: DataFrame) -> DataFrame:
        return expect_pattern(df, column, rules).select(
            col(key).cast("string").alias("key"),
            F.concat(F.lit(f"{column} breaks "), F.col("rule"), F.lit(": "), col(column)).alias("message"),
        )

    return TableRule(name, find)


def padded(name: str, key: str, column: str) -> TableRule:
    def find(df: DataFrame) -> DataFrame:
        return expect_padded_steps(df, column).select(
            col(key).cast("string").alias("key"),
            F.concat(F.lit("step needs a leading zero: "), col(column)).alias("message"),
        )

    return TableRule(name, find)


def run_expectations(df: DataFrame, key: str, rules: Sequence[RowRule | TableRule]) -> DataFrame:
    """Every violation of every rule as (rule, key, message). All row rules share one pass
    over the table; each table rule adds its own aggregate or join."""
    row_rules = [r for r in rules if isinstance(r, RowRule)]
    parts = []
    if row_rules:
        broken = [
            F.when(r.violated, F.struct(F.lit(r.name).alias("rule"), F.lit(r.message).alias("message")))
            for r in row_rules
        ]
        hits = df.select(
            col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*broken))).alias("hit")
        )
        parts.append(hits.select("hit.rule", "key", "hit.message"))
    for r in rules:
        if isinstance(r, TableRule):
            parts.append(r.find(df).select(F.lit(r.name).alias("rule"), "key", "message"))
    if not parts:
        raise ValueError("run_expectations: no rules")
    return reduce(DataFrame.unionByName, parts)


def coverage(items: DataFrame, assigned: DataFrame, item: str, group: str) -> DataFrame:
    """Items in no group (``unassigned``) and items in several (``multiple``), one row per
    item and group for the latter; columns item, status, group, n_groups."""
    pairs = assigned.select(col(item), col(group)).distinct()
    known = items.select(col(item)).distinct()
    counts = pairs.groupBy(col(item)).agg(F.count(F.lit(1)).alias("n_groups")).where(F.col("n_groups") > 1)
    several = attach(pairs, counts, item, how="inner", unique=True).select(
        col(item), F.lit("multiple").alias("status"), col(group), "n_groups"
    )
    none = missing_from(known, pairs, item).select(
        col(item),
        F.lit("unassigned").alias("status"),
        F.lit(None).cast(assigned.schema[group].dataType).alias(group),
        F.lit(0).cast("bigint").alias("n_groups"),
    )
    return several.unionByName(none)


def extract_tokens(df: DataFrame, column: str, name: str = "token") -> DataFrame:
    """One row per field reference in an expression, repeats included; the text column is
    not carried along."""
    others = [col(c) for c in df.columns if c != column]
    return df.select(*others, F.explode(field_tokens(col(column))).alias(name))


def unknown_tokens(tokens: DataFrame, allowed: DataFrame, group: str, token: str = "token") -> DataFrame:
    """The tokens of each group that nothing exposes or creates, one row (group, token) each.
    Built-in columns are always known. ``allowed`` (group, token) holds what each group may
    refer to."""
    asked = tokens.select(col(group), col(token)).where(~col(token).isin(list(BUILTIN_COLUMNS))).distinct()
    return missing_from(asked, allowed, [group, token])


def shown_tokens(unknown: DataFrame, group: str, token: str = "token", show: int = 8) -> DataFrame:
    """Unknown tokens as a message per group: their number, and the first ``show`` of them in
    order with a ``(+N)`` tail. Ranking stops at ``show`` rows per group before the shuffle, so
    no group is gathered."""
    counts = unknown.groupBy(col(group)).agg(F.count(F.lit(1)).alias("n_unknown"))
    first = Window.partitionBy(col(group)).orderBy(col(token))
    top = (
        unknown.withColumn("__rank", F.row_number().over(first))
        .where(F.col("__rank") <= show)
        .groupBy(col(group))
        .agg(F.array_sort(F.collect_list(col(token))).alias("__shown"))
    )
    tail = F.when(
        F.col("n_unknown") > show, F.concat(F.lit(" (+"), (F.col("n_unknown") - show).cast("string"), F.lit(")"))
    ).otherwise(F.lit(""))
    bracketed = F.transform("__shown", lambda t: F.concat(F.lit("["), t, F.lit("]")))
    return counts.join(top, group).select(
        col(group), "n_unknown", F.concat(F.array_join(bracketed, ", "), tail).alias("shown")
    )
