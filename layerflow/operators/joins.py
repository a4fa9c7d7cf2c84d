"""Joins, presence checks and lookups.

No side is broadcast by hint: Spark broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``. Beyond that, rows of a hot key are spread by the
adaptive skew join. That rule needs both inputs of a sort-merge join to be plain shuffles. An
aggregated side is none, because the join takes over its partitioning; so where one side is
an aggregate, the keys are compared as one struct, the aggregated side (small by then) gets a
shuffle of its own, and the rule applies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.functions.groups import hot_groups, hot_keys
from layerflow.functions.names import as_list, as_pairs, col, require_columns, require_distinct

Keys = str | Sequence[str | tuple[str, str]]

# How a pair was matched.
MATCHED_BY_KEY, MATCHED_BY_NAME = "luid", "name"


# Join kinds by any of their names.
_KINDS = {
    "inner": "inner",
    "left": "left", "leftouter": "left", "left_outer": "left",
    "right": "right", "rightouter": "right", "right_outer": "right",
    "full": "full", "outer": "full", "fullouter": "full", "full_outer": "full",
}


def spread_join(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str, right_unique: bool = False
) -> DataFrame:
    """Equi-join of tables without common column names, whatever keys are hot.

    The adaptive skew join splits hot keys of both sides of an inner join, but not of the side
    an outer join fills with nulls. That side is measured; when it has hot keys, their rows
    are joined by an inner join, with the rows that have no partner added, and all other rows
    by the outer join.
    """
    same = reduce(Column.__and__, [col(l) == col(r) for l, r in pairs])
    names_left, names_right = [l for l, _ in pairs], [r for _, r in pairs]

    def without_right(rows: DataFrame) -> DataFrame:
        return rows.join(right.where(F.lit(False)), same, "left")

    def without_left(rows: DataFrame) -> DataFrame:
        return left.where(F.lit(False)).join(rows, same, "right")

    if how == "full":
        # Rows with a null key have no partner, and would all meet in one task.
        set_left, set_right = _present(names_left), _present(names_right)
        met = _spread(left.where(set_left), right.where(set_right), pairs, how, right_unique)
        return met.unionByName(without_right(left.where(~set_left))).unionByName(without_left(right.where(~set_right)))
    return _spread(left, right, pairs, how, right_unique)


def _spread(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str, right_unique: bool
) -> DataFrame:
    same = reduce(Column.__and__, [col(l) == col(r) for l, r in pairs])
    names_left, names_right = [l for l, _ in pairs], [r for _, r in pairs]
    filled = []
    if how in ("left", "full") and not right_unique:
        filled.append((right.where(_present(names_right)), names_right))
    if how in ("right", "full"):
        filled.append((left.where(_present(names_left)), names_left))
    marks = [f"__hot_{i}" for i in range(len(pairs))]
    found = [hot_keys(side, keys).toDF(*marks) for side, keys in filled if hot_groups(side, keys)[0]]
    if not found:
        return left.join(right, same, how)
    hot = reduce(DataFrame.unionByName, found).distinct()
    on_left, on_right = list(zip(names_left, marks, strict=True)), list(zip(names_right, marks, strict=True))
    cold = match_struct(left, hot, on_left, "left_anti").join(match_struct(right, hot, on_right, "left_anti"), same, how)
    hot_left = match_struct(left, hot, on_left, "left_semi")
    hot_right = match_struct(right, hot, on_right, "left_semi")
    parts = [cold, hot_left.join(hot_right, same, "inner")]
    if how in ("left", "full"):
        alone = missing_from(hot_left, hot_right, pairs)
        parts.append(alone.join(right.where(F.lit(False)), same, "left"))
    if how in ("right", "full"):
        alone = missing_from(hot_right, hot_left, [(r, l) for l, r in pairs])
        parts.append(left.where(F.lit(False)).join(alone, same, "right"))
    return reduce(DataFrame.unionByName, parts)


def join(
    left: DataFrame, right: DataFrame, on: Keys, how: str = "left", suffix: str = "-1", right_unique: bool = False
) -> DataFrame:
    """Equi-join with a left and a right role: inner, left, right or full.

    Keys of one name come out once (from whichever side has the row); other columns of the
    right side that clash with the left get ``suffix``. Outer joins first measure the keys of
    the side they fill with nulls; ``right_unique=True`` says that the right side has one row
    per key, as a dimension does, and spares the measuring.
    """
    if how not in _KINDS:
        raise ValueError(f"join: how must be one of {sorted(set(_KINDS.values()))}; for presence see exists_in, missing_from")
    kind, pairs = _KINDS[how], as_pairs(on)
    require_columns(left, [l for l, _ in pairs], "join, left side")
    require_columns(right, [r for _, r in pairs], "join, right side")
    shared = {r for l, r in pairs if l == r}
    renamed = {
        c: f"__right_{c}" if c in shared else c + suffix if c in left.columns else c
        for c in right.columns
    }
    require_distinct([*left.columns, *renamed.values()], "join")
    right = right.select(*[col(c).alias(n) for c, n in renamed.items()])
    joined = spread_join(left, right, [(l, renamed[r]) for l, r in pairs], kind, right_unique)

    def kept(name: str) -> Column:
        if name in shared and kind in ("right", "full"):
            return F.coalesce(col(name), col(f"__right_{name}")).alias(name)
        return col(name)

    others = [col(n) for c, n in renamed.items() if c not in shared]
    return joined.select(*[kept(c) for c in left.columns], *others)


def self_join(df: DataFrame, on: Keys, suffixes: tuple[str, str] = ("_l", "_r"), how: str = "inner") -> DataFrame:
    """The same table as both inputs; every column carries the suffix of its role."""
    left, right = (df.toDF(*[c + s for c in df.columns]) for s in suffixes)
    pairs = [(l + suffixes[0], r + suffixes[1]) for l, r in as_pairs(on)]
    return join(left, right, pairs, how)


def match_struct(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str
) -> DataFrame:
    """Join on keys packed into one struct; nulls equal nulls. Right keys are dropped."""
    keys_left = [col(l).alias(f"k{i}") for i, (l, _) in enumerate(pairs)]
    keys_right = [col(r).alias(f"k{i}") for i, (_, r) in enumerate(pairs)]
    packed_left = left.withColumn("__left_key", F.struct(*keys_left))
    rest = [col(c) for c in right.columns if c not in {r for _, r in pairs}]
    packed_right = right.select(F.struct(*keys_right).alias("__right_key"), *rest)
    joined = packed_left.join(packed_right, F.col("__left_key") == F.col("__right_key"), how)
    return joined.drop("__left_key", "__right_key")


def _present(column_pairs: Sequence[str]) -> Column:
    return reduce(Column.__and__, [col(c).isNotNull() for c in column_pairs])


def _or_fail_on_repeats(lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lookup, in a plan that fails when a key has several rows.

    Only keys are grouped for the check. It gives no rows, so stacking it on the lookup costs
    one narrow shuffle, and the lookup itself is shuffled once, by the join.
    """
    shown = F.to_json(F.struct(*[col(k) for k in keys]))
    failure = F.raise_error(F.concat(F.lit("several rows for one key: "), shown))
    counts = lookup.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__rows"))
    repeated = F.col("__rows") > 1
    # The failure sits behind its condition, so a filter on the key cannot set it off early.
    made = [
        (F.when(repeated, failure) if f.name in keys else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in lookup.schema.fields
    ]
    return lookup.unionByName(counts.where(repeated).select(*made))


def attach(
    df: DataFrame, lookup: DataFrame, on: Keys, how: str = "left", found: str | None = None, unique: bool = False
) -> DataFrame:
    """Add the columns of a lookup that has at most one row per key.

    The query fails when a key has several rows; ``unique=True`` skips that check for a lookup
    that is grouped by the key. Rows of ``df`` stay as they are with ``how="left"``. Null keys
    find nothing. ``found`` names a Boolean column that tells whether there was a match.
    """
    pairs = as_pairs(on)
    keys = [r for _, r in pairs]
    offered = lookup.where(_present(keys))
    added = [c for c in lookup.columns if c not in keys]
    require_distinct([*df.columns, *added, *as_list(found)], "attach")
    if found:
        offered = offered.withColumn(found, F.lit(True))
    if unique:
        joined = match_struct(df, offered, pairs, how)
    else:
        checked = _or_fail_on_repeats(offered, keys)
        renamed = checked.withColumnsRenamed({k: f"__key_{i}" for i, k in enumerate(keys)})
        same = [col(l) == F.col(f"__key_{i}") for i, (l, _) in enumerate(pairs)]
        joined = df.join(renamed, reduce(Column.__and__, same), how).drop(*[f"__key_{i}" for i in range(len(keys))])
    return joined.withColumn(found, F.coalesce(col(found), F.lit(False))) if found else joined


def _keys_of(other: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    keys = [r for _, r in pairs]
    return other.select(*[col(k) for k in keys]).where(_present(keys)).distinct()


def exists_in(df: DataFrame, other: DataFrame, on: Keys) -> DataFrame:
    """Rows with at least one match. The other side is reduced to its distinct keys before
    it is shuffled."""
    pairs = as_pairs(on)
    return match_struct(df, _keys_of(other, pairs), pairs, "left_semi")


def missing_from(df: DataFrame, other: DataFrame, on: Keys) -> DataFrame:
    """Rows without a match; a null key never matches, so such rows stay."""
    pairs = as_pairs(on)
    return match_struct(df, _keys_of(other, pairs), pairs, "left_anti")


# Cardinalities of a join, read left:right.
CARDINALITIES = ("1:1", "1:N", "N:1", "N:N", "unknown")


def _key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = df.where(_present(keys))
    return present.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"))


def join_cardinality(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """One row: the most rows a key has on either side, and the cardinality this makes.
    Null keys never join and are not counted; a side without keys makes it unknown."""
    pairs = as_pairs(on)
    sides = [
        _key_counts(side, [p[i] for p in pairs]).agg(F.max("rows").alias("most")).select(
            F.lit(i).alias("side"), "most"
        )
        for i, side in enumerate((left, right))
    ]
    both = sides[0].unionByName(sides[1]).agg(
        F.max(F.when(F.col("side") == 0, F.col("most"))).alias("max_left"),
        F.max(F.when(F.col("side") == 1, F.col("most"))).alias("max_right"),
    )

    def mark(name: str) -> Column:
        return F.when(F.col(name) == 1, F.lit("1")).otherwise(F.lit("N"))

    known = F.col("max_left").isNotNull() & F.col("max_right").isNotNull()
    spelled = F.concat(mark("max_left"), F.lit(":"), mark("max_right"))
    return both.withColumn("cardinality", F.when(known, spelled).otherwise(F.lit("unknown")))


def checked_join(
    left: DataFrame, right: DataFrame, on: Keys, how: str, expect: str, suffix: str = "-1"
) -> tuple[DataFrame, DataFrame]:
    """The join, and the keys that break the declared cardinality.

    A side declared ``1`` must have one row for every key that occurs on the other side.
    Violations come as (side, keys…, rows), keys under their names on the left.
    """
    if expect not in CARDINALITIES:
        raise ValueError(f"expect must be one of {CARDINALITIES}")
    pairs = as_pairs(on)
    names = [l for l, _ in pairs]
    declared = expect.split(":") if ":" in expect else ["N", "N"]

    def several(side: DataFrame, other: DataFrame, mine: int, label: str) -> DataFrame:
        keys, theirs = [p[mine] for p in pairs], [p[1 - mine] for p in pairs]
        counts = _key_counts(side, keys).where(F.col("rows") > 1)
        hit = exists_in(counts, other, list(zip(keys, theirs, strict=True)))
        return hit.select(
            F.lit(label).alias("side"),
            *[col(k).alias(n) for k, n in zip(keys, names, strict=True)],
            "rows",
        )

    found = []
    if declared[0] == "1":
        found.append(several(left, right, 0, "left"))
    if declared[1] == "1":
        found.append(several(right, left, 1, "right"))
    if not found:
        found = [several(left, right, 0, "left").where(F.lit(False))]
    return join(left, right, on, how, suffix), reduce(DataFrame.unionByName, found)


def match_with_fallback(
    left: DataFrame, right: DataFrame, key: str, name: str, prefix: str = "match_"
) -> DataFrame:
    """Match each left row on ``key``, or on ``name`` where its key is null; a key that is
    set but matches nothing does not fall back.

    All left rows come out, with ``matched_by`` (null for the unmatched) and the columns of
    the right side under ``prefix``. The right side is offered once per key and once per
    name, so one join serves both ways.
    """
    by_key, by_name = F.lit(MATCHED_BY_KEY), F.lit(MATCHED_BY_NAME)
    asked = left.withColumn("__how", F.when(col(key).isNotNull(), by_key).otherwise(by_name)).withColumn(
        "__value", F.coalesce(col(key).cast("string"), col(name).cast("string"))
    )
    ways = F.array(
        F.struct(by_key.alias("__by"), col(key).cast("string").alias("__offer")),
        F.struct(by_name.alias("__by"), col(name).cast("string").alias("__offer")),
    )
    require_distinct([*left.columns, *[prefix + c for c in right.columns]], "match_with_fallback")
    columns = [col(c).alias(prefix + c) for c in right.columns]
    offered = right.select(F.explode(ways).alias("__way"), *columns).select("__way.*", *[col(prefix + c) for c in right.columns])
    met = spread_join(asked, offered.where(F.col("__offer").isNotNull()), [("__how", "__by"), ("__value", "__offer")], "left")
    return met.withColumn("matched_by", F.col("__by")).drop("__how", "__value", "__by", "__offer")


def resolve_names(names: DataFrame, catalog: DataFrame, name: str = "name", strict: bool = False):
    """Look names up exactly: one row per match, and one row with nulls for a name without
    match, plus ``n_matches``.

    ``strict=True`` gives (rows, ambiguous names) for callers that need one match at most.
    """
    counts = catalog.where(col(name).isNotNull()).groupBy(col(name)).agg(F.count(F.lit(1)).alias("n_matches"))
    asked = attach(names, counts, name, unique=True).withColumn("n_matches", F.coalesce(F.col("n_matches"), F.lit(0)))
    resolved = join(asked, catalog, name, "left")
    if not strict:
        return resolved
    return resolved, asked.where(F.col("n_matches") > 1)


def fill_from_lookup(df: DataFrame, lookup: DataFrame, on: Keys, column: str) -> DataFrame:
    """Fill nulls of ``column`` from the lookup's column of that name; never overwrite."""
    pairs = as_pairs(on)
    offered = lookup.select(*[col(r) for _, r in pairs], col(column).alias("__offered"))
    filled = attach(df, offered, pairs)
    return filled.withColumn(column, F.coalesce(col(column), F.col("__offered"))).drop("__offered")


def lookup_chain(
    df: DataFrame,
    wrapper: DataFrame,
    base: DataFrame,
    key: str,
    wrapper_key: str,
    wrapper_base: str,
    base_key: str,
) -> DataFrame:
    """Chase a key to its base row: through its wrapper when there is one, else directly.

    Adds the columns of ``base`` and ``via``: ``wrapped``, ``direct``, or null when no base
    row was found (a wrapper pointing nowhere does not fall back).
    """
    hops = wrapper.select(col(wrapper_key).alias("__wrapped"), col(wrapper_base).alias("__base"))
    hopped = attach(df, hops, [(key, "__wrapped")], found="__has_wrapper")
    aimed = hopped.withColumn(
        "__base", F.when(F.col("__has_wrapper"), F.col("__base")).otherwise(col(key))
    )
    offered = base.withColumn("__base_key", col(base_key))
    reached = attach(aimed, offered, [("__base", "__base_key")], found="__has_base")
    way = F.when(F.col("__has_wrapper"), F.lit("wrapped")).otherwise(F.lit("direct"))
    return reached.withColumn("via", F.when(F.col("__has_base"), way)).drop(
        "__base", "__has_wrapper", "__has_base"
    )
