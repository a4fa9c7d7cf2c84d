"""Parity by a tree of digests: equal tables cost one narrow pass, a changed row one bucket.

Rows fall into buckets by hash of the key; a bucket's digest is its number of rows and two sums
of row hashes, which do not depend on their order. Buckets are the leaves of a tree whose inner
digests are sums of their children's. Two trees are compared from the root down, and only rows
of leaves that differ are compared themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.functions.names import as_list, col, require_columns
from layerflow.operators.parity import value_diff
from layerflow.operators.versions import current_version, publish_version, read_version

LEAF = "__leaf"
#: Leaves of a tree, and children of an inner node.
LEAVES, FANOUT = 4096, 16


def leaf_of(key: str | Sequence[str], leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(*[col(k) for k in as_list(key)]), F.lit(leaves)).cast("int")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "digest", "check")]


def digest_tree(df: DataFrame, key: str | Sequence[str], leaves: int = LEAVES, fanout: int = FANOUT) -> DataFrame:
    """(level, bucket, n, digest, check): level 0 is the root. Rows are hashed where they lie
    and summed with a map-side combine, so the shuffle carries ``leaves`` rows a task at most.
    All columns count, whatever their order; both sides of a comparison need equal types."""
    require_columns(df, as_list(key), "digest_tree")
    columns = [col(c) for c in sorted(df.columns)]
    hashes = [F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)") for seed in ("digest", "check")]
    at = df.select(leaf_of(key, leaves).alias("bucket"), F.lit(1).cast("long").alias("n"), hashes[0].alias("digest"), hashes[1].alias("check"))
    wide = "decimal(38,0)"
    level = at.groupBy("bucket").agg(*_sums()).select("bucket", "n", F.col("digest").cast(wide).alias("digest"), F.col("check").cast(wide).alias("check"))
    depth = 0
    while fanout**depth < leaves:
        depth += 1
    tree = None
    for number in range(depth, -1, -1):
        named = level.withColumn("level", F.lit(number))
        tree = named if tree is None else tree.unionByName(named)
        level = level.withColumn("bucket", F.floor(F.col("bucket") / fanout).cast("int")).groupBy("bucket").agg(*_sums())
        level = level.select("bucket", "n", *[F.col(c).cast(wide).alias(c) for c in ("digest", "check")])
    return tree.select("level", "bucket", "n", "digest", "check")


def differing_leaves(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> list[int]:
    """The leaves in which two stored trees differ, found from the root down: of each level only
    the children of differing nodes are read. At most as many numbers as there are leaves."""
    depth = a.unionByName(b).agg(F.max("level")).first()[0]
    open_, level = None, 0
    while depth is not None and level <= depth:
        sides = [t.where(F.col("level") == level).select("bucket", F.struct("n", "digest", "check").alias(s)) for t, s in ((a, "a"), (b, "b"))]
        if open_ is not None:
            sides = [s.where(F.floor(F.col("bucket") / fanout).isin(open_)) for s in sides]
        met = sides[0].join(sides[1], "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        open_ = [r.bucket for r in met.select("bucket").collect()]
        if not open_:
            return []
        level += 1
    return sorted(open_ or [])


def publish_digested(
    df: DataFrame, path: str, key: str | Sequence[str], leaves: int = LEAVES, fanout: int = FANOUT
) -> DataFrame:
    """Store a table by leaf, with its digest tree beside it. Rows and tree carry one token, so
    a reader never meets a tree of another version."""
    token = uuid.uuid4().hex
    stored = publish_version(df.withColumn(LEAF, leaf_of(key, leaves)), f"{path}/rows", partition_by=LEAF, token=token)
    tree = digest_tree(stored.drop(LEAF), key, leaves, fanout)
    publish_version(tree, f"{path}/digests", partition_by="level", token=token)
    return stored.drop(LEAF)


def _digested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows, tree = current_version(spark, f"{path}/rows"), current_version(spark, f"{path}/digests")
    if rows is None or tree is None or rows.token != tree.token:
        raise ValueError(f"no table with its digests at {path}; publish it again")
    return read_version(spark, f"{path}/rows", rows.number), read_version(spark, f"{path}/digests", tree.number)


def digest_diff(
    spark: SparkSession, a: str, b: str, key: str | Sequence[str], tol: float = 0.0, keyed: bool = True, fanout: int = FANOUT
) -> DataFrame:
    """The rows of ``value_diff`` between two digested tables, from the leaves that differ: the
    partition filter leaves all other files unread. Equal tables read their trees only. With
    ``keyed=False`` whole rows are compared with their copies. Both tables must have been stored
    with the same key, leaves and fanout. Rows that differ by hashing alike in both sums would
    be missed; with 128 bits that is not to be expected."""
    (rows_a, tree_a), (rows_b, tree_b) = _digested(spark, a), _digested(spark, b)
    open_ = differing_leaves(tree_a, tree_b, fanout)
    sides = [rows.where(F.col(LEAF).isin(open_) if open_ else F.lit(False)).drop(LEAF) for rows in (rows_a, rows_b)]
    return value_diff(*sides, key=key if keyed else None, tol=tol)
