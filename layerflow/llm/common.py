"""What the corpus operators share: the query register, row packing and connected components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.session import cut
from layerflow.sources import read_dataset

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Longest array that expands one row; longer expansions go through several rows.
EXPAND_STEP = 10_000


#: A side with at most so many short rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows where SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_dataset(spark, root, name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of a row as the struct ``row``, beside the named working columns. Names
    that an input happens to use can thus not clash with working columns."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()]
    )


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def expand(df: DataFrame, count: str, index: str) -> DataFrame:
    """``count`` rows for each row, numbered from 0 in ``index``; no array gets longer than
    EXPAND_STEP whatever the count."""
    step = F.lit(EXPAND_STEP)
    steps = df.where(F.col(count) > 0).withColumn(
        "__step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / step)))
    )
    first = F.col("__step") * step
    last = F.least(first + step, F.col(count)) - 1
    return steps.withColumn(index, F.explode(F.sequence(first, last))).drop("__step")


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The connected components of an undirected graph given by its edges, as (node, root)
    with the smallest node of each component as its root. Roots themselves are included.

    Large-star and small-star rounds (Kiveris et al. 2014): every round hangs nodes below the
    smallest neighbour, so the number of rounds grows with the logarithm of the longest path.
    Each round's edges are written to the shared folder. Null ends are left out.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = pairs.where("a = b")
    pairs, before = pairs.where("a <> b"), None
    while True:
        now = _marks(pairs)
        if now == before or not now[0]:
            break
        before = now
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        pairs = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))
    alone = loops.select(F.col("a").alias("node"), F.col("b").alias("root")).join(
        found.select("node"), "node", "left_anti"
    )
    return found.unionByName(roots).unionByName(alone).distinct()


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of column lists of two joined tables."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out
