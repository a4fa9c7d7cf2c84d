"""Grouping the values of a column that are spelled or sound alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import col, require_columns
from layerflow.operators.clean import group_values
from layerflow.operators.graphs import connected_components
from layerflow.session import cut


def _segments(size: Column, count: int, i: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of ``count`` even segments of a text."""
    short, longer = F.floor(size / count), size % count
    plain = F.lit(count) - longer  # the first segments are the shorter ones
    extra = F.greatest(F.lit(0), F.lit(i) - plain)
    return (F.lit(i) * short + extra).cast("int"), (short + (F.lit(i) >= plain).cast("int")).cast("int")


def similar_pairs(values: DataFrame, column: str, distance: int = 1) -> DataFrame:
    """(a, b, edits): every two different values at most ``distance`` edits apart, once, with
    ``a`` the shorter, or the smaller of equal length. Nulls are left out.

    A text is cut into ``distance + 1`` segments; an edit touches one of them at most, so one
    is left whole in any text near enough, moved by at most ``distance``. Texts meet by an
    equi-join on length, number and content of a segment, and only those are compared.
    """
    if distance < 1:
        raise ValueError("similar_pairs: the distance is at least 1")
    texts = cut(values.select(col(column).cast("string").alias("text")).where("text is not null").distinct())
    texts = texts.withColumn("size", F.length("text"))
    count, size = distance + 1, F.col("size")
    own, asked = [], []
    for i in range(count):
        start, length = _segments(size, count, i)
        own.append(F.struct(F.lit(i).alias("i"), F.substring(F.col("text"), start + 1, length).alias("segment")))
        for less in range(count):
            start, length = _segments(size - less, count, i)
            for moved in range(-distance, distance + 1):
                first = start + moved
                inside = (size >= less) & (first >= 0) & (first + length <= size)
                found = F.struct((size - less).alias("of"), F.lit(i).alias("i"), F.substring(F.col("text"), first + 1, length).alias("segment"))
                asked.append(F.when(inside, found))
    known = texts.select(F.col("text").alias("a"), F.col("size").alias("of"), F.inline(F.array(*own)))
    wanted = texts.select(F.col("text").alias("b"), F.col("size").alias("size_b"), F.inline(F.array_distinct(F.array_compact(F.array(*asked)))))
    met = known.join(wanted, ["of", "i", "segment"]).where("of < size_b or a < b").select("a", "b").distinct()
    compared = met.withColumn("edits", F.levenshtein("a", "b", distance))
    return compared.where("edits > 0")


def _chosen(counted: DataFrame) -> DataFrame:
    """(spelling, value) of (cluster, spelling, n): the most frequent spelling stands for its
    cluster, the smallest among equals. Clusters of one spelling have no rows."""
    best = counted.groupBy("cluster").agg(
        F.min(F.struct((-F.col("n")).alias("less"), "spelling")).alias("best"), F.count(F.lit(1)).alias("spellings")
    )
    known = best.where("spellings > 1").select("cluster", F.col("best.spelling").alias("value"))
    return counted.join(known, "cluster").select("spelling", "value")


def similar_values(df: DataFrame, column: str, by: str = "spelling", distance: int = 1, ignore_case: bool = True) -> DataFrame:
    """A mapping (spelling, value) for ``group_values``, made from the column's own values.

    ``by="spelling"`` puts values together that at most ``distance`` edits part, directly or
    over others between them (regardless of case with ``ignore_case``). ``by="pronunciation"``
    puts those together that have one soundex code; values that do not begin with a letter
    A-Z have none. The most frequent spelling of a cluster is its value, the smallest among
    equals. Nulls are left out, and so are values that stand alone.
    """
    if by not in ("spelling", "pronunciation"):
        raise ValueError("similar_values: by must be 'spelling' or 'pronunciation'")
    require_columns(df, [column], "similar_values")
    counted = df.select(col(column).cast("string").alias("spelling")).where("spelling is not null")
    counted = cut(counted.groupBy("spelling").agg(F.count(F.lit(1)).alias("n")))
    if by == "pronunciation":
        coded = counted.where(F.col("spelling").rlike("^[A-Za-z]")).withColumn("cluster", F.soundex("spelling"))
        return _chosen(coded)
    folded = counted.withColumn("folded", F.lower("spelling") if ignore_case else F.col("spelling"))
    clusters = connected_components(similar_pairs(folded, "folded", distance))
    met = folded.join(clusters.withColumnRenamed("node", "folded"), "folded", "left")
    return _chosen(met.select(F.coalesce("root", "folded").alias("cluster"), "spelling", "n"))


def group_similar(df: DataFrame, column: str, by: str = "spelling", distance: int = 1, ignore_case: bool = True) -> DataFrame:
    """Bring the spellings of each value to one, without a map made by hand."""
    return group_values(df, column, similar_values(df, column, by, distance, ignore_case))
