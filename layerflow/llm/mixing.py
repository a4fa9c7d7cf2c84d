"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerflow.llm.common import expand, query, same, table, text_or_empty

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: What the mix takes in all, as a part of all sizes.
SHARE = 1.5
#: The most that a source gives, as a multiple of its size.
MOST = 2.0
SEED = "mix"


def word_count(name: str = "text") -> Column:
    """The number of runs of characters other than blank, tab, and the line breaks up to CR."""
    trimmed = F.btrim(text_or_empty(name), F.lit(" \t\n\x0b\x0c\r"))
    gaps = F.length(F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x"))
    return gaps.cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` has a row (source, source_size) for each source; the result adds ``target``.

    Sources take the weights in turn, by name in code-point order with null last. The targets
    share ``share`` times all sizes by weight; a target stops at ``most`` times its size and
    what it cannot take goes to the others by weight. That fixed point is found in one pass:
    in the order of size by weight, a source is full when giving every later source the same
    level per weight would exceed its size. Without any size all targets are 0.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most))
    every = Window.partitionBy()
    ranked = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("open"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    )
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level.getField("level"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def size_class(size: Column) -> Column:
    """Classes of sizes at most a sixteenth wide, rising with the size."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 5, F.lit(0))
    return (bits * 32 + F.call_function("shiftright", size, shift.cast("int"))).cast("int")


def _in_source(rows: DataFrame) -> DataFrame:
    """Number the rows of each source from 0 as ``place``, in classes of size and then by MD5,
    so that neighbours in this order have nearly the same size. No window receives a source:
    rows are numbered within (source, size class, 16 hash bins) and moved up by a table that
    has a row for each of those."""
    keys = ["source", "class", "bin"]
    inside = Window.partitionBy(*keys).orderBy("tie", "size", "crc", "doc_id")
    numbered = rows.withColumn("local", F.row_number().over(inside) - 1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("source").orderBy("class", "bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.coalesce(F.sum("n").over(below), F.lit(0)).alias("offset"))
    moved = numbered.join(offsets, same(keys, [f"o_{k}" for k in keys]))
    return moved.withColumn("place", F.col("offset") + F.col("local")).drop(
        "o_source", "o_class", "o_bin", "local", "offset"
    )


def mixed_copies(docs: DataFrame, carry: Column, seed: str = SEED) -> DataFrame:
    """How often the mix takes each row: (doc_id, size, source, source_size, target, copies)
    and the column ``carry``.

    Every row of a source expects target / source_size copies. The expected copies are added
    up in a fixed order, one random offset is added for the source, and a row is taken once
    for each whole number that its part of the sum crosses: never more than twice at these
    targets. The order goes by size, so each stretch of it takes near its share of words. The
    offset comes from a hash of the seed and the source's name: reruns agree.

    Null text has size 0; a null source is a source of its own; rows of size 0 are drawn like
    others and take no words. A source without words takes nothing.
    """
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count().alias("size"),
        F.crc32(text_or_empty()).alias("crc"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("tie"),
        carry.alias("carry"),
    )
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("bin", F.substring("tie", 1, 1))
    sizes = (
        docs.select(F.col("source"), word_count().alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    )
    targets = source_targets(sizes).withColumnsRenamed({"source": "t_source"})
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("t_source", F.lit("")))), 1, 8), 16, 10)
    targets = targets.select(
        "*",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (drawn.cast("double") / F.lit(4294967296.0)).alias("start"),
    )
    placed = _in_source(rows).join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    upto = lambda n: F.floor(n * F.col("rate") + F.col("start"))
    copies = (upto(F.col("place") + 1) - upto(F.col("place"))).cast("long")
    return placed.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), "carry")


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return expand(mixed_copies(docs, whole, seed), "copies", "copy").select("carry.*")


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight,
  source_size * 2.0::DOUBLE AS most FROM s),
c AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total,
  coalesce(sum(most) OVER b, 0) AS below, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open
  FROM w WINDOW b AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - below) / open AS level, (total - below) / open * weight >= most AS is_full FROM c),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most
  ELSE weight * (SELECT arg_min(level, most / weight) FROM l WHERE NOT is_full) END AS target,
  (('0x' || md5('{SEED}:' || coalesce(source, ''))[1:8])::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start FROM l),
k AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '')) AS tie, len(bin(size)) AS bits FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source
  ORDER BY bits * 32 + (size >> greatest(bits - 5, 0)), tie, size, doc_id) - 1 AS place FROM k)
SELECT p.doc_id, p.size, t.source_size, t.target,
  (p.size * CASE WHEN t.source_size > 0
    THEN floor((p.place + 1) * (t.target / t.source_size) + t.start) - floor(p.place * (t.target / t.source_size) + t.start)
    ELSE 0 END)::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


@query("op10_mixing", OP10_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixed_copies(docs, F.lit(None).cast("int")).select("doc_id", "size", "source_size", "target", taken)
