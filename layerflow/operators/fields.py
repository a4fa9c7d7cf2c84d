"""Field-level lineage: which source columns each column of a step comes from.

Steps are nodes of an edge table (src, dst) without circles. ``actions`` tells how a step's
columns arise: (step, name, source), one row for each column that ``name`` is made from; a null
source makes a column from nothing. ``removed`` (step, name) takes columns away, and a rename
is an action of the new name with the old one removed. All other columns pass through. Each
action of an ordered step may be a step of its own: see ``chain_actions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.operators.lineage import waves
from layerflow.session import cut, scratch_path


def chain_actions(actions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered actions as steps of their own: actions with a column ``position`` within their
    step become those of the steps ``step#position`` in a row, and edges lead from a step's last
    action to the next step's first. Gives the new actions and the new edges; ``removed`` rows
    are named by the same rule, and a step without actions keeps its name."""
    label = F.concat("step", F.lit("#"), F.format_string("%09d", F.col("position")))
    named = actions.withColumn("__label", label)
    order = Window.partitionBy("step").orderBy("position")
    places = named.select("step", "position", "__label").distinct().withColumn("next", F.lead("__label").over(order))
    ends = places.groupBy("step").agg(F.min("__label").alias("first"), F.max("__label").alias("last"))
    inner = places.where("next is not null").select(F.col("__label").alias("src"), F.col("next").alias("dst"))
    outer = edges.join(ends.select(F.col("step").alias("src"), "last"), "src", "left").withColumn("src", F.coalesce("last", "src"))
    outer = outer.join(ends.select(F.col("step").alias("dst"), "first"), "dst", "left").withColumn("dst", F.coalesce("first", "dst"))
    whole = inner.unionByName(outer.select("src", "dst"))
    renamed = named.withColumn("step", F.col("__label")).drop("__label", "position")
    return renamed, whole


def _passed_on(arrived: DataFrame, made: DataFrame, blocked: DataFrame) -> DataFrame:
    """What steps put out of the columns that arrive at them; each table has no row twice.
    ``blocked`` (step, name) lists the columns that are made or removed."""
    kept = arrived.join(blocked, ["step", "name"], "left_anti")
    derived = made.join(arrived.withColumnRenamed("name", "source"), ["step", "source"])
    derived = derived.select("step", "name", "origin_step", "origin").distinct()
    # a column that is made from nothing that exists is its own origin
    fresh = made.select("step", "name").distinct().join(derived.select("step", "name").distinct(), ["step", "name"], "left_anti")
    fresh = fresh.select("step", "name", F.col("step").alias("origin_step"), F.col("name").alias("origin"))
    return kept.unionByName(derived).unionByName(fresh)


def _stored(rows: DataFrame, label: str) -> tuple[str, T.StructType]:
    """Rows written in one folder for each wave: its path, and the schema to read it with."""
    path = scratch_path(rows.sparkSession, label)
    rows = rows.withColumn("wave", F.col("wave").cast("int"))
    rows.write.partitionBy("wave").parquet(path)
    return path, T.StructType([*[f for f in rows.schema.fields if f.name != "wave"], T.StructField("wave", T.IntegerType())])


def _dealt(edges: DataFrame, inputs: DataFrame, actions: DataFrame, removed: DataFrame):
    """(inputs, made, blocked, onward, last): the tables by the wave of their step, each written
    once, so that a wave reads its own rows only. ``onward`` (src, dst, to) leads to the
    wave ``to`` of the next step; ``inputs`` is a path and a schema, as more rows are added."""
    spark = edges.sparkSession
    pairs = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    # a step without a row here has none before it
    later = cut(waves(pairs).where("wave > 0").select(F.col("node").alias("step"), "wave"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(later, "step", "left").withColumn("wave", F.coalesce("wave", F.lit(0)))

    def reread(rows: DataFrame, label: str) -> DataFrame:
        path, schema = _stored(rows, label)
        return spark.read.schema(schema).parquet(path)

    made = reread(placed(actions.select("step", "name", "source").where("step is not null and name is not null").distinct()), "field-actions")
    gone = placed(removed.select("step", "name").where("step is not null and name is not null"))
    blocked = reread(made.select("step", "name", "wave").unionByName(gone).distinct(), "field-blocked")
    to = later.select(F.col("step").alias("dst"), F.col("wave").alias("to"))
    onward = placed(pairs.join(to, "dst").withColumnRenamed("src", "step")).withColumnRenamed("step", "src")
    own = inputs.select("step", F.col("column").alias("name")).where("step is not null and name is not null").distinct()
    last = later.agg(F.max("wave")).first()[0] or 0
    return placed(own), made, blocked, reread(onward, "field-edges"), last


def _of_wave(rows: DataFrame, number: int) -> DataFrame:
    return rows.where(F.col("wave") == number).drop("wave")


def _sent(rows: DataFrame, onward: DataFrame) -> DataFrame:
    """What steps put out, as rows of the steps that take it and their waves."""
    met = rows.withColumnRenamed("step", "src").join(onward, "src")
    return met.select(F.col("dst").alias("step"), *[c for c in rows.columns if c != "step"], F.col("to").alias("wave"))


def field_lineage(edges: DataFrame, inputs: DataFrame, actions: DataFrame, removed: DataFrame) -> DataFrame:
    """(step, name, origin_step, origin): for every column a step puts out, the columns of
    ``inputs`` (step, column) it comes from, over all ways through the graph; a column made from
    nothing, or only from columns that are not there, is its own origin. Columns of several
    parents with one name are one column. Raises when the steps run in a circle.

    Steps are done wave by wave: what a wave's steps put out is written, as part of the result
    and to the waves that take it, so every step is worked out once.
    """
    spark = edges.sparkSession
    own, made, blocked, onward, last = _dealt(edges, inputs, actions, removed)
    start = own.select("step", "name", F.col("step").alias("origin_step"), F.col("name").alias("origin"), "wave")
    inbox, schema = _stored(start, "fields")
    paths = []
    for number in range(last + 1):
        arrived = _of_wave(spark.read.schema(schema).parquet(inbox), number).distinct()
        paths.append(scratch_path(spark, "field-results"))
        _passed_on(arrived, _of_wave(made, number), _of_wave(blocked, number)).write.parquet(paths[-1])
        if number < last:
            put_out = spark.read.schema(T.StructType(schema.fields[:-1])).parquet(paths[-1])
            _sent(put_out, _of_wave(onward, number)).write.partitionBy("wave").mode("append").parquet(inbox)
    return spark.read.schema(T.StructType(schema.fields[:-1])).parquet(*paths)


def absent_fields(edges: DataFrame, inputs: DataFrame, actions: DataFrame, removed: DataFrame) -> DataFrame:
    """(step, name, source): uses of a column that no step before has created, or that one has
    removed or renamed, on every way to the step. Raises when the steps run in a circle.

    Only names go from wave to wave. What a step makes is there after it, whatever arrives, so
    that is sent on at once, and a wave only passes on what it neither makes nor removes.
    """
    spark = edges.sparkSession
    own, made, blocked, onward, last = _dealt(edges, inputs, actions, removed)
    written = made.select("step", "name").distinct()
    inbox, schema = _stored(own.unionByName(_sent(written, onward.drop("wave"))), "field-names")
    for number in range(last):
        arrived = _of_wave(spark.read.schema(schema).parquet(inbox), number).distinct()
        kept = arrived.join(_of_wave(blocked, number), ["step", "name"], "left_anti")
        _sent(kept, _of_wave(onward, number)).write.partitionBy("wave").mode("append").parquet(inbox)
    known = spark.read.schema(schema).parquet(inbox).select("step", F.col("name").alias("source")).distinct()
    uses = made.where("source is not null").select("step", "name", "source")
    return uses.join(known, ["step", "source"], "left_anti").select("step", "name", "source")
