"""JSON documents held in string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import col
from layerflow.session import cut

# Where a metric definition refers to fields.
_DEFINITION = """
    specification STRUCT<
        basic_specification: STRUCT<
            measure: STRUCT<field: STRING>,
            time_dimension: STRUCT<field: STRING>,
            filters: ARRAY<STRUCT<field: STRING>>>,
        viz_state_specification: STRUCT<viz_state_string: STRING>>,
    extension_options STRUCT<allowed_dimensions: ARRAY<STRING>>
"""
_VIZ_STATE = """
    vizState STRUCT<
        rows: ARRAY<STRUCT<fieldCaption: STRING>>,
        columns: ARRAY<STRUCT<fieldCaption: STRING>>,
        filters: ARRAY<STRUCT<fieldCaption: STRING>>>
"""


def explode_object(df: DataFrame, column: str, key: str = "id", value: str = "value") -> DataFrame:
    """One row per member of a JSON object; members come out as text."""
    members = F.from_json(col(column), "map<string,string>")
    others = [col(c) for c in df.columns if c != column]
    return df.select(*others, F.explode(members).alias(key, value))


def json_collect(df: DataFrame, column: str, keys: Sequence[str], name: str = "value") -> DataFrame:
    """One row per distinct string a document holds under ``keys``, at whatever depth: strings,
    and the strings of lists, that such a key holds.

    Depth is unknown, so no fixed schema fits: documents become variants, which are unfolded
    level by level, in the JVM, until no level is left; each level is written down. Malformed
    documents (objects that repeat a key among them) give no rows here; ``malformed_documents``
    finds them. A row of ``df`` that occurs several times counts once for each occurrence.
    """
    spark, others = df.sparkSession, [c for c in df.columns if c != column]
    row = F.struct(*[col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    level = cut(
        df.select(F.uuid().alias("id"), row.alias("row"), F.try_parse_json(col(column)).alias("held"), F.lit(False).alias("listed"))
        .where("held is not null")
    )
    wanted, found = F.coalesce(F.col("key").isin(*keys), F.lit(False)), None
    while not level.isEmpty():
        members = level.lateralJoin(spark.tvf.variant_explode(F.col("held").outer())).withColumn("kind", F.schema_of_variant("value"))
        members = cut(members.select("id", "row", "value", "kind", wanted.alias("wanted"), (F.col("listed") & F.col("key").isNull()).alias("member")))
        texts = members.where("kind = 'STRING' and (wanted or member)")
        texts = texts.select("id", "row", F.variant_get("value", "$", "string").alias("text"))
        found = texts if found is None else found.unionByName(texts)
        deeper = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        level = members.where(deeper).select(
            "id", "row", F.col("value").alias("held"), (F.col("wanted") & F.col("kind").startswith("ARRAY")).alias("listed")
        )
    if found is None:
        return df.select(*[col(c) for c in others], F.lit(None).cast("string").alias(name)).limit(0)
    once = found.groupBy("id", "text").agg(F.first("row").alias("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in others], F.col("text").alias(name))


def malformed_documents(df: DataFrame, column: str) -> DataFrame:
    """The rows whose document does not parse; null is no document."""
    return df.where(col(column).isNotNull() & F.try_parse_json(col(column)).isNull())


def referenced_fields(definitions: DataFrame, key: str, column: str, name: str = "field") -> DataFrame:
    """Distinct field names each metric definition refers to: measure, time dimension,
    filters, allowed dimensions, and the shelves of an embedded view state (itself JSON in
    a string; when it does not parse it gives nothing)."""
    doc = F.from_json(col(column), _DEFINITION)
    basic = doc["specification"]["basic_specification"]
    state = F.from_json(
        doc["specification"]["viz_state_specification"]["viz_state_string"], _VIZ_STATE
    )["vizState"]

    def texts(values):
        return F.coalesce(values, F.array().cast("array<string>"))

    fields = F.concat(
        F.array(basic["measure"]["field"], basic["time_dimension"]["field"]),
        texts(basic["filters"]["field"]),
        texts(doc["extension_options"]["allowed_dimensions"]),
        texts(state["rows"]["fieldCaption"]),
        texts(state["columns"]["fieldCaption"]),
        texts(state["filters"]["fieldCaption"]),
    )
    exploded = definitions.select(col(key), F.explode(F.array_distinct(fields)).alias(name))
    return exploded.where(col(name).isNotNull() & (col(name) != "")).distinct()
