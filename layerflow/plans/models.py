"""The layered example model: staging views, one intermediate table, marts.

Each model is a function from the session and the folder of source tables to one table.
Nothing is stored unless ``publish`` is called on a result, so filters and column choices of
a report reach the source scan through all layers. Column names stay as in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.operators.aggregates import rollup_grain
from layerflow.operators.clean import add_column, filter_rows
from layerflow.operators.columns import augment
from layerflow.operators.joins import join
from layerflow.operators.refresh import publish, publish_view
from layerflow.sources import read_dataset, scan

# Column mappings of the staging tables.
ORDERS_MAPPING = [
    {"op": "cast", "column_name": "[o_orderdate]", "to_caption": "o_orderdate", "to_datatype": "date"},
    {"op": "cast", "column_name": "[o_totalprice]", "to_caption": "o_totalprice", "to_datatype": "real"},
    {"op": "rename", "column_name": "[o_orderpriority]", "to_caption": "o_priority"},
]
CUSTOMER_MAPPING = [
    {"op": "hide", "column_name": "[c_name]"},
    {"op": "cast", "column_name": "[c_nationkey]", "to_caption": "c_nationkey", "to_datatype": "integer"},
]
LINEITEM_MAPPING = [
    {"op": "cast", "column_name": "[l_shipdate]", "to_caption": "l_shipdate", "to_datatype": "date"},
    {"op": "hide", "column_name": "[l_tax]"},
]
NATION_MAPPING = [
    {"op": "cast", "column_name": "[n_nationkey]", "to_caption": "n_nationkey", "to_datatype": "integer"},
]


def stg_shop__orders(spark: SparkSession, root: str) -> DataFrame:
    return publish_view(augment(read_dataset(spark, root, "orders"), ORDERS_MAPPING), "stg_shop__orders")


def stg_shop__customer(spark: SparkSession, root: str) -> DataFrame:
    mapped = augment(read_dataset(spark, root, "customer"), CUSTOMER_MAPPING)
    return publish_view(mapped, "stg_shop__customer")


def stg_shop__lineitem(spark: SparkSession, root: str) -> DataFrame:
    mapped = augment(read_dataset(spark, root, "lineitem"), LINEITEM_MAPPING)
    return publish_view(mapped, "stg_shop__lineitem")


def stg_shop__nation(spark: SparkSession, root: str) -> DataFrame:
    return publish_view(augment(read_dataset(spark, root, "nation"), NATION_MAPPING), "stg_shop__nation")


def enrich_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines with their order, and the business columns."""
    lines = filter_rows(lineitem, "l_orderkey IS NOT NULL")
    joined = join(lines, orders, [("l_orderkey", "o_orderkey")], "inner")
    priced = add_column(joined, "revenue", "l_extendedprice * (1 - l_discount)")
    flagged = add_column(priced, "is_returned", "l_returnflag = 'R'")
    return add_column(
        flagged,
        "order_class",
        "CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END",
    )


def sales_of(enriched: DataFrame) -> DataFrame:
    return scan(
        enriched,
        [
            "o_orderkey", "o_custkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderdate",
            "l_quantity", "revenue", "is_returned", "order_class",
        ],
    )


def with_customer(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """One wide table: the fact with its dimension joined in."""
    return join(sales, customers, [("o_custkey", "c_custkey")], "left", right_unique=True).drop("c_custkey")


def monthly_by_segment(report: DataFrame) -> DataFrame:
    measures = {
        "revenue": ("sum", F.col("revenue").cast("decimal(18,4)")),
        "n_lines": ("count", F.lit(1)),
    }
    rolled = rollup_grain(report, "o_orderdate", "month", "c_mktsegment", measures)
    return rolled.withColumn("revenue", F.col("revenue").cast("double"))


def int_orders_enriched(spark: SparkSession, root: str) -> DataFrame:
    return enrich_orders(stg_shop__lineitem(spark, root), stg_shop__orders(spark, root))


def fct_sales(spark: SparkSession, root: str) -> DataFrame:
    return sales_of(int_orders_enriched(spark, root))


def dim_customers(spark: SparkSession, root: str) -> DataFrame:
    customers, nations = stg_shop__customer(spark, root), stg_shop__nation(spark, root)
    named = join(customers, nations, [("c_nationkey", "n_nationkey")], "left", right_unique=True)
    return scan(named, ["c_custkey", "c_mktsegment", "c_acctbal", "n_name"])


def rpt_sales_with_customer(spark: SparkSession, root: str) -> DataFrame:
    return with_customer(fct_sales(spark, root), dim_customers(spark, root))


def agg_revenue_monthly(spark: SparkSession, root: str) -> DataFrame:
    measures = {
        "revenue": ("sum", F.col("revenue").cast("decimal(18,4)")),
        "quantity": ("sum", "l_quantity"),
        "n_lines": ("count", F.lit(1)),
    }
    rolled = rollup_grain(fct_sales(spark, root), "o_orderdate", "month", [], measures)
    return rolled.withColumn("revenue", F.col("revenue").cast("double"))


def revenue_by_segment_monthly(spark: SparkSession, root: str) -> DataFrame:
    """Monthly revenue by market segment, from the wide report table."""
    return monthly_by_segment(rpt_sales_with_customer(spark, root))


def publish_layers(spark: SparkSession, root: str, out: str) -> dict[str, DataFrame]:
    """Store the intermediate table and the marts below ``out``, each from the stored tables of
    the layer before, and give them back by name. Staging stays live."""
    enriched = publish(int_orders_enriched(spark, root), out, "intermediate", "int_orders_enriched")
    sales = publish(sales_of(enriched), out, "marts", "fct_sales")
    customers = publish(dim_customers(spark, root), out, "marts", "dim_customers")
    report = publish(with_customer(sales, customers), out, "marts", "rpt_sales_with_customer")
    return {
        "int_orders_enriched": enriched,
        "fct_sales": sales,
        "dim_customers": customers,
        "rpt_sales_with_customer": report,
    }
