"""Publishing, refresh and the layered models."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.functions.periods import period_start
from layerflow.operators.aggregates import recompute_check
from layerflow.operators.refresh import (
    append,
    backfill,
    incremental_append,
    publish,
    publish_view,
    refresh_mode,
    refresh_settings,
    write_extract,
)
from layerflow.operators.versions import append_version, compact, publish_version, read_rollup, read_version, refresh_rollup, republish
from layerflow.plans import models
from layerflow.plans.catalog.registry import query, table
from layerflow.session import scratch_path
from layerflow.sources import read_dataset, read_extract
from layerflow.streaming.incremental import incremental_stream
from layerflow.streaming.versions import ledger_stream, version_stream

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
_ALL_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"


def _orders(spark, root):
    return table(spark, root, "orders").select(*_ORDERS)


@query("j1_publish", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def j1(spark, root):
    folder = scratch_path(spark, "j1")
    publish(models.stg_shop__customer(spark, root), folder, "staging", "stg_shop__customer")
    # thin republish: another layer stores the same table unchanged
    stored = read_dataset(spark, folder, "stg_shop__customer", layer="staging")
    return publish(stored, folder, "marts", "dim_customers_raw")


@query("j2_publish_view", "SELECT o_orderkey, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'")
def j2(spark, root):
    mapped = table(spark, root, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    publish_view(mapped, "live_orders")
    return spark.sql("SELECT o_orderkey, priority FROM live_orders WHERE o_orderstatus = 'F'")


@query("j3_write_extract", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def j3(spark, root):
    path = scratch_path(spark, "j3")
    write_extract(table(spark, root, "supplier"), path)
    return read_extract(spark, path)


@query("j4_append", f"{_ALL_ORDERS} UNION ALL {_ALL_ORDERS}")
def j4(spark, root):
    path = scratch_path(spark, "j4")
    append(_orders(spark, root), path)
    append(_orders(spark, root), path)  # a full run on a filled output stores the rows again
    return read_extract(spark, path)


@query(
    "j5_incremental_append",
    f"""SELECT * FROM ({_ALL_ORDERS}) WHERE o_orderdate <= TIMESTAMP '1998-06-30'
        UNION ALL SELECT * FROM ({_ALL_ORDERS})
        WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30')""",
)
def j5(spark, root):
    path, orders = scratch_path(spark, "j5"), _orders(spark, root)
    first = orders.where("o_orderdate <= TIMESTAMP_NTZ'1998-06-30'")
    incremental_append(first, path, "o_orderdate")
    incremental_append(orders, path, "o_orderdate")
    return incremental_append(orders, path, "o_orderdate")  # nothing is new any more


@query("j5_full_run", f"{_ALL_ORDERS} UNION ALL {_ALL_ORDERS}")
def j5_full(spark, root):
    path, orders = scratch_path(spark, "j5"), _orders(spark, root)
    incremental_append(orders, path, "o_orderdate")
    return incremental_append(orders, path, "o_orderdate", mode="full")


@query("j6_incremental_stream", _ALL_ORDERS)
def j6(spark, root):
    arriving, out, marks = (scratch_path(spark, f"j6-{part}") for part in ("arriving", "out", "marks"))
    orders, cuts = _orders(spark, root), ("1996-12-31", "1999-06-30")
    early, middle, late = (
        f"o_orderdate <= TIMESTAMP_NTZ'{cuts[0]}'",
        f"o_orderdate > TIMESTAMP_NTZ'{cuts[0]}' AND o_orderdate <= TIMESTAMP_NTZ'{cuts[1]}'",
        f"o_orderdate > TIMESTAMP_NTZ'{cuts[1]}'",
    )
    stored = None
    for part in (early, middle, late):
        orders.where(part).write.mode("append").parquet(arriving)
        stored = incremental_stream(spark, arriving, out, "o_orderdate", marks, orders.schema)
    return stored


@query(
    "j7_refresh_mode",
    """WITH settings AS (SELECT c_nationkey AS flow, c_acctbal > 0 AS enabled,
                               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN lower(c_mktsegment) END AS control,
                               CASE WHEN c_acctbal < 8000 THEN 'out' END AS target FROM customer),
            outputs AS (SELECT s_nationkey AS flow, s_acctbal > 8000 AS appends FROM supplier),
            i AS (SELECT flow, count(*) FILTER (enabled AND control IS NOT NULL AND target IS NOT NULL) AS n_effective,
                         count(*) FILTER (enabled AND (control IS NULL OR target IS NULL)) AS n_inert,
                         string_agg(DISTINCT control, ', ' ORDER BY control) FILTER (enabled AND control IS NOT NULL AND target IS NOT NULL) AS fields FROM settings GROUP BY flow),
            o AS (SELECT flow, bool_or(appends) AS has_append FROM outputs GROUP BY flow)
       SELECT coalesce(i.flow, o.flow) AS flow, coalesce(n_effective, 0) AS n_effective, coalesce(n_inert, 0) AS n_inert,
              coalesce(has_append, false) AS has_append, coalesce(fields, '') AS control_fields,
              CASE WHEN coalesce(n_effective, 0) > 0 AND coalesce(has_append, false) THEN 'incremental' ELSE 'full' END AS run_type
       FROM i FULL JOIN o ON i.flow = o.flow""",
)
def j7(spark, root):
    settings = table(spark, root, "customer").selectExpr(
        "c_nationkey AS flow",
        "c_acctbal > 0 AS incremental_enabled",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN lower(c_mktsegment) END AS control_field",
        "CASE WHEN c_acctbal < 8000 THEN 'out' END AS output_node_id",
    )
    outputs = table(spark, root, "supplier").selectExpr(
        "s_nationkey AS flow",
        "'outputOperationTypeReplace' AS output_operation_type",
        "CASE WHEN s_acctbal > 8000 THEN 'outputOperationTypeAppend' END AS incremental_output_operation_type",
    )
    return refresh_mode(settings, outputs, "flow")


@query(
    "j8_backfill",
    f"""SELECT *, 'new' AS origin FROM ({_ALL_ORDERS}) WHERE o_orderdate >= TIMESTAMP '1998-01-01'
        UNION ALL SELECT *, 'old' FROM ({_ALL_ORDERS})
        WHERE o_orderdate < (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')""",
)
def j8(spark, root):
    orders = _orders(spark, root)
    new = orders.where("o_orderdate >= TIMESTAMP_NTZ'1998-01-01'").withColumn("origin", F.lit("new"))
    return backfill(new, orders.withColumn("origin", F.lit("old")), "o_orderdate")


@query(
    "k1_stg_orders",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
              o_orderpriority AS o_priority FROM orders""",
)
def k1(spark, root):
    return models.stg_shop__orders(spark, root)


_ENRICHED = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus,
           CAST(l_shipdate AS DATE) AS l_shipdate, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority AS o_priority,
           l_extendedprice * (1 - l_discount) AS revenue, l_returnflag = 'R' AS is_returned,
           CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS order_class
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_FACT = f"""
    SELECT o_orderkey, o_custkey, l_partkey, l_suppkey, l_linenumber, o_orderdate, l_quantity, revenue, is_returned, order_class
    FROM ({_ENRICHED})"""
_DIM = "SELECT c_custkey, c_mktsegment, c_acctbal, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"


@query("k2_int_orders_enriched", _ENRICHED)
def k2(spark, root):
    return models.int_orders_enriched(spark, root)


@query("k3_fct_sales", _FACT)
def k3(spark, root):
    return models.fct_sales(spark, root)


@query("k4_dim_customers", _DIM)
def k4(spark, root):
    return models.dim_customers(spark, root)


@query(
    "k5_rpt_sales_with_customer",
    f"""SELECT f.*, d.c_mktsegment, d.c_acctbal, d.n_name FROM ({_FACT}) f LEFT JOIN ({_DIM}) d ON f.o_custkey = d.c_custkey""",
)
def k5(spark, root):
    return models.rpt_sales_with_customer(spark, root)


@query(
    "k6_agg_revenue_monthly",
    f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
               sum(l_quantity) AS quantity, count(*) AS n_lines FROM ({_FACT}) GROUP BY 1""",
)
def k6(spark, root):
    return models.agg_revenue_monthly(spark, root)


@query(
    "k7_revenue_by_segment_monthly",
    f"""SELECT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
               CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n_lines
        FROM ({_FACT}) f LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def k7(spark, root):
    return models.revenue_by_segment_monthly(spark, root)


@query(
    "k8_published_layers",
    f"""SELECT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
               CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n_lines
        FROM ({_FACT}) f LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def k8(spark, root):
    published = models.publish_layers(spark, root, scratch_path(spark, "k8"))
    return models.monthly_by_segment(published["rpt_sales_with_customer"])


@query("j6_incremental_stream_ties", _ALL_ORDERS)
def j6_ties(spark, root):
    """Files that hold the same control values, and older ones: all rows are kept, each once."""
    arriving, out, marks = (scratch_path(spark, f"j6-{part}") for part in ("arriving", "out", "marks"))
    orders, stored = _orders(spark, root), None
    for part in ("o_orderkey % 3 = 2", "o_orderkey % 3 = 0", "o_orderkey % 3 = 1"):
        orders.where(part).write.mode("append").parquet(arriving)
        stored = incremental_stream(spark, arriving, out, "o_orderdate", marks, orders.schema, late="keep")
    return stored


@query(
    "j7_refresh_settings",
    """SELECT c_custkey AS input_node_id, CASE WHEN NOT c_acctbal > 0 THEN 'off'
              WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal < 8000 THEN 'effective' ELSE 'inert' END AS status,
              CASE WHEN c_acctbal < 8000 THEN n_regionkey = 1 END AS is_incremental_default
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def j7_settings(spark, root):
    settings = table(spark, root, "customer").selectExpr(
        "c_custkey AS input_node_id",
        "c_acctbal > 0 AS incremental_enabled",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN lower(c_mktsegment) END AS control_field",
        "CASE WHEN c_acctbal < 8000 THEN concat('out', c_nationkey) END AS output_node_id",
    )
    outputs = table(spark, root, "nation").selectExpr("concat('out', n_nationkey) AS output_node_id", "n_regionkey = 1 AS is_incremental_default")
    return refresh_settings(settings, outputs).select("input_node_id", "status", "is_incremental_default")


def _waves(orders, cuts=("1995-12-31", "1997-06-30", "1999-12-31")):
    """The orders up to each date, and all of them."""
    return [*[orders.where(f"o_orderdate <= TIMESTAMP_NTZ'{d}'") for d in cuts], orders]


@query(
    "j1_publish_version",
    """SELECT 'old reader' AS seen_by, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer
       UNION ALL SELECT 'new reader', count(*), CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer WHERE c_acctbal > 0
       UNION ALL SELECT 'republished', count(*), CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer WHERE c_acctbal > 0""",
)
def j1_version(spark, root):
    path, other = scratch_path(spark, "j1-versions"), scratch_path(spark, "j1-republished")
    before = publish_version(models.stg_shop__customer(spark, root), path, token="first run")
    after = publish_version(read_version(spark, path).where("c_acctbal > 0"), path, partition_by="c_mktsegment", token="second run")
    for _ in range(2):  # the second time nothing is left to do
        again = republish(spark, path, other)
    balance = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance")
    parts = {"old reader": before, "new reader": after, "republished": again}
    counted = [df.agg(F.count(F.lit(1)).alias("n"), balance).select(F.lit(k).alias("seen_by"), "n", "balance") for k, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("j5_stored_mark", f"{_ALL_ORDERS}")
def j5_mark(spark, root):
    path, orders = scratch_path(spark, "j5-mark"), _orders(spark, root)
    for upto in _waves(orders):
        append_version(upto, path, "o_orderdate", partition_by="o_orderstatus")
    append_version(orders, path, "o_orderdate")  # nothing is above the mark any more
    return compact(spark, path)


@query("j6_version_stream", _ALL_ORDERS)
def j6_version(spark, root):
    arriving, path, marks = (scratch_path(spark, f"j6-version-{part}") for part in ("arriving", "out", "marks"))
    orders = _orders(spark, root)
    # the latest first: late rows are kept, and every batch is stored once
    for part in ("o_orderdate > TIMESTAMP_NTZ'1998-06-30'", "o_orderdate <= TIMESTAMP_NTZ'1998-06-30'"):
        orders.where(part).write.mode("append").parquet(arriving)
        stored = version_stream(spark, arriving, path, "o_orderdate", marks, orders.schema, late="keep")
    return stored


_ROLLED = """SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
                    CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n_orders,
                    min(o_totalprice) AS smallest, max(o_totalprice) AS largest, count(DISTINCT o_custkey) AS customers,
                    CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS average FROM orders GROUP BY 1, 2"""


def _rollup_measures():
    price = F.col("o_totalprice").cast("decimal(18,4)")
    return {
        "revenue": ("sum", price), "n_orders": ("count", F.lit(1)), "smallest": ("min", "o_totalprice"),
        "largest": ("max", "o_totalprice"), "customers": ("countd", "o_custkey"),
    }


@query("e2_refresh_rollup", _ROLLED)
def e2_refresh(spark, root):
    path, by = scratch_path(spark, "e2-rollup"), ["o_orderstatus", "period"]
    for upto in _waves(_orders(spark, root)):
        dated = upto.withColumn("period", period_start(F.col("o_orderdate"), "month"))
        stored = refresh_rollup(dated, path, "o_orderdate", by, _rollup_measures(), part_by="period")
    revenue = F.col("revenue").cast("double")
    return stored.withColumns({"revenue": revenue, "average": revenue / F.col("n_orders")})


@query(
    "e4_rollup_history",
    """WITH cuts AS (SELECT unnest([1, 2, 3, 4]) AS version,
                            unnest([TIMESTAMP '1995-12-31', TIMESTAMP '1997-06-30', TIMESTAMP '1999-12-31', TIMESTAMP '9999-12-31']) AS upto)
       SELECT version, count(DISTINCT o_orderdate) AS n_groups, 0 AS n_wrong FROM cuts JOIN orders ON o_orderdate <= upto GROUP BY version""",
)
def e4_history(spark, root):
    path, by, out = scratch_path(spark, "e4-rollup"), ["o_orderdate"], None
    measures = {k: v for k, v in _rollup_measures().items() if k != "customers"}
    for number, upto in enumerate(_waves(_orders(spark, root)), 1):
        refresh_rollup(upto, path, "o_orderdate", by, measures)
        stored = read_rollup(spark, path, by, measures, number)
        wrong = recompute_check(stored, upto, by, measures).select(F.lit(1).alias("wrong"))
        both = stored.select(F.lit(0).alias("wrong")).unionByName(wrong)
        row = both.agg(F.count_if(F.col("wrong") == 0).alias("n_groups"), F.count_if(F.col("wrong") == 1).cast("int").alias("n_wrong"))
        row = row.withColumn("version", F.lit(number).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "n1_ledger_stream",
    """SELECT o_custkey, max(o_orderdate) AS o_orderdate, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
       FROM orders GROUP BY o_custkey""",
)
def n1_stream(spark, root):
    arriving, path, marks = (scratch_path(spark, f"n1-{part}") for part in ("arriving", "log", "marks"))
    runs = table(spark, root, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    # the middle arrives last, and a part arrives twice
    parts = [F.col("o_orderkey") % 3 != 1, F.col("o_orderkey") % 7 == 2, F.col("o_orderkey") % 3 == 1]
    for part in parts:
        runs.where(part).write.mode("append").parquet(arriving)
        ledger = ledger_stream(spark, arriving, path, marks, runs.schema, "o_custkey", "o_orderdate")
    return ledger
