"""Sources, column operations and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.operators.clean import (
    action,
    add_column,
    add_row_unit,
    clean,
    filter_rows,
    fix_case,
    group_values,
    replace_value,
    split_column,
    trim_whitespace,
    value_filter,
)
from layerflow.operators.columns import augment, cast, hide, rename, rename_back
from layerflow.operators.refresh import publish, write_extract
from layerflow.operators.windows import fixed, row_number
from layerflow.operators.spellings import group_similar, similar_values
from layerflow.plans.catalog.registry import query, table, text_where
from layerflow.session import scratch_path
from layerflow.sources import (
    first_rows,
    limit_rows,
    read_csv,
    read_dataset,
    read_extract,
    read_sql,
    sample_groups,
    sample_rows,
    scan,
)


@query("a1_read_dataset", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def a1(spark, root):
    return read_dataset(spark, root, "orders")


@query("a1_read_upstream", "SELECT c_custkey, c_mktsegment FROM customer")
def a1_upstream(spark, root):
    folder = scratch_path(spark, "a1")
    publish(scan(table(spark, root, "customer"), ["c_custkey", "c_mktsegment"]), folder, "staging", "stg_shop__customer")
    return read_dataset(spark, folder, "stg_shop__customer", layer="staging")


@query(
    "a2_read_sql",
    """SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total
       FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_totalprice > 1000 GROUP BY o_orderpriority""",
)
def a2(spark, root):
    return read_sql(
        spark,
        """SELECT o_orderpriority, count(*) AS n_orders,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total
           FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ'1997-01-01' AND o_totalprice > :least
           GROUP BY o_orderpriority""",
        args={"least": 1000},
        orders=table(spark, root, "orders"),
    )


@query("a3_read_csv", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def a3(spark, root):
    path = scratch_path(spark, "a3")
    columns = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    scan(table(spark, root, "part"), columns).write.csv(path, header=True)
    return read_csv(spark, path, "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT, p_retailprice DOUBLE")


@query("a4_read_extract", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def a4(spark, root):
    path = scratch_path(spark, "a4")
    write_extract(table(spark, root, "events"), path)
    return read_extract(spark, path)


@query(
    "a5_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25",
)
def a5(spark, root):
    return scan(
        table(spark, root, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_quantity"],
        "l_returnflag = 'R' AND l_quantity >= 25",
    )


@query(
    "a6_limit_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500",
)
def a6(spark, root):
    return limit_rows(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_totalprice", "o_orderkey"])


@query(
    "a6_first_rows",
    """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
       ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT (SELECT count(*) // 3 FROM lineitem)""",
)
def a6_first(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return first_rows(lines, lines.count() // 3, ["l_shipdate", "l_orderkey", "l_linenumber"])


@query(
    "a7_sample_groups",
    """SELECT event_type, event_id FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY substr(md5('5|' || CAST(event_id AS VARCHAR)), 1, 8), event_id) <= 100""",
)
def a7_groups(spark, root):
    return sample_groups(table(spark, root, "events").select("event_type", "event_id"), 100, "event_type", "event_id", seed=5)


@query(
    "a7_sample_rows",
    # a draw below 0.1 of 2^32 is a hexadecimal prefix up to 19999999
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE substr(md5('7|' || CAST(o_orderkey AS VARCHAR)), 1, 8) <= '19999999'",
)
def a7(spark, root):
    return sample_rows(table(spark, root, "orders").select("o_orderkey", "o_orderstatus"), 0.1, seed=7, key="o_orderkey")


@query(
    "a7_sample_rows_by_group",
    """SELECT event_id, event_type FROM events
       WHERE (event_type = 'purchase' AND substr(md5('3|' || CAST(event_id AS VARCHAR)), 1, 8) < '80000000')
          OR (event_type = 'error' AND substr(md5('3|' || CAST(event_id AS VARCHAR)), 1, 8) < '40000000')""",
)
def a7_by_group(spark, root):
    shares = {"purchase": 0.5, "error": 0.25}
    return sample_rows(table(spark, root, "events").select("event_id", "event_type"), shares, seed=3, by="event_type", key="event_id")


@query("b1_rename", "SELECT c_custkey AS id, c_mktsegment AS c_label, c_name AS c_mktsegment FROM customer")
def b1(spark, root):
    customers = table(spark, root, "customer").select("c_custkey", "c_mktsegment", "c_name")
    # in order: the first name is free again when the last pair takes it
    return rename(customers, [("c_custkey", "key"), ("c_mktsegment", "c_label"), ("key", "id"), ("c_name", "c_mktsegment")])


@query(
    "b2_cast",
    """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level,
              TRY_CAST(o_orderstatus AS DOUBLE) AS status, CAST(o_orderdate AS DATE) AS o_orderdate,
              CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
)
def b2(spark, root):
    orders = table(spark, root, "orders").select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).alias("level"),
        F.col("o_orderstatus").alias("status"),
        "o_orderdate",
        "o_custkey",
    )
    return cast(orders, {"level": "integer", "status": "real", "o_orderdate": "date", "o_custkey": "string"})


@query("b3_hide", "SELECT s_suppkey, s_nationkey FROM supplier")
def b3(spark, root):
    return hide(table(spark, root, "supplier"), ["s_name", "s_acctbal"])


@query(
    "b4_augment",
    """SELECT o_orderkey AS order_id, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus AS status, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS has_price,
              CAST(o_orderdate AS DATE) AS ordered_on FROM orders""",
)
def b4(spark, root):
    mapped = augment(
        table(spark, root, "orders"),
        [
            {"op": "rename", "column_name": "[o_orderkey]", "to_caption": "order_id"},
            {"op": "rename", "column_name": "[o_orderstatus]", "to_caption": "state"},
            {"op": "rename", "column_name": "[o_orderstatus]", "to_caption": "status"},
            {"op": "cast", "column_name": "[o_totalprice]", "to_caption": "price_text", "to_datatype": "string"},
            {"op": "cast", "column_name": "[o_orderdate]", "to_caption": "ordered_on", "to_datatype": "date"},
            {"op": "cast", "column_name": "[o_custkey]", "to_datatype": "integer"},
            {"op": "hide", "column_name": "[o_orderpriority]"},
            {"op": "rename", "column_name": "[no_such_column]", "to_caption": "ignored"},
        ],
    )
    return add_column(mapped, "has_price", "price_text IS NOT NULL").drop("price_text")


@query(
    "b5_rename_back",
    "SELECT o_orderkey, o_orderdate, o_orderdate AS o_orderdate_ship, o_totalprice FROM orders",
)
def b5(spark, root):
    orders = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderdate").alias("settled"),
        F.col("o_orderdate").alias("settled_ship"),
        F.col("o_totalprice").alias("price"),
    )
    return rename_back(orders, [("settled", "o_orderdate"), ("key", "o_orderkey"), ("price", "o_totalprice")])


@query(
    "c1_value_filter",
    """SELECT o_orderkey, status FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority FROM orders)
       WHERE status IS NOT NULL AND status IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""",
)
def c1(spark, root):
    orders = table(spark, root, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    present = value_filter(orders, "status", keep=["F", "O"], not_null=True)
    return value_filter(present, "o_orderpriority", exclude=["1-URGENT", "5-LOW"]).select("o_orderkey", "status")


@query(
    "c1_value_filter_nulls",
    """SELECT o_orderkey, status FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)
       WHERE status IS NULL OR status <> 'F'""",
)
def c1_nulls(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return value_filter(orders, "status", exclude=["F"])


@query(
    "c2_filter_rows",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE l_discount BETWEEN 0.03 AND 0.07 AND (l_returnflag = 'A' OR l_shipdate >= TIMESTAMP '1999-01-01')""",
)
def c2(spark, root):
    kept = filter_rows(
        table(spark, root, "lineitem"),
        "l_discount BETWEEN 0.03D AND 0.07D AND (l_returnflag = 'A' OR l_shipdate >= TIMESTAMP_NTZ'1999-01-01')",
    )
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "c3_add_column",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
              concat(c_mktsegment, '/', c_name) AS label, c_acctbal * 2 + 1 AS scaled FROM customer""",
)
def c3(spark, root):
    customers = table(spark, root, "customer")
    banded = add_column(customers, "band", "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END")
    labelled = add_column(banded, "label", "concat(c_mktsegment, '/', c_name)")
    return add_column(labelled, "scaled", F.col("c_acctbal") * 2 + 1).select("c_custkey", "band", "label", "scaled")


@query(
    "c4_group_values",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'visit' WHEN 'view' THEN 'visit' WHEN 'signup' THEN 'account'
              ELSE event_type END AS event_type FROM events""",
)
def c4(spark, root):
    mapping = {"click": "visit", "view": "visit", "signup": "account"}
    return group_values(table(spark, root, "events").select("event_id", "event_type"), "event_type", mapping)


@query(
    "c4_group_values_table",
    """SELECT l.l_orderkey, l.l_linenumber, coalesce(m.brand, CAST(l.l_partkey AS VARCHAR)) AS part
       FROM lineitem l LEFT JOIN (SELECT p_partkey, p_brand AS brand FROM part WHERE p_size > 10) m ON l.l_partkey = m.p_partkey""",
)
def c4_table(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    mapping = table(spark, root, "part").select(text_where("p_size > 10", "CAST(p_partkey AS STRING)").alias("part"), "p_brand")
    return group_values(lines, "part", mapping)


_TYPED = """CASE c_custkey % 20 WHEN 1 THEN concat(substr(c_mktsegment, 1, 2), substr(c_mktsegment, 4))
                                 WHEN 2 THEN concat(substr(c_mktsegment, 1, 4), 'X', substr(c_mktsegment, 6))
                                 WHEN 3 THEN lower(c_mktsegment) ELSE c_mktsegment END"""


@query(
    "c4_similar_values",
    f"""WITH RECURSIVE typed AS (SELECT {_TYPED} AS v, count(*) AS n FROM customer GROUP BY 1),
            linked AS (SELECT DISTINCT a.v AS a, b.v AS b FROM typed a JOIN typed b ON levenshtein(lower(a.v), lower(b.v)) <= 1),
            reached AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a)
       SELECT a AS spelling, max_by(t.v, n) AS value FROM reached JOIN typed t ON t.v = b GROUP BY a HAVING count(*) > 1""",
)
def c4_similar(spark, root):
    typed = table(spark, root, "customer").select(F.expr(_TYPED).alias("segment"))
    return similar_values(typed, "segment")


@query(
    "c4_group_similar",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Robert' WHEN s_suppkey % 3 = 1 THEN 'Robert' ELSE 'Ashcraft' END AS contact FROM supplier",
)
def c4_group(spark, root):
    # the most frequent of each sound stands, as two thirds of each are spelled so
    name = "CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 9 = 0 THEN 'Rupert' ELSE 'Robert' END WHEN 1 THEN 'Robert' ELSE CASE WHEN s_suppkey % 9 = 2 THEN 'Ashcroft' ELSE 'Ashcraft' END END"
    return group_similar(table(spark, root, "supplier").select("s_suppkey", F.expr(name).alias("contact")), "contact", by="pronunciation")


@query(
    "c5_split_column",
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS priority_1,
              split_part(o_orderpriority, '-', 2) AS priority_2, CAST(NULL AS VARCHAR) AS priority_3 FROM orders""",
)
def c5(spark, root):
    orders = table(spark, root, "orders")
    return split_column(orders, "o_orderpriority", "-", 3, "priority").select("o_orderkey", "priority_1", "priority_2", "priority_3")


@query("c6_trim_whitespace", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def c6(spark, root):
    padded = table(spark, root, "customer").select("c_custkey", F.concat(F.lit("  \t"), "c_mktsegment", F.lit(" ")).alias("segment"))
    return trim_whitespace(padded, "segment")


@query(
    "c7_fix_case",
    """SELECT p_partkey, upper(p_name) AS upper_name, lower(p_brand) AS lower_brand,
              array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title_name
       FROM part""",
)
def c7(spark, root):
    parts = table(spark, root, "part").select(
        "p_partkey", F.col("p_name").alias("upper_name"), F.col("p_brand").alias("lower_brand"), F.col("p_name").alias("title_name")
    )
    return fix_case(fix_case(fix_case(parts, "upper_name", "upper"), "lower_brand", "lower"), "title_name", "title")


@query(
    "c8_replace_value",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus,
              replace(o_orderpriority, 'NOT ', 'un') AS o_orderpriority FROM orders""",
)
def c8(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    exact = replace_value(orders, "o_orderstatus", "F", "filled")
    return replace_value(exact, "o_orderpriority", "NOT ", "un", exact=False)


def _order_actions():
    """Renames and a cast that belong to staging, then a fixed maximum, a filter and a row
    number that belong to the intermediate layer."""
    return [
        action(rename, [("o_custkey", "customer"), ("o_totalprice", "price")]),
        action(cast, {"o_orderdate": "date"}),
        action(fixed, "customer", "max", "price", "top_price"),
        action(filter_rows, "price * 2 >= top_price"),
        action(row_number, "customer", ["o_orderdate", "o_orderkey"], "n"),
    ]


_CLEAN_SQL = """
    SELECT o_orderkey, customer, price, o_orderdate, top_price,
           row_number() OVER (PARTITION BY customer ORDER BY o_orderdate, o_orderkey) AS n
    FROM (SELECT o_orderkey, o_custkey AS customer, o_totalprice AS price, CAST(o_orderdate AS DATE) AS o_orderdate,
                 max(o_totalprice) OVER (PARTITION BY o_custkey) AS top_price FROM orders)
    WHERE price * 2 >= top_price"""


@query("c9_clean", _CLEAN_SQL)
def c9(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return clean(orders, _order_actions())


@query("c10_clean_slices", _CLEAN_SQL)
def c10(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    actions = _order_actions()
    staged = clean(orders, actions, indices=[1, 0])
    return clean(staged, actions, indices=[2, 3, 4])


@query("c11_add_row_unit", 'SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus')
def c11(spark, root):
    counted = add_row_unit(table(spark, root, "orders"))
    return counted.groupBy("o_orderstatus").agg(F.sum("`Number of Rows`").alias("n"))
