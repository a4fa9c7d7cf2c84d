"""Joins, aggregates, windows, unions, reshaping and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.operators.aggregates import aggregate, classify_max, recompute_check, rollup_grain
from layerflow.operators.clean import action, clean, filter_rows
from layerflow.operators.columns import hide, rename
from layerflow.operators.joins import (
    checked_join,
    exists_in,
    fill_from_lookup,
    join,
    join_cardinality,
    lookup_chain,
    match_with_fallback,
    missing_from,
    resolve_names,
    self_join,
)
from layerflow.operators.reshape import add_missing_rows, fill_dates, fill_sequence, pivot, unpivot
from layerflow.operators.script import script, script_by
from layerflow.operators.unions import self_union, union_mapped
from layerflow.operators.windows import accumulate, fixed, renumber, row_number
from layerflow.plans.catalog.registry import as_double, exact, number_where, query, table, text_where


@query(
    "d1_join",
    """SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer
       LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey""",
)
def d1(spark, root):
    customers = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    key = number_where("o_orderstatus = 'P'", "o_custkey").alias("o_custkey")
    orders = table(spark, root, "orders").select(key, "o_orderkey", "o_totalprice")
    return join(customers, orders, [("c_custkey", "o_custkey")], "left").drop("o_custkey")


@query(
    "d1_join_full",
    """SELECT coalesce(a.k, b.k) AS k, a.name AS name, b.name AS "name-1"
       FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -1 - c_custkey END AS k, c_name AS name FROM customer) a
       FULL JOIN (SELECT s_suppkey AS k, s_name AS name FROM supplier) b ON a.k = b.k""",
)
def d1_full(spark, root):
    customers = table(spark, root, "customer").select(number_where("c_acctbal > 0", "c_custkey").alias("k"), F.col("c_name").alias("name"))
    suppliers = table(spark, root, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return join(customers, suppliers, "k", "full")


@query(
    "d2_self_join",
    """SELECT a.conv_id AS conv_id_l, a.turn AS turn_l, a.role AS role_l, b.role AS role_r, length(b.text) AS reply_chars
       FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""",
)
def d2(spark, root):
    turns = table(spark, root, "conversations").withColumn("next_turn", F.col("turn") + 1)
    pairs = self_join(turns, ["conv_id", ("next_turn", "turn")], ("_l", "_r"))
    return pairs.select("conv_id_l", "turn_l", "role_l", "role_r", F.length("text_r").cast("bigint").alias("reply_chars"))


@query(
    "d3_join_cardinality",
    """SELECT l.m AS max_left, r.m AS max_right,
              concat(CASE WHEN l.m = 1 THEN '1' ELSE 'N' END, ':', CASE WHEN r.m = 1 THEN '1' ELSE 'N' END) AS cardinality
       FROM (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey)) l,
            (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)) r""",
)
def d3(spark, root):
    return join_cardinality(table(spark, root, "lineitem"), table(spark, root, "orders"), [("l_orderkey", "o_orderkey")])


@query(
    "d4_checked_join_violations",
    """SELECT 'left' AS side, l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
       WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
       UNION ALL
       SELECT 'right', l_orderkey, l_linenumber, count(*) FROM lineitem WHERE l_returnflag = 'R'
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def d4(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber")
    returned = table(spark, root, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    _, violations = checked_join(lines, returned, ["l_orderkey", "l_linenumber"], "left", "1:1")
    return violations


@query(
    "d4_checked_join",
    "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def d4_rows(spark, root):
    orders, customers = table(spark, root, "orders"), table(spark, root, "customer")
    joined, _ = checked_join(orders, customers, [("o_custkey", "c_custkey")], "inner", "N:1")
    return joined.select("o_orderkey", "c_mktsegment")


@query("d5_exists_in", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def d5(spark, root):
    returned = table(spark, root, "lineitem").where("l_returnflag = 'R'")
    return exists_in(table(spark, root, "orders").select("o_orderkey", "o_orderstatus"), returned, [("o_orderkey", "l_orderkey")])


@query("d5_missing_from", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def d5_missing(spark, root):
    returned = table(spark, root, "lineitem").where("l_returnflag = 'R'")
    return missing_from(table(spark, root, "orders").select("o_orderkey", "o_orderstatus"), returned, [("o_orderkey", "l_orderkey")])


@query(
    "d6_match_with_fallback",
    """WITH l AS (SELECT c_custkey AS ref, CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS VARCHAR) WHEN c_acctbal < -500 THEN NULL ELSE 'none' END AS luid,
                         'NATION_' || CAST(c_nationkey AS VARCHAR) AS name FROM customer),
            r AS (SELECT CAST(n_nationkey AS VARCHAR) AS luid, 'NATION_' || CAST(n_nationkey AS VARCHAR) AS name, n_name FROM nation)
       SELECT l.ref, CASE WHEN r.n_name IS NULL THEN NULL WHEN l.luid IS NOT NULL THEN 'luid' ELSE 'name' END AS matched_by, r.n_name AS match_n_name
       FROM l LEFT JOIN r ON l.luid = r.luid OR (l.luid IS NULL AND l.name = r.name)""",
)
def d6(spark, root):
    key = F.expr("CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS STRING) WHEN c_acctbal < -500 THEN NULL ELSE 'none' END")
    left = table(spark, root, "customer").select(
        F.col("c_custkey").alias("ref"), key.alias("luid"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name")
    )
    right = table(spark, root, "nation").select(
        F.col("n_nationkey").cast("string").alias("luid"), F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("name"), "n_name"
    )
    return match_with_fallback(left, right, "luid", "name").select("ref", "matched_by", "match_n_name")


_NAMES = "SELECT DISTINCT p_name AS name FROM part UNION SELECT p_brand FROM part"


@query(
    "d7_resolve_names",
    f"""WITH names AS ({_NAMES}), catalog AS (SELECT p_name AS name, p_partkey AS id FROM part WHERE p_size > 40)
        SELECT n.name, c.id, (SELECT count(*) FROM catalog x WHERE x.name = n.name) AS n_matches
        FROM names n LEFT JOIN catalog c ON n.name = c.name""",
)
def d7(spark, root):
    parts = table(spark, root, "part")
    names = parts.select(F.col("p_name").alias("name")).union(parts.select("p_brand")).distinct()
    catalog = parts.select(text_where("p_size > 40", "p_name").alias("name"), F.col("p_partkey").alias("id"))
    return resolve_names(names, catalog)


@query(
    "d7_resolve_names_ambiguous",
    f"""WITH names AS ({_NAMES}), catalog AS (SELECT p_name AS name FROM part WHERE p_size > 40)
        SELECT n.name, count(*) AS n_matches FROM names n JOIN catalog c ON n.name = c.name GROUP BY n.name HAVING count(*) > 1""",
)
def d7_strict(spark, root):
    parts = table(spark, root, "part")
    names = parts.select(F.col("p_name").alias("name")).union(parts.select("p_brand")).distinct()
    catalog = parts.select(text_where("p_size > 40", "p_name").alias("name"))
    return resolve_names(names, catalog, strict=True)[1]


@query(
    "d8_fill_from_lookup",
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), c_mktsegment) AS status
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def d8(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    lookup = table(spark, root, "customer").select(
        number_where("c_acctbal > 0", "c_custkey").alias("c_custkey"), F.col("c_mktsegment").alias("status")
    )
    return fill_from_lookup(orders, lookup, [("o_custkey", "c_custkey")], "status").drop("o_custkey")


@query(
    "d9_lookup_chain",
    """WITH wrapper AS (SELECT c_custkey AS wkey, CASE WHEN c_acctbal > 9000 THEN -1 ELSE c_nationkey END AS wbase FROM customer WHERE c_mktsegment <> 'BUILDING'),
            base AS (SELECT CAST(n_nationkey AS BIGINT) AS bkey, n_name FROM nation)
       SELECT o.o_orderkey, b.n_name, CASE WHEN b.bkey IS NULL THEN NULL WHEN w.wkey IS NOT NULL THEN 'wrapped' ELSE 'direct' END AS via, b.bkey
       FROM orders o LEFT JOIN wrapper w ON o.o_custkey = w.wkey
       LEFT JOIN base b ON b.bkey = CASE WHEN w.wkey IS NOT NULL THEN w.wbase ELSE o.o_custkey END""",
)
def d9(spark, root):
    wrapper = table(spark, root, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("wkey"), F.expr("CASE WHEN c_acctbal > 9000 THEN -1L ELSE CAST(c_nationkey AS BIGINT) END").alias("wbase")
    )
    base = table(spark, root, "nation").select(F.col("n_nationkey").cast("bigint").alias("bkey"), "n_name")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    chased = lookup_chain(orders, wrapper, base, "o_custkey", "wkey", "wbase", "bkey")
    return chased.drop("o_custkey")


@query(
    "e1_aggregate",
    """SELECT l_returnflag, l_linestatus, count(*) AS n_lines, sum(l_quantity) AS quantity, min(l_extendedprice) AS least,
              max(l_extendedprice) AS most, avg(l_quantity) AS avg_quantity,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS price
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def e1(spark, root):
    grouped = aggregate(
        table(spark, root, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "n_lines": ("count", F.lit(1)),
            "quantity": ("sum", "l_quantity"),
            "least": ("min", "l_extendedprice"),
            "most": ("max", "l_extendedprice"),
            "avg_quantity": ("avg", "l_quantity"),
            "price": ("sum", exact("l_extendedprice")),
        },
    )
    return as_double(grouped, "price")


@query(
    "e2_rollup_grain",
    """SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n_orders
       FROM orders GROUP BY 1, 2""",
)
def e2(spark, root):
    measures = {"revenue": ("sum", exact("o_totalprice")), "n_orders": ("count", F.lit(1))}
    return as_double(rollup_grain(table(spark, root, "orders"), "o_orderdate", "month", "o_orderstatus", measures), "revenue")


@query(
    "e2_rollup_hourly",
    """SELECT event_type, date_trunc('hour', ts) AS period, count(*) AS n_events FROM events GROUP BY 1, 2""",
)
def e2_hourly(spark, root):
    return rollup_grain(table(spark, root, "events"), "ts", "hour", "event_type", {"n_events": ("count", F.lit(1))})


@query(
    "e2_rollup_weekly",
    """SELECT CAST(date_trunc('week', ts) AS DATE) AS period, count(*) AS n_events FROM events GROUP BY 1""",
)
def e2_weekly(spark, root):
    return rollup_grain(table(spark, root, "events"), "ts", "week", [], {"n_events": ("count", F.lit(1))})


@query(
    "e3_non_additive",
    """SELECT c_mktsegment, count(DISTINCT o_custkey) AS customers, median(o_totalprice) AS typical
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def e3(spark, root):
    joined = join(table(spark, root, "orders"), table(spark, root, "customer"), [("o_custkey", "c_custkey")], "inner")
    return aggregate(joined, "c_mktsegment", {"customers": ("countd", "o_custkey"), "typical": ("median", "o_totalprice")})


@query(
    "e4_recompute_check",
    """WITH stored AS (SELECT o_orderstatus, o_orderpriority, count(*) + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS n,
                              sum(CAST(o_custkey AS BIGINT)) AS keys FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY 1, 2)
       SELECT o.o_orderstatus, o.o_orderpriority, CASE WHEN s.n IS NULL THEN 'only_b' ELSE 'differs' END AS status,
              CASE WHEN s.n IS NULL THEN '' ELSE 'n' END AS columns
       FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) o
       LEFT JOIN stored s ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = s.o_orderpriority
       WHERE s.n IS NULL OR s.n <> o.n""",
)
def e4(spark, root):
    orders = table(spark, root, "orders")
    by, measures = ["o_orderstatus", "o_orderpriority"], {"n": ("count", F.lit(1)), "keys": ("sum", "o_custkey")}
    stored = aggregate(orders.where("o_orderpriority <> '2-HIGH'"), by, measures).withColumn(
        "n", F.col("n") + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)
    )
    return recompute_check(stored, orders, by, measures).withColumn("columns", F.array_join("columns", ","))


@query(
    "e5_classify_max",
    """WITH rules AS (SELECT DISTINCT o_orderpriority AS p, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rank,
                             'class ' || substr(o_orderpriority, 1, 1) AS class FROM orders WHERE o_orderpriority <> '3-MEDIUM')
       SELECT o_custkey, max(rank) AS rank, 'class ' || CAST(max(rank) AS VARCHAR) AS class
       FROM orders LEFT JOIN rules ON o_orderpriority = p GROUP BY o_custkey""",
)
def e5(spark, root):
    orders = table(spark, root, "orders")
    level = F.substring("o_orderpriority", 1, 1)
    rules = orders.where("o_orderpriority <> '3-MEDIUM'").select(
        F.col("o_orderpriority").alias("p"), level.cast("bigint").alias("rank"), F.concat(F.lit("class "), level).alias("class")
    ).distinct()
    return classify_max(orders, rules, [("o_orderpriority", "p")], "o_custkey")


@query("f1_fixed", "SELECT o_orderkey, o_custkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top_price FROM orders")
def f1(spark, root):
    return fixed(table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "max", "o_totalprice", "top_price").drop("o_totalprice")


@query("f2_row_number", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS path FROM events")
def f2(spark, root):
    return row_number(table(spark, root, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "path").drop("ts")


@query(
    "f3_renumber",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY path) AS path
       FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS path FROM events)
       WHERE event_type <> 'error'""",
)
def f3(spark, root):
    numbered = row_number(table(spark, root, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "path")
    return renumber(filter_rows(numbered, "event_type <> 'error'"), "user_id", "path", "path").drop("ts", "event_type")


@query(
    "g1_union_mapped",
    """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment, CAST(NULL AS DOUBLE) AS s_acctbal, 'customers' AS "Table Names" FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, s_acctbal, 'suppliers' FROM supplier""",
)
def g1(spark, root):
    return union_mapped(
        {"customers": hide(table(spark, root, "customer"), "c_acctbal"), "suppliers": table(spark, root, "supplier")},
        {
            "customers": {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation"},
            "suppliers": {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation"},
        },
    )


@query(
    "g2_self_union",
    """SELECT o_orderkey, o_totalprice AS amount, 'open' AS "Table Names" FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT o_orderkey, -o_totalprice, 'filled' FROM orders WHERE o_orderstatus = 'F'""",
)
def g2(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    named = action(rename, [("o_totalprice", "amount")])
    return self_union(
        orders,
        lambda df: clean(df, [action(filter_rows, "o_orderstatus = 'O'"), named, action(hide, "o_orderstatus")]),
        lambda df: clean(
            df,
            [action(filter_rows, "o_orderstatus = 'F'"), named, action(hide, "o_orderstatus"),
             lambda d: d.withColumn("amount", -F.col("amount"))],
        ),
        ("open", "filled"),
    )


@query(
    "h1_pivot",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
              count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def h1(spark, root):
    return pivot(table(spark, root, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], {"n": ("count", F.lit(1))})


@query(
    "h2_unpivot",
    """SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, nullif(l_discount, 0) AS amount FROM lineitem
       UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def h2(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax")
    return unpivot(lines, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "measure", "amount")


_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2"
_CALENDAR = f"""daily AS ({_DAILY}), ends AS (SELECT user_id, min(day) AS a, max(day) AS b FROM daily GROUP BY user_id),
    grid AS (SELECT user_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM ends)"""


def _daily(spark, root):
    return table(spark, root, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("h3_fill_dates", f"WITH {_CALENDAR} SELECT g.user_id, g.day, d.n FROM grid g LEFT JOIN daily d ON g.user_id = d.user_id AND g.day = d.day")
def h3(spark, root):
    return fill_dates(_daily(spark, root), "user_id", "day", "day")


@query(
    "h3_fill_dates_carry",
    f"""WITH {_CALENDAR} SELECT g.user_id, g.day, last_value(d.n IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day) AS n
        FROM grid g LEFT JOIN daily d ON g.user_id = d.user_id AND g.day = d.day""",
)
def h3_carry(spark, root):
    return fill_dates(_daily(spark, root), "user_id", "day", "day", fill="carry")


@query(
    "h4_fill_sequence",
    """WITH lines AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
            grid AS (SELECT l_orderkey, unnest(generate_series(1, 7)) AS l_linenumber FROM (SELECT DISTINCT l_orderkey FROM lineitem))
       SELECT g.l_orderkey, CAST(g.l_linenumber AS INTEGER) AS l_linenumber, l.quantity FROM grid g
       LEFT JOIN lines l ON g.l_orderkey = l.l_orderkey AND g.l_linenumber = l.l_linenumber""",
)
def h4(spark, root):
    lines = aggregate(table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity": ("sum", "l_quantity")})
    return fill_sequence(lines, "l_orderkey", "l_linenumber", 1, lo=1, hi=7)


_COUNTS = "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"


@query(
    "h5_add_missing_rows",
    f"""WITH have AS ({_COUNTS}) SELECT c.o_custkey, p.o_orderpriority, h.n FROM (SELECT DISTINCT o_custkey FROM orders) c
        CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
        LEFT JOIN have h ON h.o_custkey = c.o_custkey AND h.o_orderpriority = p.o_orderpriority""",
)
def h5(spark, root):
    orders = table(spark, root, "orders")
    counts = aggregate(orders, ["o_custkey", "o_orderpriority"], {"n": ("count", F.lit(1))})
    return add_missing_rows(counts, "o_custkey", "o_orderpriority", orders.select("o_orderpriority"))


def _net(rows):
    rows = rows.copy()
    rows["net"] = rows["l_extendedprice"] * (1 - rows["l_discount"])
    return rows[["l_orderkey", "l_linenumber", "net"]]


@query("i1_script", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def i1(spark, root):
    return script(
        table(spark, root, "lineitem"), _net, "l_orderkey BIGINT, l_linenumber INT, net DOUBLE",
        ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"],
    )


def _extent(rows):
    return rows.groupby("user_id", as_index=False, dropna=False).agg(n=("event_id", "size"), least=("value", "min"), most=("value", "max"))


def _merge_extents(rows):
    return rows.groupby("user_id", as_index=False, dropna=False).agg(n=("n", "sum"), least=("least", "min"), most=("most", "max"))


@query("i2_script_by", "SELECT user_id, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY user_id")
def i2(spark, root):
    events = table(spark, root, "events").select("user_id", "event_id", "value")
    return script_by(events, "user_id", _extent, _merge_extents, "user_id BIGINT, n BIGINT, least DOUBLE, most DOUBLE")


@query(
    "i2_script_by_null_group",
    """SELECT CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id, count(*) AS n, min(value) AS least, max(value) AS most
       FROM events GROUP BY 1""",
)
def i2_null_group(spark, root):
    user = F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE user_id END").alias("user_id")
    events = table(spark, root, "events").select(user, "event_id", "value")
    return script_by(events, "user_id", _extent, _merge_extents, "user_id BIGINT, n BIGINT, least DOUBLE, most DOUBLE")


@query(
    "f2_running_sum_nulls",
    """SELECT event_id, sum(CASE WHEN event_type = 'view' THEN NULL ELSE CAST(value AS DECIMAL(18,4)) END)
         OVER (PARTITION BY event_type, user_id % 7 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM events""",
)
def f2_running_sum(spark, root):
    events = table(spark, root, "events").selectExpr(
        "event_id", "ts", "event_type", "user_id % 7 AS part",
        "CASE WHEN event_type = 'view' THEN NULL ELSE CAST(value AS DECIMAL(18,4)) END AS amount",
    )
    summed = accumulate(events, ["event_type", "part"], ["ts", "event_id"], "running", "amount")
    return summed.select("event_id", F.col("running").cast("double").alias("running"))


@query(
    "h3_fill_seconds",
    """WITH e AS (SELECT DISTINCT CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE 'other' END AS kind,
              date_trunc('second', ts) + CASE WHEN event_type = 'click' THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS moment FROM events),
            r AS (SELECT kind, unnest(generate_series(min(moment), max(moment), INTERVAL 1 SECOND)) AS moment FROM e GROUP BY kind)
       SELECT kind, count(*) AS n, min(moment) AS first, max(moment) AS last FROM r GROUP BY kind""",
)
def h3_seconds(spark, root):
    """Every second between the first and the last event of two kinds."""
    kind = F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE 'other' END").alias("kind")
    moment = F.expr("date_trunc('second', ts) + CASE WHEN event_type = 'click' THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END")
    events = table(spark, root, "events").select(kind, moment.cast("timestamp_ntz").alias("moment")).distinct()
    filled = fill_dates(events, "kind", "moment", "second")
    return aggregate(filled, "kind", {"n": ("count", "moment"), "first": ("min", "moment"), "last": ("max", "moment")})
