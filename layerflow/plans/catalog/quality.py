"""Parity and expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.operators import expectations as ex
from layerflow.operators.digests import digest_diff, publish_digested
from layerflow.operators.joins import attach
from layerflow.operators.parity import column_diff, count_diff, resolve_pairs, value_diff
from layerflow.operators.reshape import unpivot
from layerflow.operators.sketches import DISTINCT_ERROR, column_profile, merge_profiles, profile_diff, read_profile
from layerflow.plans import models
from layerflow.plans.catalog.registry import number_where, query, table
from layerflow.session import cut, scratch_path


def _profile_sql(column: str, type_a: str | None, type_b: str | None, a: str, b: str) -> str:
    def side(kind: str | None, source: str, s: str) -> str:
        if kind is None:
            return f"""false AS in_{s}, NULL AS type_{s}, CAST(NULL AS BIGINT) AS nulls_{s}, CAST(NULL AS BIGINT) AS distinct_{s},
                       CAST(NULL AS VARCHAR) AS min_{s}, CAST(NULL AS VARCHAR) AS max_{s}"""
        stats = {"nulls": f"count(*) FILTER ({column} IS NULL)", "distinct": f"count(DISTINCT {column})",
                 "min": f"CAST(min({column}) AS VARCHAR)", "max": f"CAST(max({column}) AS VARCHAR)"}
        picks = ", ".join(f"(SELECT {e} FROM {source}) AS {n}_{s}" for n, e in stats.items())
        return f"true AS in_{s}, '{kind}' AS type_{s}, {picks}"

    return f"SELECT '{column}' AS \"column\", {side(type_a, a, 'a')}, {side(type_b, b, 'b')}"


_SIDE_A = "(SELECT p_partkey, p_name, p_size FROM part)"
_SIDE_B = "(SELECT p_partkey, nullif(p_name, 'red widget') AS p_name, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part)"


@query(
    "l1_column_diff",
    "SELECT *, in_a AND in_b AND type_a = type_b AND nulls_a = nulls_b AND distinct_a = distinct_b AND min_a = min_b AND max_a = max_b AS same FROM ("
    + " UNION ALL ".join(
        _profile_sql(c, a, b, _SIDE_A, _SIDE_B)
        for c, a, b in (
            ("p_partkey", "bigint", "bigint"),
            ("p_name", "string", "string"),
            ("p_size", "int", "bigint"),
            ("p_brand", None, "string"),
        )
    )
    + ")",
)
def l1(spark, root):
    parts = table(spark, root, "part")
    changed = parts.select(
        "p_partkey", F.nullif("p_name", F.lit("red widget")).alias("p_name"), F.col("p_size").cast("bigint").alias("p_size"), "p_brand"
    )
    diff = column_diff(parts.select("p_partkey", "p_name", "p_size"), changed)
    return diff.withColumn("same", F.coalesce("same", F.lit(False)))


@query(
    "l2_count_diff",
    """SELECT o_orderpriority, count(*) AS rows_a, count(*) FILTER (o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') AS rows_b,
              count(*) FILTER (o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') - count(*) AS difference
       FROM orders GROUP BY o_orderpriority""",
)
def l2(spark, root):
    orders = table(spark, root, "orders")
    return count_diff(orders, orders.where("o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'"), "o_orderpriority")


@query(
    "l2_count_diff_total",
    "SELECT (SELECT count(*) FROM lineitem) AS rows_a, (SELECT count(*) FROM orders) AS rows_b, (SELECT count(*) FROM orders) - (SELECT count(*) FROM lineitem) AS difference",
)
def l2_total(spark, root):
    return count_diff(table(spark, root, "lineitem"), table(spark, root, "orders"))


def _sketch_sql(column):
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS \"rows\", count(*) - count({column}) AS nulls, CAST(min({column}) AS VARCHAR) AS min,"
        f" CAST(max({column}) AS VARCHAR) AS max, true AS distinct_near FROM orders"
    )


@query("l1_profile_sketch", " UNION ALL ".join(_sketch_sql(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def l1_sketch(spark, root):
    """Profiles of four parts, stored, merged and read; estimates must be near the exact numbers."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    stored = [cut(column_profile(orders.where(F.col("o_orderkey") % 4 == k))) for k in range(4)]
    read = read_profile(merge_profiles(*stored))
    exact = orders.agg(*[F.countDistinct(c).alias(c) for c in orders.columns])
    counted = unpivot(exact, [], orders.columns, "column", "exact")
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * DISTINCT_ERROR * F.col("exact"))
    return attach(read, counted, "column", unique=True).select("column", "rows", "nulls", "min", "max", near.alias("distinct_near"))


@query(
    "l1_profile_diff",
    """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice']) AS "column", unnest([true, false, false, false]) AS same,
              unnest([true, true, true, false]) AS in_a, unnest([true, true, true, true]) AS in_b""",
)
def l1_profiles(spark, root):
    orders = table(spark, root, "orders")
    old = cut(column_profile(orders.select("o_orderkey", "o_custkey", "o_orderstatus")))
    changed = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.lower("o_orderstatus").alias("o_orderstatus"), "o_totalprice")
    return profile_diff(old, cut(column_profile(changed))).select("column", "same", "in_a", "in_b")


@query(
    "l3_digest_diff",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'only_a' ELSE 'differs' END AS status,
              CASE WHEN o_orderkey % 1000 = 7 THEN '' ELSE 'o_totalprice' END AS columns FROM orders WHERE o_orderkey % 1000 IN (7, 8)""",
)
def l3_digests(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    changed = orders.where("o_orderkey % 1000 <> 7").withColumn("o_totalprice", F.expr("o_totalprice + if(o_orderkey % 1000 = 8, 1D, 0D)"))
    old, new = scratch_path(spark, "l3-old"), scratch_path(spark, "l3-new")
    publish_digested(orders, old, "o_orderkey", leaves=64)
    publish_digested(changed, new, "o_orderkey", leaves=64)
    return digest_diff(spark, old, new, "o_orderkey").withColumn("columns", F.array_join("columns", ","))


@query(
    "l3_value_diff",
    """WITH a AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
            b AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM (SELECT l_partkey, CASE WHEN l_quantity = 50 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem) GROUP BY 1, 2)
       SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag,
              coalesce(a.n, 0) AS copies_a, coalesce(b.n, 0) AS copies_b
       FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def l3(spark, root):
    lines = table(spark, root, "lineitem")
    changed = lines.select("l_partkey", F.expr("CASE WHEN l_quantity = 50 THEN 'X' ELSE l_returnflag END").alias("l_returnflag"))
    return value_diff(lines.select("l_partkey", "l_returnflag"), changed)


@query(
    "l3_value_diff_keyed",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'only_a' ELSE 'differs' END AS status,
              CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderpriority = '5-LOW' AND o_totalprice > 250000 THEN 'o_orderpriority,o_totalprice'
                   WHEN o_orderpriority = '5-LOW' THEN 'o_orderpriority' ELSE 'o_totalprice' END AS columns
       FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice > 250000""",
)
def l3_keyed(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    changed = (
        orders.where("o_orderstatus <> 'P'")
        .withColumn("o_orderpriority", F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END"))
        .withColumn("o_totalprice", F.expr("CASE WHEN o_totalprice > 250000 THEN o_totalprice + 1 ELSE o_totalprice + 0.001D END"))
    )
    return value_diff(orders, changed, key="o_orderkey", tol=0.01).withColumn("columns", F.array_join("columns", ","))


@query(
    "l3_layers_equal_flat",
    """SELECT DISTINCT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, 'differs' AS status, 'n_lines' AS columns
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) = 3""",
)
def l3_layers(spark, root):
    """The layered model against one flat query that counts one line more in every March: the
    other months are equal."""
    layered = models.revenue_by_segment_monthly(spark, root)
    lines, orders, customers = (table(spark, root, t) for t in ("lineitem", "orders", "customer"))
    flat = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"))
        .agg(
            F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        .withColumn("n_lines", F.col("n_lines") + (F.month("period") == 3).cast("bigint"))
    )
    return value_diff(layered, flat, key=["c_mktsegment", "period"]).withColumn("columns", F.array_join("columns", ","))


@query(
    "l4_resolve_pairs",
    """WITH o AS (SELECT n_name AS name FROM nation), s AS (SELECT CASE WHEN s_acctbal < 0 THEN NULL WHEN n_regionkey = 0 THEN 'unknown' ELSE 'x' END AS kind, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
            claims AS (SELECT CASE WHEN kind = 'unknown' THEN 'gone' ELSE n_name END AS original, s_name AS successor FROM s WHERE kind IS NOT NULL)
       SELECT c.original, c.successor, CASE WHEN o.name IS NULL THEN 'unknown_original' ELSE 'paired' END AS status FROM claims c LEFT JOIN o ON c.original = o.name
       UNION ALL SELECT name, NULL, 'no_successor' FROM o WHERE name NOT IN (SELECT original FROM claims)""",
)
def l4(spark, root):
    nations = table(spark, root, "nation")
    declared = F.expr("CASE WHEN s_acctbal < 0 THEN NULL WHEN n_regionkey = 0 THEN 'gone' ELSE n_name END")
    successors = (
        table(spark, root, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", declared.alias("declared"))
    )
    return resolve_pairs(nations.select(F.col("n_name").alias("name")), successors, "name", "declared", "s_name")


@query("l5_expect_required", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def l5(spark, root):
    orders = table(spark, root, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END").alias("priority"),
    )
    return ex.expect_required(orders, ["status", "priority"])


@query("l6_expect_in", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def l6(spark, root):
    return ex.expect_in(table(spark, root, "events").select("event_id", "event_type"), "event_type", ["click", "view", "purchase"])


@query("l7_expect_unique", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def l7(spark, root):
    return ex.expect_unique(table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("l8_expect_when", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_returnflag = 'R' AND NOT coalesce(nullif(l_tax, 0) > 0.02, false)")
def l8(spark, root):
    found = ex.expect_when(table(spark, root, "lineitem"), "l_returnflag = 'R'", "nullif(l_tax, 0) > 0.02D")
    return found.select("l_orderkey", "l_linenumber", "l_tax")


@query("l9_expect_ref", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS customer FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def l9(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END").alias("customer"))
    customers = table(spark, root, "customer").select(number_where("c_acctbal > 0", "c_custkey").alias("c_custkey"))
    return ex.expect_ref(orders, "customer", customers, "c_custkey")


@query("l10_expect_range", "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size >= 45")
def l10(spark, root):
    return ex.expect_range(table(spark, root, "part").select("p_partkey", "p_size"), "p_size", 5, 45)


@query("l11_expect_disjoint", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def l11(spark, root):
    orders = table(spark, root, "orders")
    return ex.expect_disjoint(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "o_custkey")


@query("l12_expect_count", "SELECT CAST(25 AS BIGINT) AS expected, count(*) AS found FROM supplier HAVING count(*) <> 25")
def l12(spark, root):
    return ex.expect_count(table(spark, root, "supplier"), 25)


_NAMES = """SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'stg_shop__' || replace(p_name, ' ', '_') WHEN p_size <= 20 THEN 'stg_' || replace(p_name, ' ', '_')
            WHEN p_size <= 30 THEN 'int_' || replace(p_name, ' ', '-') WHEN p_size <= 40 THEN 'FCT_' || upper(replace(p_name, ' ', '_')) ELSE 'fct_' || replace(p_name, ' ', '_') || '_v2' END AS name FROM part"""


@query(
    "l13_expect_pattern",
    f"""WITH n AS ({_NAMES})
        SELECT p_partkey, name, 'prefix' AS rule FROM n WHERE NOT regexp_matches(name, '^(stg|int|fct|dim|rpt|agg|_scratch|_deprecated)_')
        UNION ALL SELECT p_partkey, name, 'snake_case' FROM n WHERE NOT regexp_matches(name, '^_?[a-z][a-z0-9_]*$')
        UNION ALL SELECT p_partkey, name, 'staging_source' FROM n WHERE name LIKE 'stg\\_%' ESCAPE '\\' AND NOT regexp_matches(name, '^stg_[a-z0-9]+(_[a-z0-9]+)*__[a-z0-9]+(_[a-z0-9]+)*$')
        UNION ALL SELECT p_partkey, name, 'no_version' FROM n WHERE regexp_matches(name, '_v[0-9]+$')""",
)
def l13(spark, root):
    name = F.expr(
        """CASE WHEN p_size <= 10 THEN 'stg_shop__' || replace(p_name, ' ', '_') WHEN p_size <= 20 THEN 'stg_' || replace(p_name, ' ', '_')
           WHEN p_size <= 30 THEN 'int_' || replace(p_name, ' ', '-') WHEN p_size <= 40 THEN 'FCT_' || upper(replace(p_name, ' ', '_'))
           ELSE 'fct_' || replace(p_name, ' ', '_') || '_v2' END"""
    )
    return ex.expect_pattern(table(spark, root, "part").select("p_partkey", name.alias("name")), "name")


@query(
    "l13_expect_padded_steps",
    """WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders),
            last AS (SELECT o_custkey, max(step) AS last FROM n GROUP BY o_custkey)
       SELECT o_orderkey, 'int_c' || o_custkey || '_step' || step || '_go' AS name FROM n JOIN last USING (o_custkey) WHERE last >= 10 AND step < 10""",
)
def l13_steps(spark, root):
    from layerflow.operators.windows import row_number

    numbered = row_number(table(spark, root, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", "step")
    names = numbered.select("o_orderkey", F.expr("concat('int_c', o_custkey, '_step', step, '_go')").alias("name"))
    return ex.expect_padded_steps(names, "name")


@query(
    "l14_run_expectations",
    """WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority, o_totalprice, o_custkey FROM orders)
       SELECT 'status_set' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'needs a value: status' AS message FROM o WHERE status IS NULL
       UNION ALL SELECT 'priority_known', CAST(o_orderkey AS VARCHAR), 'o_orderpriority is not an accepted value' FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
       UNION ALL SELECT 'price_range', CAST(o_orderkey AS VARCHAR), 'o_totalprice is out of range' FROM o WHERE o_totalprice < 5000 OR o_totalprice >= 450000
       UNION ALL SELECT 'filled_is_cheap', CAST(o_orderkey AS VARCHAR), 'when status = ''F'', must hold: o_totalprice < 400000' FROM o WHERE status = 'F' AND NOT (o_totalprice < 400000)
       UNION ALL SELECT 'one_per_customer', CAST(o_custkey AS VARCHAR), 'rows: ' || count(*) FROM o GROUP BY o_custkey HAVING count(*) > 1
       UNION ALL SELECT 'customer_known', CAST(o_orderkey AS VARCHAR), 'o_custkey not found: ' || o_custkey FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500)
       UNION ALL SELECT 'row_count', NULL, 'rows: ' || count(*) FROM o HAVING count(*) <> 1
       UNION ALL SELECT DISTINCT 'not_a_supplier', CAST(o_custkey AS VARCHAR), 'occurs on both sides' FROM o WHERE o_custkey IN (SELECT s_suppkey FROM supplier)
       UNION ALL SELECT 'priority_name', CAST(o_orderkey AS VARCHAR), 'o_orderpriority breaks digit_first: ' || o_orderpriority FROM o WHERE NOT regexp_matches(o_orderpriority, '^[0-3]-')
       UNION ALL SELECT 'padded_steps', CAST(o_orderkey AS VARCHAR), 'step needs a leading zero: c' || (o_orderkey % 5) || '_step' || (o_orderkey % 12) FROM o WHERE o_orderkey % 12 < 10""",
)
def l14(spark, root):
    orders = table(spark, root, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_orderpriority", "o_totalprice", "o_custkey",
        F.expr("concat('c', o_orderkey % 5, '_step', o_orderkey % 12)").alias("step"),
    )
    suppliers = table(spark, root, "supplier").select("s_suppkey")
    customers = table(spark, root, "customer").select(number_where("c_acctbal > -500", "c_custkey").alias("c_custkey"))
    rules = [
        ex.required("status_set", orders, "status"),
        ex.accepted("priority_known", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]),
        ex.within("price_range", "o_totalprice", 5000, 450000),
        ex.implied("filled_is_cheap", "status = 'F'", "o_totalprice < 400000"),
        ex.unique("one_per_customer", "o_custkey"),
        ex.refers("customer_known", "o_orderkey", "o_custkey", customers, "c_custkey"),
        ex.counted("row_count", 1),
        ex.disjoint("not_a_supplier", suppliers, [("o_custkey", "s_suppkey")]),
        ex.patterned("priority_name", "o_orderkey", "o_orderpriority", {"digit_first": "^[0-3]-"}),
        ex.padded("padded_steps", "o_orderkey", "step"),
    ]
    return ex.run_expectations(orders, "o_orderkey", rules)


@query(
    "l15_coverage",
    """WITH a AS (SELECT DISTINCT CASE WHEN o_totalprice > 300000 THEN o_custkey ELSE -1 - o_custkey END AS item, o_orderpriority AS grp FROM orders),
            n AS (SELECT item, count(*) AS n_groups FROM a GROUP BY item HAVING count(*) > 1)
       SELECT item, 'multiple' AS status, grp, n_groups FROM a JOIN n USING (item)
       UNION ALL SELECT c_custkey, 'unassigned', NULL, 0 FROM customer WHERE c_custkey NOT IN (SELECT item FROM a)""",
)
def l15(spark, root):
    items = table(spark, root, "customer").select(F.col("c_custkey").alias("item"))
    assigned = table(spark, root, "orders").select(
        number_where("o_totalprice > 300000", "o_custkey").alias("item"), F.col("o_orderpriority").alias("grp")
    )
    return ex.coverage(items, assigned, "item", "grp")


_EXPRESSION = "concat('[', o_orderstatus, '] + IF [', o_orderpriority, '] THEN [Number of Rows] ELSE [c', CAST(o_custkey AS {text}), '] END')"


@query(
    "l16_extract_tokens",
    f"SELECT o_orderkey, unnest(regexp_extract_all({_EXPRESSION.format(text='VARCHAR')}, '\\[([^\\[\\]]+)\\]', 1)) AS token FROM orders",
)
def l16(spark, root):
    expressions = table(spark, root, "orders").select("o_orderkey", F.expr(_EXPRESSION.format(text="STRING")).alias("expression"))
    return ex.extract_tokens(expressions, "expression")


@query(
    "l16_document_tokens",
    """SELECT doc_id, token, count(*) AS n FROM (
           SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([A-Za-z]+)\\.', '[\\1].', 'g'), '\\[([^\\[\\]]+)\\]', 1)) AS token FROM documents)
       GROUP BY doc_id, token""",
)
def l16_documents(spark, root):
    """The last word of every sentence as a field reference, over whole texts."""
    marked = F.regexp_replace("text", r"([A-Za-z]+)\.", "[$1].")
    tokens = ex.extract_tokens(table(spark, root, "documents").select("doc_id", marked.alias("text")), "text")
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l17_unknown_tokens",
    """WITH t AS (SELECT DISTINCT p_type AS flow, unnest([p_name, 'Number of Rows', p_brand]) AS token FROM part),
            allowed AS (SELECT p_type AS flow, p_name AS token FROM part WHERE p_size > 10 UNION SELECT p_type, p_brand FROM part WHERE p_size > 48),
            u AS (SELECT flow, token, row_number() OVER (PARTITION BY flow ORDER BY token) AS r, count(*) OVER (PARTITION BY flow) AS n
                  FROM t WHERE token <> 'Number of Rows' AND (flow, token) NOT IN (SELECT (flow, token) FROM allowed))
       SELECT flow, n AS n_unknown, string_agg('[' || token || ']', ', ' ORDER BY token) || CASE WHEN n > 8 THEN ' (+' || (n - 8) || ')' ELSE '' END AS shown
       FROM u WHERE r <= 8 GROUP BY flow, n""",
)
def l17(spark, root):
    parts = table(spark, root, "part")
    text = F.concat(F.lit("["), "p_name", F.lit("] * [Number of Rows] / ["), "p_brand", F.lit("]"))
    tokens = ex.extract_tokens(parts.select(F.col("p_type").alias("flow"), text.alias("expression")), "expression")
    allowed = parts.where("p_size > 10").select(F.col("p_type").alias("flow"), F.col("p_name").alias("token")).union(
        parts.where("p_size > 48").select("p_type", "p_brand")
    )
    return ex.shown_tokens(ex.unknown_tokens(tokens, allowed, "flow"), "flow")


@query(
    "l17_unknown_token_rows",
    """WITH t AS (SELECT DISTINCT p_type AS flow, unnest([p_name, 'Number of Rows', p_brand]) AS token FROM part),
            allowed AS (SELECT p_type AS flow, p_name AS token FROM part WHERE p_size > 10)
       SELECT flow, token FROM t WHERE token <> 'Number of Rows' AND (flow, token) NOT IN (SELECT (flow, token) FROM allowed)""",
)
def l17_rows(spark, root):
    parts = table(spark, root, "part")
    text = F.concat(F.lit("["), "p_name", F.lit("] * [Number of Rows] / ["), "p_brand", F.lit("]"))
    tokens = ex.extract_tokens(parts.select(F.col("p_type").alias("flow"), text.alias("expression")), "expression")
    allowed = parts.where("p_size > 10").select(F.col("p_type").alias("flow"), F.col("p_name").alias("token"))
    return ex.unknown_tokens(tokens, allowed, "flow")


@query("l6_expect_in_null", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def l6_null(spark, root):
    events = table(spark, root, "events").select("event_id", "event_type")
    return ex.expect_in(events, "event_type", ["click", None, "view"])
