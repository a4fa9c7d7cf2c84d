"""Run ledger, metrics, consumers and JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.functions.documents import explode_object, json_collect, malformed_documents, referenced_fields
from layerflow.operators import ledger as lg
from layerflow.operators.metrics import consumer_impact, metric
from layerflow.plans.catalog.registry import as_double, exact, number_where, query, table


@query(
    "n1_upsert_latest",
    """SELECT user_id, ts, event_type, event_id FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def n1(spark, root):
    events = table(spark, root, "events").select("user_id", "ts", "event_type", "event_id")
    noon = "TIMESTAMP_NTZ'2024-01-16 00:00:00'"
    empty = events.where("false")
    state = lg.upsert_latest(empty, events.where(f"ts < {noon}"), "user_id", "ts")
    updates = events.where(f"ts >= {noon}")
    return lg.upsert_latest(lg.upsert_latest(state, updates, "user_id", "ts"), updates, "user_id", "ts")


_RUNS = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 7 END"


@query(
    "n1_record_runs",
    f"""WITH r AS (SELECT user_id, ts, {_RUNS} AS code FROM events WHERE event_type <> 'view'),
            m AS (SELECT user_id, ts, max(code) AS code FROM r GROUP BY user_id, ts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
       SELECT c_custkey AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'pds_augment' ELSE 'flow' END AS kind,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 'n/a' WHEN m.user_id IS NULL THEN 'pending' WHEN code = 0 THEN 'success' ELSE 'failed' END AS run_status,
              CASE WHEN c_mktsegment <> 'BUILDING' THEN code END AS finish_code, CASE WHEN c_mktsegment <> 'BUILDING' THEN ts END AS run_at
       FROM customer LEFT JOIN m ON c_custkey = user_id""",
)
def n1_runs(spark, root):
    ledger = table(spark, root, "customer").selectExpr(
        "c_custkey AS name",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'pds_augment' ELSE 'flow' END AS kind",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'n/a' ELSE 'pending' END AS run_status",
        "CAST(NULL AS INT) AS finish_code",
        "CAST(NULL AS TIMESTAMP_NTZ) AS run_at",
    )
    runs = table(spark, root, "events").selectExpr("user_id AS name", "ts AS run_at", f"{_RUNS} AS finish_code")
    return lg.record_runs(lg.record_runs(ledger, runs, "name"), runs, "name")


_STATUS = "CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'timeout' ELSE 'failed' END"


@query("n2_map_status", f"SELECT event_id, {_RUNS} AS code, {_STATUS} AS run_status FROM events")
def n2(spark, root):
    return lg.map_status(table(spark, root, "events").selectExpr("event_id", f"{_RUNS} AS code"), "code")


_LEDGER = [
    "o_orderkey AS name",
    "CASE o_orderstatus WHEN 'F' THEN 'staging' WHEN 'O' THEN 'intermediate' ELSE 'marts' END AS layer",
    "CASE WHEN o_orderpriority = '5-LOW' THEN 'pending' ELSE 'published' END AS publish_status",
    "CASE WHEN o_totalprice < 50000 THEN NULL ELSE concat('f', o_orderkey) END AS flow_luid",
    "CASE WHEN o_totalprice > 300000 THEN 'success' WHEN o_totalprice > 150000 THEN 'failed' END AS run_status",
]


@query(
    "n3_pending",
    f"""SELECT * FROM (SELECT {', '.join(_LEDGER)} FROM orders)
        WHERE layer = 'intermediate' AND publish_status = 'published' AND flow_luid IS NOT NULL AND run_status IS DISTINCT FROM 'success'""",
)
def n3(spark, root):
    return lg.pending(table(spark, root, "orders").selectExpr(*_LEDGER), "intermediate")


@query(
    "n4_run_summary",
    f"""SELECT user_id, count(*) AS n_runs, count(*) FILTER (s = 'success') AS n_success, count(*) FILTER (s = 'failed') AS n_failed,
               count(*) FILTER (s = 'timeout') AS n_timeout, max(value) AS max_duration
        FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY user_id""",
)
def n4(spark, root):
    runs = table(spark, root, "events").selectExpr("user_id", "value", f"{_RUNS} AS code")
    return lg.run_summary(lg.map_status(runs, "code"), "user_id", "value")


@query("n4_failed_runs", f"SELECT user_id, event_id, {_STATUS} AS run_status FROM events WHERE event_type <> 'click'")
def n4_failed(spark, root):
    runs = table(spark, root, "events").selectExpr("user_id", "event_id", f"{_RUNS} AS code")
    return lg.failed_runs(lg.map_status(runs, "code"), "user_id", "event_id")


_SERIES = """SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
                    CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS value, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS v
             FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2"""


@query("o1_metric", f"SELECT o_orderpriority, period, value FROM ({_SERIES})")
def o1(spark, root):
    series = metric(table(spark, root, "orders"), exact("o_totalprice"), "sum", "o_orderdate", "month", ["o_orderstatus <> 'P'"], "o_orderpriority")
    return as_double(series, "value")


@query(
    "o2_running_total",
    f"""SELECT o_orderpriority, period, value, CAST(sum(v) OVER (PARTITION BY o_orderpriority ORDER BY period) AS DOUBLE) AS running_total FROM ({_SERIES})""",
)
def o2(spark, root):
    series = metric(
        table(spark, root, "orders"), exact("o_totalprice"), "sum", "o_orderdate", "month", ["o_orderstatus <> 'P'"], "o_orderpriority", running_total=True
    )
    return as_double(series, "value", "running_total")


@query(
    "o3_compare_previous",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS period, count(*) AS value FROM events GROUP BY 1, 2)
       SELECT s.user_id, s.period, s.value, p.value AS previous, s.value - p.value AS change, CAST(s.value AS DOUBLE) / p.value AS ratio
       FROM s LEFT JOIN s p ON p.user_id = s.user_id AND p.period = s.period - 1""",
)
def o3(spark, root):
    return metric(table(spark, root, "events"), F.lit(1), "count", "ts", "day", dims="user_id", compare="previous")


@query(
    "o2_running_total_all",
    """WITH s AS (SELECT date_trunc('minute', ts) AS period, count(*) AS value FROM events GROUP BY 1)
       SELECT s.period, s.value, CAST(sum(s.value) OVER (ORDER BY s.period) AS BIGINT) AS running_total, p.value AS previous, s.value - p.value AS change,
              CAST(s.value AS DOUBLE) / p.value AS ratio
       FROM s LEFT JOIN s p ON p.period = s.period - INTERVAL 1 MINUTE""",
)
def o2_all(spark, root):
    """All events by the minute, without dimensions."""
    return metric(table(spark, root, "events"), F.lit(1), "count", "ts", "minute", running_total=True, compare="previous")


_DEFINITION = """concat('{"specification":{"basic_specification":{"measure":{"field":"', p_brand, '"},"time_dimension":{"field":"', p_type,
    '"},"filters":[{"field":"', p_name, '"},{"field":"size', p_size, '"}]},"viz_state_specification":{"viz_state_string":"{\\\\"vizState\\\\":{\\\\"rows\\\\":[{\\\\"fieldCaption\\\\":\\\\"v',
    p_size, '\\\\"}]}}"}},"extension_options":{"allowed_dimensions":["', p_brand, '","dim"]}}')"""


@query(
    "o4_referenced_fields",
    """SELECT DISTINCT p_partkey, unnest([p_brand, p_type, p_name, 'size' || p_size, 'v' || p_size, 'dim']) AS field FROM part""",
)
def o4(spark, root):
    definitions = table(spark, root, "part").selectExpr("p_partkey", f"{_DEFINITION} AS definition")
    return referenced_fields(definitions, "p_partkey", "definition")


@query(
    "o5_consumer_impact",
    """WITH d AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
            f AS (SELECT o_orderkey, o_custkey FROM d WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)),
            c AS (SELECT c_custkey AS dataset, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000) AS reports,
                         (SELECT count(*) FROM d WHERE o_custkey = c_custkey) AS definitions, (SELECT count(*) FROM f WHERE o_custkey = c_custkey) AS definitions_followed FROM customer)
       SELECT *, CASE WHEN reports > 0 OR definitions_followed > 0 THEN 'repoint' WHEN definitions > 0 THEN 'cleanup_only' ELSE 'none' END AS recommendation FROM c""",
)
def o5(spark, root):
    orders, lines = table(spark, root, "orders"), table(spark, root, "lineitem")
    targets = table(spark, root, "customer").select(F.col("c_custkey").alias("dataset"))
    reports = orders.select(number_where("o_orderstatus = 'F' AND o_totalprice > 400000", "o_custkey").alias("dataset"))
    definitions = orders.select(
        F.col("o_orderkey").alias("definition"), number_where("o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_custkey").alias("dataset")
    )
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity")
    metrics = lines.select(F.col("l_orderkey").alias("definition"), name.alias("metric"))
    followed = F.when(F.expr("l_returnflag = 'R' AND l_quantity > 45"), name).otherwise(F.concat(F.lit("~"), name))
    subscriptions = lines.select(followed.alias("metric"))
    return consumer_impact(targets, reports, definitions, metrics, subscriptions)


@query("p1_explode_object", "SELECT event_id, unnest(json_keys(props)) AS id, json_extract_string(props, '$.k') AS value FROM events")
def p1(spark, root):
    return explode_object(table(spark, root, "events").select("event_id", "props"), "props")


@query(
    "p2_json_collect",
    "SELECT DISTINCT p_partkey, unnest([p_brand, p_type, p_name]) AS value FROM part",
)
def p2(spark, root):
    documents = table(spark, root, "part").selectExpr(
        "p_partkey",
        """concat('{"name":"', p_brand, '","size":', p_size, ',"actions":[{"columnNames":["', p_type, '",5,"', p_name, '"],"note":"x"},{"rename":null}]}') AS document""",
    )
    return json_collect(documents, "document", ["name", "columnNames", "rename"])


@query("p2_json_collect_malformed", "SELECT p_partkey FROM part WHERE p_size % 10 = 3")
def p2_malformed(spark, root):
    documents = table(spark, root, "part").selectExpr(
        "p_partkey", """concat('{"name":"', p_brand, '"', CASE WHEN p_size % 10 = 3 THEN '' ELSE '}' END) AS document"""
    )
    return malformed_documents(documents, "document").select("p_partkey")
