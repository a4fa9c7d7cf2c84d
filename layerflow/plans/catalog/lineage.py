"""Lineage over edges derived from the sample tables.

Nodes are prefixed keys: r region, n nation, c customer, s supplier, o order, p part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerflow.operators import lineage as ln
from layerflow.operators.fields import absent_fields, field_lineage
from layerflow.operators.graphs import strong_components
from layerflow.operators.joins import exists_in
from layerflow.plans.catalog.registry import query, table

_PARTS = {
    "nation": ("concat('r', n_regionkey)", "concat('n', n_nationkey)"),
    "customer": ("concat('n', c_nationkey)", "concat('c', c_custkey)"),
    "orders": ("concat('c', o_custkey)", "concat('o', o_orderkey)"),
    "lineitem": ("concat('o', l_orderkey)", "concat('p', l_partkey)"),
}
_SUPPLY = {
    "supplier": ("concat('n', s_nationkey)", "concat('s', s_suppkey)"),
    "lineitem": ("concat('s', l_suppkey)", "concat('p', l_partkey)"),
}


def _sql(*groups) -> str:
    return " UNION ".join(
        f"SELECT {src} AS src, {dst} AS dst FROM {name}" for g in groups for name, (src, dst) in g.items()
    )


def _edges(spark, root, *groups) -> DataFrame:
    parts = [
        table(spark, root, name).selectExpr(f"{src} AS src", f"{dst} AS dst")
        for g in groups
        for name, (src, dst) in g.items()
    ]
    return reduce(DataFrame.union, parts)


@query(
    "m1_reachable",
    f"""WITH RECURSIVE e AS ({_sql(_PARTS)}), w(seed, node) AS (
            SELECT concat('n', n_nationkey), concat('n', n_nationkey) FROM nation
            UNION SELECT w.seed, e.dst FROM w JOIN e ON w.node = e.src)
        SELECT seed, node FROM w""",
)
def m1(spark, root):
    seeds = table(spark, root, "nation").selectExpr("concat('n', n_nationkey) AS seed")
    return ln.reachable(_edges(spark, root, _PARTS), seeds)


@query(
    "m2_bfs_levels",
    f"""WITH RECURSIVE e AS ({_sql(_PARTS)}), w(node, level) AS (
            SELECT concat('r', r_regionkey), 0 FROM region UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON w.node = e.src),
        nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT concat('r', r_regionkey) FROM region UNION SELECT concat('s', s_suppkey) FROM supplier)
        SELECT nodes.node, min(w.level) AS level FROM nodes LEFT JOIN w ON nodes.node = w.node GROUP BY nodes.node""",
)
def m2(spark, root):
    edges = _edges(spark, root, _PARTS)
    seeds = table(spark, root, "region").selectExpr("concat('r', r_regionkey) AS node")
    suppliers = table(spark, root, "supplier").selectExpr("concat('s', s_suppkey) AS node")
    nodes = edges.select("src").union(edges.select("dst")).union(seeds).union(suppliers)
    return ln.bfs_levels(edges, nodes, seeds)


@query(
    "m3_waves",
    f"""WITH RECURSIVE e AS ({_sql(_PARTS, _SUPPLY)}), w(node, wave) AS (
            SELECT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.wave + 1 FROM w JOIN e ON w.node = e.src)
        SELECT node, max(wave) AS wave FROM w GROUP BY node""",
)
def m3(spark, root):
    return ln.waves(_edges(spark, root, _PARTS, _SUPPLY))


def _rings(spark, root) -> DataFrame:
    """Each customer's orders of one priority in a chain; of every third customer the last leads
    to the first."""
    own = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    orders = table(spark, root, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.lead("o_orderkey").over(own).alias("next"))
    firsts = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("dst"), F.max("o_orderkey").alias("src"))
    closed = firsts.where("o_custkey % 3 = 0").select("src", "dst")
    return orders.select(F.col("o_orderkey").alias("src"), F.col("next").alias("dst")).where("dst is not null").unionByName(closed)


@query(
    "m3_strong_components",
    """SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS component, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n_members
       FROM orders WHERE o_custkey % 3 = 0""",
)
def m3_circles(spark, root):
    return strong_components(_rings(spark, root), "src", "dst")


@query(
    "m3_cyclic_waves",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS place,
                         min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS least, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders)
       SELECT o_orderkey AS node, CASE WHEN o_custkey % 3 = 0 THEN least ELSE o_orderkey END AS component,
              CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE place END AS INT) AS wave FROM o WHERE n > 1 OR o_custkey % 3 = 0""",
)
def m3_cyclic(spark, root):
    return ln.cyclic_waves(_rings(spark, root)).withColumn("wave", F.col("wave").cast("int"))


@query(
    "m4_node_roles",
    f"""WITH e AS ({_sql(_PARTS)}), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT concat('s', s_suppkey) FROM supplier),
             i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY src),
             d AS (SELECT nodes.node, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM nodes LEFT JOIN i ON nodes.node = i.node LEFT JOIN o ON nodes.node = o.node)
        SELECT node, n_in, n_out, n_in = 0 AND n_out > 0 AS is_source, n_out = 0 AND n_in > 0 AS is_sink, n_in > 1 AS is_merge, n_out > 1 AS is_branch,
               n_in = 0 AND n_out = 0 AS is_isolated FROM d""",
)
def m4(spark, root):
    edges = _edges(spark, root, _PARTS).distinct()
    suppliers = table(spark, root, "supplier").selectExpr("concat('s', s_suppkey) AS node")
    return ln.node_roles(edges, edges.select("src").union(edges.select("dst")).union(suppliers))


@query(
    "m5_bridge",
    """WITH chain AS (SELECT event_id, user_id, event_type, ts, lead(event_id) OVER u AS nxt, lead(event_type) OVER u AS nxt_type FROM events
                      WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
            kept AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events WHERE event_type = 'purchase')
       SELECT c.event_id AS src, c.nxt AS dst, c.nxt_type AS ns, k.target, CASE WHEN k.target IS NOT NULL THEN 'purchase' END AS target_ns,
              CASE WHEN c.nxt_type = 'purchase' THEN 'kept' WHEN k.target IS NULL THEN 'dropped' ELSE 'bridged' END AS verdict
       FROM chain c JOIN kept k ON c.event_id = k.event_id WHERE c.nxt IS NOT NULL""",
)
def m5(spark, root):
    from layerflow.operators.joins import join
    from layerflow.operators.windows import row_number

    events = table(spark, root, "events").select("event_id", "user_id", "event_type", "ts")
    numbered = row_number(events, "user_id", ["ts", "event_id"], "n")
    before = numbered.select("user_id", (F.col("n") + 1).alias("n"), F.col("event_id").alias("src"))
    edges = join(before, numbered, ["user_id", "n"], "inner").select("src", F.col("event_id").alias("dst"), F.col("event_type").alias("ns"))
    return ln.bridge(edges, events.where("event_type = 'purchase'").select("event_id"))


@query(
    "m5_bridge_tree",
    """WITH final AS (SELECT c_nationkey AS k, concat('o', o_orderkey) AS target, o_orderstatus AS ns FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'),
            n AS (SELECT k, min(target) AS target, min(ns) AS ns, count(DISTINCT (target, ns)) AS hits FROM final GROUP BY k)
       SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst, 'Default' AS ns, CASE WHEN hits = 1 THEN target END AS target,
              CASE WHEN hits = 1 THEN n.ns END AS target_ns, CASE WHEN hits IS NULL THEN 'dropped' WHEN hits > 1 THEN 'ambiguous' ELSE 'bridged' END AS verdict
       FROM nation LEFT JOIN n ON n_nationkey = k""",
)
def m5_tree(spark, root):
    tree = _edges(spark, root, {k: _PARTS[k] for k in ("nation", "customer")}).withColumn("ns", F.lit(None).cast("string"))
    orders = table(spark, root, "orders")
    last = orders.selectExpr("concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst", "o_orderstatus AS ns")
    keep = table(spark, root, "region").selectExpr("concat('r', r_regionkey) AS node").union(
        orders.where("o_orderpriority = '1-URGENT'").selectExpr("concat('o', o_orderkey)")
    )
    return ln.bridge(tree.unionByName(last), keep)


_MOVED = "CASE WHEN c_acctbal < 0 THEN 24 - c_nationkey ELSE c_nationkey END"


@query(
    "m6_lineage_closure",
    """SELECT concat('c', c_custkey) AS node FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 12
       UNION SELECT concat('o', o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 AND c_nationkey <> 12""",
)
def m6(spark, root):
    tree = _edges(spark, root, {k: _PARTS[k] for k in ("customer", "orders")})
    customers, orders = table(spark, root, "customer"), table(spark, root, "orders")
    wired = customers.selectExpr(f"concat('in', {_MOVED}) AS src", "concat('c', c_custkey) AS dst").union(
        orders.selectExpr("concat('c', o_custkey)", "concat('o', o_orderkey)")
    )
    inputs = table(spark, root, "nation").selectExpr("concat('in', n_nationkey) AS input", "concat('n', n_nationkey) AS source")
    return ln.lineage_closure(wired, tree, inputs)


@query(
    "m7_edge_diff",
    """SELECT concat('new', o_custkey) AS src, concat('o', o_orderkey) AS dst, concat('c', o_custkey) AS source_src, 'Default' AS ns_new, o_orderstatus AS ns_source
       FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'""",
)
def m7(spark, root):
    orders = table(spark, root, "orders")
    source = orders.selectExpr("concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst", "nullif(o_orderstatus, 'P') AS ns")
    new = orders.selectExpr(
        "concat('new', o_custkey) AS src",
        "concat('o', o_orderkey) AS dst",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE nullif(o_orderstatus, 'P') END AS ns",
    )
    subst = table(spark, root, "customer").selectExpr("concat('new', c_custkey) AS node", "concat('c', c_custkey) AS source_node")
    return ln.edge_diff(new, source, subst)


@query(
    "m8_derive_edges",
    """SELECT concat('stg', n_nationkey) AS src, concat('int', c_custkey) AS dst, n_name AS name
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 9000""",
)
def m8(spark, root):
    nations = table(spark, root, "nation")
    outputs = nations.selectExpr("concat('stg', n_nationkey) AS flow", "n_name AS name", "CAST(n_regionkey AS BIGINT) AS scope")
    inputs = (
        table(spark, root, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .selectExpr("concat('int', c_custkey) AS flow", "n_name AS name", "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 9000 THEN CAST(n_regionkey AS BIGINT) ELSE -1L END AS scope")
    )
    return ln.derive_edges(outputs, inputs, "scope")


@query(
    "m9_inherit_ns",
    """SELECT concat('pds', o_custkey) AS src, concat('o', o_orderkey) AS dst, coalesce(nullif(o_orderstatus, 'P'), 'Default') AS ns FROM orders
       UNION ALL SELECT concat('pds', c_custkey), concat('out', c_custkey), 'Default' FROM customer""",
)
def m9(spark, root):
    orders, customers = table(spark, root, "orders"), table(spark, root, "customer")
    source = orders.selectExpr("concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst", "nullif(o_orderstatus, 'P') AS ns")
    new = orders.selectExpr("concat('pds', o_custkey) AS src", "concat('o', o_orderkey) AS dst").union(
        customers.selectExpr("concat('pds', c_custkey)", "concat('out', c_custkey)")
    )
    replaces = customers.selectExpr("concat('pds', c_custkey) AS node", "concat('c', c_custkey) AS predecessor")
    return ln.inherit_ns(new, source, replaces)


@query(
    "m6_closure_by_name",
    """SELECT concat('c', c_custkey) AS node FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 12
       UNION SELECT concat('o', o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 AND c_nationkey <> 12""",
)
def m6_by_name(spark, root):
    """The same closure; what an input stands for is found by the name of its data set."""
    tree = _edges(spark, root, {k: _PARTS[k] for k in ("customer", "orders")})
    customers, orders = table(spark, root, "customer"), table(spark, root, "orders")
    wired = customers.selectExpr(f"concat('in', {_MOVED}) AS src", "concat('c', c_custkey) AS dst").union(
        orders.selectExpr("concat('c', o_custkey)", "concat('o', o_orderkey)")
    )
    nations = table(spark, root, "nation")
    inputs = nations.selectExpr("concat('in', n_nationkey) AS input", "n_name AS name")
    originals = nations.selectExpr("concat('n', n_nationkey) AS node", "n_name AS name")
    return ln.lineage_closure(wired, tree, ln.input_sources(inputs, originals))


_FIELD_STEPS = """o AS (SELECT o_orderkey AS step, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nxt,
                              min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM orders),
    act AS (SELECT step, 'c3' AS name, 'c0' AS source FROM o WHERE step % 5 = 0
            UNION ALL SELECT step, 'c4', unnest(['c1', 'c3']) FROM o WHERE step % 5 = 1
            UNION ALL SELECT step, 'c1', 'c2' FROM o WHERE step % 5 = 2),
    gone AS (SELECT step, 'c0' AS name FROM o WHERE step % 5 = 0 UNION ALL SELECT step, 'c2' FROM o WHERE step % 5 = 3)"""

_FIELD_WALK = f"""WITH RECURSIVE {_FIELD_STEPS},
    -- what becomes of a column in a step: it passes, or others are made from it
    full_map AS (SELECT step, c AS source, c AS name FROM o, (SELECT unnest(['c0', 'c1', 'c2', 'c3', 'c4', 'c5']) AS c)
                 WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.step = o.step AND act.name = c)
                   AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.step = o.step AND gone.name = c)
                 UNION ALL SELECT step, source, name FROM act WHERE source IS NOT NULL),
    before AS (
        SELECT first AS step, unnest(['c0', 'c1', 'c2']) AS name, first AS origin_step, unnest(['c0', 'c1', 'c2']) AS origin FROM o WHERE step = first
        UNION
        SELECT o.nxt, x.name, x.origin_step, x.origin FROM o JOIN (
            SELECT b.step, m.name, b.origin_step, b.origin FROM before b JOIN full_map m ON m.step = b.step AND m.source = b.name) x ON x.step = o.step
        WHERE o.nxt IS NOT NULL)"""


def _field_tables(spark, root):
    own = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    orders = table(spark, root, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("step"), F.lead("o_orderkey").over(own).alias("nxt"))
    edges = orders.where("nxt is not null").select(F.col("step").alias("src"), F.col("nxt").alias("dst"))
    firsts = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("step").alias("step"))
    inputs = firsts.select("step", F.explode(F.array(*[F.lit(f"c{k}") for k in range(3)])).alias("column"))
    made = {0: [("c3", "c0")], 1: [("c4", "c1"), ("c4", "c3")], 2: [("c1", "c2")]}
    listed = [
        F.when(F.col("step") % 5 == k, F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("source")) for n, s in pairs]))
        for k, pairs in made.items()
    ]
    actions = orders.select("step", F.inline(F.coalesce(*listed)))
    removed = orders.where("step % 5 in (0, 3)").select("step", F.when(F.col("step") % 5 == 0, "c0").otherwise("c2").alias("name"))
    return edges, inputs, actions, removed


@query(
    "o4_field_lineage",
    _FIELD_WALK + " SELECT DISTINCT b.step, m.name, b.origin_step, b.origin FROM before b JOIN full_map m ON m.step = b.step AND m.source = b.name",
)
def o4_lineage(spark, root):
    """Input columns behind the columns of chains of steps that rename, create and remove."""
    edges, inputs, actions, removed = _field_tables(spark, root)
    found = field_lineage(edges, inputs, actions, removed)
    # columns that are made from nothing that exists are their own origin; the walk has none
    return exists_in(found, inputs, [("origin_step", "step"), ("origin", "column")])


@query(
    "l17_absent_fields",
    f"""WITH RECURSIVE {_FIELD_STEPS},
    there AS (
        (SELECT first AS step, unnest(['c0', 'c1', 'c2']) AS name FROM o WHERE step = first
         UNION SELECT nxt, act.name FROM act JOIN o USING (step) WHERE nxt IS NOT NULL)
        UNION
        SELECT o.nxt, t.name FROM there t JOIN o USING (step)
        WHERE o.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.step = t.step AND gone.name = t.name))
    SELECT step, name, source FROM act WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM there t WHERE t.step = act.step AND t.name = act.source)""",
)
def l17_absent(spark, root):
    return absent_fields(*_field_tables(spark, root))
