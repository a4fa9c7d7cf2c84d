"""Lineage over edge tables ``(src, dst[, ns])``.

Walks go round by round, and each round moves only what the round before has changed. The rows
a frontier reaches are written to the shared folder, looked up among the known ones, and what
is new becomes the next frontier; so a lost executor repeats one read and plans stay short.
Spark knows the size of a written table: a small one is broadcast, and edges and known rows
stay where they are; a large one is shuffled, and the adaptive skew join spreads nodes with
very many edges. Nothing seen on the way returns to the driver.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import as_list
from layerflow.operators.graphs import condensed, strong_components
from layerflow.operators.joins import attach, exists_in, missing_from
from layerflow.session import cut

# Fixed value: the namespace of an edge that names none.
DEFAULT_NS = "Default"
# Rounds after which the table of seen rows is written in one piece again.
REWRITE_EVERY = 10
# Inputs that share one number, as a power of two.
MASK_SHIFT = 6
MASK_BITS = 1 << MASK_SHIFT


def _links(edges: DataFrame) -> DataFrame:
    """Distinct edges. They lie spread by (src, dst), so a node with very many edges does
    not weigh on one partition."""
    return cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())


def _with_ns(edges: DataFrame) -> DataFrame:
    """Edges with a namespace; a missing or empty one is the default."""
    if "ns" not in edges.columns:
        return edges.select("src", "dst", F.lit(DEFAULT_NS).alias("ns"))
    named = F.coalesce(F.nullif(F.col("ns"), F.lit("")), F.lit(DEFAULT_NS))
    return edges.select("src", "dst", named.alias("ns"))


def _walk(links: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """All (keys…, node, level) with the smallest number of hops from ``start``."""
    frontier = cut(start.withColumn("level", F.lit(0)))
    seen, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        met = links.join(frontier.drop("level"), F.col("src") == F.col("node"))
        reached = cut(met.select(*keys, F.col("dst").alias("node")).distinct())
        known = seen.select(*keys, "node").join(reached, [*keys, "node"], "left_semi")
        frontier = cut(reached.join(known, [*keys, "node"], "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
        if level % REWRITE_EVERY == 0:
            seen = cut(seen)
    return seen


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All (seed, node) pairs, every seed reaching itself. ``seeds`` has one column. This is
    also the rebuild scope: a changed table and everything downstream of it."""
    first = seeds.columns[0]
    start = seeds.select(F.col(first).alias("seed"), F.col(first).alias("node")).where("seed IS NOT NULL").distinct()
    return _walk(_links(edges), start, ["seed"]).select("seed", "node")


def bfs_levels(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, level): hops from the nearest seed; nodes no seed reaches have null."""
    start = seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL").distinct()
    levels = _walk(_links(edges), start, [])
    everything = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return attach(everything, levels, "node", unique=True)


def waves(edges: DataFrame) -> DataFrame:
    """(node, wave): length of the longest path that ends in the node, so all nodes of one
    wave can be built at the same time. Raises when the edges contain a cycle.

    A node with one parent lies one beyond it, so chains and trees of such nodes are shortened
    by doubling, and the edges that are left lead from their tops to nodes with several
    parents. All nodes without parents count as one, which makes others nodes with one parent:
    the next round takes these. Edges of nodes that are settled are not read again.
    """
    links = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    # a null src stands for all nodes without parents
    left, rounds, parented = links.withColumn("hops", F.lit(1).cast("bigint")), [], None
    while True:
        grouped = left.groupBy(F.col("dst").alias("node")).agg(
            F.min("src").alias("low"), F.max("src").alias("high"), F.max(F.col("src").isNull()).alias("top"), F.max("hops").alias("hops")
        )
        several = F.col("low").isNotNull() & (F.col("top") | (F.col("low") != F.col("high")))
        ups = _climbed(
            grouped.select(
                "node",
                F.when(~several, F.col("low")).alias("up"),
                F.when(several, F.lit(0)).otherwise(F.col("hops")).alias("hops"),
                (~several & F.col("low").isNotNull()).alias("going"),
                several.alias("several"),
            )
        )
        parented = ups if parented is None else parented
        rounds.append(ups.where("NOT several").select("node", "up", "hops"))
        open_nodes = ups.where("several").select("node")
        n_open = open_nodes.count()
        if not n_open:
            break
        if n_open == ups.count():
            raise ValueError("waves: the edges contain a cycle")
        above = ups.select(
            F.col("node").alias("src"), F.when(F.col("several"), F.col("node")).otherwise(F.col("up")).alias("up"), F.col("hops").alias("more")
        )
        met = left.where("src IS NOT NULL").join(above, "src", "left")
        met = met.select(F.col("up").alias("src"), "dst", (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        met = met.unionByName(left.where("src IS NULL")).groupBy("src", "dst").agg(F.max("hops").alias("hops"))
        left = cut(met.join(open_nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "hops"))
    tops = links.select(F.col("src").alias("node")).distinct().join(parented.select("node"), "node", "left_anti")
    found = tops.withColumn("wave", F.lit(0).cast("bigint"))
    known = None
    for number, some in enumerate(reversed(rounds), 1):
        settled = some.where("up IS NULL").select("node", F.col("hops").alias("wave"))
        if known is not None:
            base = known.select(F.col("node").alias("up"), "wave")
            beyond = some.where("up IS NOT NULL").join(base, "up").select("node", (F.col("wave") + F.col("hops")).alias("wave"))
            settled = known.unionByName(settled).unionByName(beyond)
        known = cut(settled) if number % REWRITE_EVERY == 0 else settled
    return found.unionByName(known).select("node", F.col("wave").cast("int").alias("wave"))


def _climbed(ups: DataFrame) -> DataFrame:
    """Pointers (node, up, hops, going, several) moved up by doubling, to a node with several
    parents or past the last parent, where ``up`` is null. Only pointers still going are looked
    up; what goes on after enough doublings to cross the whole table runs in a circle."""
    ups = cut(ups)
    n = ups.where("going").count()
    for _ in range(ceil(log2(max(n, 2))) + 2):
        if not n:
            return ups
        onward = ups.select(
            F.col("node").alias("up"), F.col("up").alias("up_2"), F.col("hops").alias("hops_2"),
            F.col("going").alias("going_2"), F.col("several").alias("stop"),
        )
        met = ups.where("going").join(onward, "up", "left")
        moved = met.select(
            "node",
            F.when(F.col("stop"), F.col("up")).otherwise(F.col("up_2")).alias("up"),
            (F.col("hops") + F.coalesce("hops_2", F.lit(0))).alias("hops"),
            F.coalesce("going_2", F.lit(False)).alias("going"),
            "several",
        )
        ups = cut(ups.where("NOT going").unionByName(moved))
        n = ups.where("going").count()
    if n:
        raise ValueError("waves: the edges contain a cycle")
    return ups


def cyclic_waves(edges: DataFrame) -> DataFrame:
    """(node, component, wave) for graphs with circles: the nodes of a circle share a component,
    named by its smallest node, and its wave; other nodes are components of their own. Waves are
    those of ``waves`` over the edges between components."""
    circles = strong_components(edges, "src", "dst")
    pairs = edges.where("src is not null and dst is not null")
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = nodes.join(circles.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    between = cut(condensed(pairs, circles, "src", "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = waves(between).withColumnRenamed("node", "component")
    return named.join(found, "component", "left").select("node", "component", F.coalesce("wave", F.lit(0)).alias("wave"))


def node_roles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_in, n_out) and what this makes the node: source, sink, merge point (several
    in), branch (several out), isolated. One grouping serves both directions."""
    zero, one = F.lit(0), F.lit(1)

    def part(node: str, n_in, n_out):
        return F.struct(F.col(node).alias("node"), n_in.alias("n_in"), n_out.alias("n_out"), zero.alias("listed"))

    ends = edges.select(F.inline(F.array(part("src", zero, one), part("dst", one, zero))))
    listed = nodes.select(F.col(nodes.columns[0]).alias("node"), zero.alias("n_in"), zero.alias("n_out"), one.alias("listed"))
    counts = (
        ends.unionByName(listed)
        .groupBy("node")
        .agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.max("listed").alias("listed"))
        .where("listed = 1 AND node IS NOT NULL")
    )
    return counts.select(
        "node",
        "n_in",
        "n_out",
        ((F.col("n_in") == 0) & (F.col("n_out") > 0)).alias("is_source"),
        ((F.col("n_out") == 0) & (F.col("n_in") > 0)).alias("is_sink"),
        (F.col("n_in") > 1).alias("is_merge"),
        (F.col("n_out") > 1).alias("is_branch"),
        ((F.col("n_in") == 0) & (F.col("n_out") == 0)).alias("is_isolated"),
    )


def _jump_chains(chain: DataFrame) -> DataFrame:
    """Shorten every chain (node, to, ns, merge) to its end by doubling: the pointer of a
    node moves to where its target's pointer leads. One row per node throughout. What is
    still on the way after enough doublings to cross the whole table runs in a circle and
    leads nowhere."""
    chain = cut(chain)
    rounds = ceil(log2(max(chain.count(), 2))) + 1
    for _ in range(rounds):
        onward = chain.select(
            F.col("node").alias("at"), F.col("to").alias("to_2"), F.col("ns").alias("ns_2"), F.col("merge").alias("merge_2")
        )
        jumped = chain.join(onward, F.col("to") == F.col("at"), "left")
        moves = F.col("at").isNotNull()
        chain = cut(
            jumped.select(
                "node",
                F.when(moves, F.col("to_2")).otherwise(F.col("to")).alias("to"),
                F.when(moves, F.col("ns_2")).otherwise(F.col("ns")).alias("ns"),
                F.when(moves, F.col("merge") | F.col("merge_2")).otherwise(F.col("merge")).alias("merge"),
                moves.alias("moved"),
            )
        )
        if chain.where("moved").isEmpty():
            break
    return missing_from(chain.drop("moved"), chain.select("node"), [("to", "node")])


def _via_chains(hops: DataFrame, ends: DataFrame, chain_nodes: DataFrame) -> DataFrame:
    """Hops with targets inside a chain moved to the end of the chain; hops into a chain that
    leads nowhere are dropped."""
    found = ends.select(
        F.col("node").alias("at"), F.col("to").alias("to_2"), F.col("ns").alias("ns_2"), F.col("merge").alias("merge_2")
    )
    into = attach(hops, chain_nodes, [("to", "node")], found="__in_chain", unique=True)
    moved = into.join(found, F.col("to") == F.col("at"), "left").where("NOT __in_chain OR at IS NOT NULL")
    hit = F.col("at").isNotNull()
    others = [c for c in hops.columns if c not in ("to", "ns", "merge")]
    return moved.select(
        *others,
        F.when(hit, F.col("to_2")).otherwise(F.col("to")).alias("to"),
        F.when(hit, F.col("ns_2")).otherwise(F.col("ns")).alias("ns"),
        F.when(hit, F.col("merge") | F.col("merge_2")).otherwise(F.col("merge")).alias("merge"),
    )


def _summarise(hops: DataFrame, values: DataFrame, keep: DataFrame, by: list[str]) -> DataFrame:
    """Smallest and largest (target, ns) the hops of each ``by`` lead to, which is enough to
    tell none, one and several apart without listing them."""
    kept = attach(hops, keep, [("to", "node")], found="__is_kept", unique=True)
    offered = values.select(
        F.col("node").alias("at"), F.col("low").alias("low_2"), F.col("high").alias("high_2"), F.col("merge").alias("merge_2")
    )
    met = kept.join(offered, F.col("to") == F.col("at"), "left")
    here = F.when(F.col("__is_kept"), F.struct(F.col("to").alias("target"), F.col("ns")))
    low, high = F.coalesce(here, F.col("low_2")), F.coalesce(here, F.col("high_2"))
    return (
        met.withColumns({"__low": low, "__high": high})
        .where(F.col("__low").isNotNull())
        .groupBy(*by)
        .agg(
            F.min("__low").alias("low"),
            F.max("__high").alias("high"),
            F.bool_or(F.col("merge") | F.coalesce(F.col("merge_2"), F.lit(False))).alias("merge"),
        )
    )


def bridge(edges: DataFrame, keep: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Contract a graph to the kept nodes.

    One row per edge that leaves a kept node: ``src, dst, ns`` as they were, ``target`` and
    ``target_ns`` after bridging over excluded nodes (the namespace is that of the last hop),
    and a verdict: ``kept`` (no bridge needed), ``bridged``, ``dropped`` (no kept node lies
    beyond), ``ambiguous`` (several do, or one in several namespaces), ``merge_point`` (an
    excluded node on a path that leads to the target has several parents, whose rows would be
    lost). Walks end at ``outputs``.

    Chains of excluded nodes are shortened by doubling; excluded nodes that branch carry only
    the smallest and largest target, so no list of paths or targets is built.
    """
    links = cut(_with_ns(edges))
    kept = cut(keep.select(F.col(keep.columns[0]).alias("node")).distinct())
    several = F.count(F.lit(1)) > 1
    parents = links.groupBy(F.col("dst").alias("dst_of_parent")).agg(several.alias("merge"))
    origins = exists_in(links, kept, [("src", "node")])

    inner = missing_from(links, kept, [("src", "node")])
    if outputs is not None:
        inner = missing_from(inner, outputs, [("src", outputs.columns[0])])
    marked = attach(inner, parents, [("src", "dst_of_parent")], unique=True)
    hops = cut(
        marked.select(
            F.col("src").alias("node"),
            F.col("dst").alias("to"),
            "ns",
            F.coalesce(F.col("merge"), F.lit(False)).alias("merge"),
        ).distinct()
    )
    degrees = hops.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    branching = cut(degrees.where("n > 1").select("node"))
    chain = missing_from(hops, branching, "node")
    ends = cut(_jump_chains(chain))

    chain_nodes = chain.select("node")
    forks = cut(_via_chains(exists_in(hops, branching, "node"), ends, chain_nodes))
    nothing = forks.where("false").select(
        "node",
        F.struct(F.col("to").alias("target"), F.col("ns")).alias("low"),
        F.struct(F.col("to").alias("target"), F.col("ns")).alias("high"),
        "merge",
    )
    values, active, rounds = nothing, forks, 0
    while True:
        # Forks are looked at again only when something they lead to has changed.
        better = _summarise(active, values, kept, ["node"])
        changed = cut(missing_from(better, values, ["node", "low", "high", "merge"]))
        if changed.isEmpty():
            break
        rounds += 1
        values = missing_from(values, changed, "node").unionByName(changed)
        if rounds % REWRITE_EVERY == 0:
            values = cut(values)
        above = exists_in(forks, changed, [("to", "node")]).select("node").distinct()
        active = exists_in(forks, above, "node")

    starts = origins.select(
        "src", "dst", F.col("ns").alias("ns_in"), F.col("dst").alias("to"), "ns", F.lit(False).alias("merge")
    )
    led = _summarise(_via_chains(starts, ends, chain_nodes), values, kept, ["src", "dst", "ns_in"])
    verdicts = attach(
        attach(origins, kept, [("dst", "node")], found="__direct", unique=True),
        led.withColumnsRenamed({"src": "__src", "dst": "__dst", "ns_in": "__ns"}),
        [("src", "__src"), ("dst", "__dst"), ("ns", "__ns")],
        unique=True,
    )
    verdict = (
        F.when(F.col("__direct"), F.lit("kept"))
        .when(F.col("low").isNull(), F.lit("dropped"))
        .when(F.col("low") != F.col("high"), F.lit("ambiguous"))
        .when(F.col("merge"), F.lit("merge_point"))
        .otherwise(F.lit("bridged"))
    )
    judged = verdicts.withColumn("verdict", verdict)
    leads = F.col("verdict").isin("kept", "bridged")
    return judged.select(
        "src",
        "dst",
        "ns",
        F.when(leads, F.col("low.target")).alias("target"),
        F.when(leads, F.col("low.ns")).alias("target_ns"),
        "verdict",
    )


def lineage_closure(
    new_edges: DataFrame, source_edges: DataFrame, inputs: DataFrame, nodes: DataFrame | None = None
) -> DataFrame:
    """Nodes of the new graph that no declared input feeds as the original graph demands.

    ``inputs`` (input, source): what each input of the new graph stands for in the original
    graph, one row per original node. A node passes when an input reaches it in the new graph
    and that input's original is among its ancestors, or is itself. Inputs, and nodes the
    original graph does not know, are not judged. ``nodes`` adds new nodes without edges.

    Both graphs are walked at once, from the inputs and from their originals. A node keeps one
    number for 64 inputs, whose bits are those that reach it, and passes if a bit comes on both
    ways; pairs of inputs and nodes are never listed.
    """
    entry = inputs.select("input").where("input IS NOT NULL").distinct()
    ends = [e.select(F.explode(F.array("src", "dst")).alias("node")).distinct() for e in (new_edges, source_edges)]
    mine = ends[0] if nodes is None else ends[0].union(nodes.select(nodes.columns[0])).distinct()
    judged = cut(missing_from(exists_in(mine, ends[1], "node"), entry, [("node", "input")]))
    inward = missing_from(new_edges, entry, [("dst", "input")])
    links = cut(
        _sided(inward, False).union(_sided(source_edges, True)).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    )
    # Each input has a bit, which its originals have too.
    marked = cut(entry.withColumn("id", F.monotonically_increasing_id()))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % MASK_BITS).cast("int"))
    marked = marked.select("input", F.call_function("shiftright", F.col("id"), F.lit(MASK_SHIFT)).alias("batch"), bit.alias("mask"))
    origins = inputs.select("input", "source").where("source IS NOT NULL").distinct().join(marked, "input")
    start = marked.select(F.lit(False).alias("original"), "batch", F.col("input").alias("node"), "mask").union(
        origins.select(F.lit(True), "batch", "source", "mask")
    )
    masks = _walk_masks(links, start.groupBy("original", "batch", "node").agg(F.bit_or("mask").alias("mask")))
    side = [F.bit_or(F.when(F.col("original") == original, F.col("mask"))) for original in (False, True)]
    met = masks.groupBy("batch", "node").agg(side[0].alias("fed"), side[1].alias("demanded"))
    closed = met.where(F.col("fed").bitwiseAND(F.col("demanded")) != 0).select("node").distinct()
    return missing_from(judged, closed, "node")


def _sided(edges: DataFrame, original: bool) -> DataFrame:
    return edges.select(F.lit(original).alias("original"), "src", "dst")


def _walk_masks(links: DataFrame, start: DataFrame) -> DataFrame:
    """The bits that reach each node of either graph, as rows of (original, batch, node, mask)
    whose masks are to be united. Every round carries only bits that are new to a node."""
    keys = ["original", "batch", "node"]
    frontier = cut(start)
    seen, rounds = frontier, 0
    while not frontier.isEmpty():
        rounds += 1
        met = links.join(frontier.withColumnRenamed("node", "src"), ["original", "src"])
        met = cut(met.groupBy("original", "batch", F.col("dst").alias("node")).agg(F.bit_or("mask").alias("mask")))
        known = seen.join(met.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.bit_or("mask").alias("had"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("bigint"))))
        frontier = cut(met.join(known, keys, "left").select(*keys, fresh.alias("mask")).where("mask <> 0"))
        seen = seen.unionByName(frontier)
        if rounds % REWRITE_EVERY == 0:
            seen = cut(seen.groupBy(*keys).agg(F.bit_or("mask").alias("mask")))
    return seen


def input_sources(inputs: DataFrame, originals: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """What the inputs of a new graph stand for in the original one, as distinct (input,
    source): an original of the same id or of the same data set name, and whatever ``supplied``
    (input, source) lists besides. ``inputs`` is (input, name), ``originals`` (node, name); a
    null name is no name."""
    theirs = originals.select(F.col("node").alias("source"), "name")
    by_id = inputs.select("input").join(theirs.select("source"), F.col("input") == F.col("source"))
    by_name = inputs.join(theirs, "name").select("input", "source")
    found = by_id.select("input", "source").union(by_name)
    if supplied is not None:
        found = found.union(supplied.select("input", "source"))
    return found.where("input IS NOT NULL AND source IS NOT NULL").distinct()


def edge_diff(
    new_edges: DataFrame,
    source_edges: DataFrame,
    subst: DataFrame | None = None,
    bridged: DataFrame | None = None,
) -> DataFrame:
    """Edges whose namespace is not the one the same edge has in the original graph.

    ``subst`` (node, source_node) names the original parent a new node stands in for;
    ``bridged`` (src, dst, ns) lists edges that took their namespace from another edge. Edges
    the original graph lacks are not judged; a missing namespace is ``Default``.
    """
    mine = _with_ns(new_edges)
    if bridged is not None:
        mine = missing_from(mine, _with_ns(bridged), ["src", "dst", "ns"])
    if subst is not None:
        mine = attach(mine, subst.select(F.col("node").alias("__node"), "source_node"), [("src", "__node")])
        mine = mine.withColumn("source_src", F.coalesce("source_node", "src")).drop("source_node")
    else:
        mine = mine.withColumn("source_src", F.col("src"))
    theirs = _with_ns(source_edges).select(F.col("src").alias("source_src"), "dst", F.col("ns").alias("ns_source"))
    differing = missing_from(mine, theirs, ["source_src", "dst", ("ns", "ns_source")])
    named = theirs.groupBy("source_src", "dst").agg(F.min("ns_source").alias("ns_source"))
    return attach(differing, named, ["source_src", "dst"], how="inner", unique=True).select(
        "src", "dst", "source_src", F.col("ns").alias("ns_new"), "ns_source"
    )


def derive_edges(outputs: DataFrame, inputs: DataFrame, scope: str | None = None) -> DataFrame:
    """Dependencies between flows: ``outputs`` (flow, name[, scope]) feed ``inputs`` (flow,
    name[, scope]) of the same name. An input that names a scope takes outputs of that scope
    only. Gives distinct (src, dst, name)."""
    theirs = outputs.select(F.col("flow").alias("src"), "name", *[F.col(s).alias("__scope") for s in as_list(scope)])
    mine = inputs.select(F.col("flow").alias("dst"), "name", *[F.col(s).alias("__asked") for s in as_list(scope)])
    theirs, mine = theirs.distinct(), mine.distinct()
    if not scope:
        return theirs.join(mine, "name").select("src", "dst", "name").distinct()
    scoped = theirs.join(mine.withColumnRenamed("__asked", "__scope"), ["name", "__scope"])
    free = theirs.select("src", "name").distinct().join(mine.where("__asked IS NULL"), "name")
    return scoped.select("src", "dst", "name").union(free.select("src", "dst", "name")).distinct()


def inherit_ns(new_edges: DataFrame, source_edges: DataFrame, replaces: DataFrame) -> DataFrame:
    """Edges of replacement nodes with the namespace their predecessor had towards the same
    child, else ``Default``. ``replaces`` (node, predecessor); of several predecessors with an
    edge to the child the smallest namespace is taken."""
    mine = new_edges.select("src", "dst").distinct()
    stands_for = replaces.select(F.col("node").alias("src"), F.col("predecessor").alias("__old"))
    theirs = _with_ns(source_edges).select(F.col("src").alias("__old"), "dst", "ns")
    had = (
        mine.join(stands_for, "src")
        .join(theirs, ["__old", "dst"])
        .groupBy("src", "dst")
        .agg(F.min("ns").alias("ns"))
    )
    judged = exists_in(mine, stands_for, "src")
    return judged.join(had, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce(F.col("ns"), F.lit(DEFAULT_NS)).alias("ns")
    )
