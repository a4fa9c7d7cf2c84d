"""Components of graphs given as edge tables, by contraction.

Every round writes what it leaves to the shared folder; no node's edges are gathered, and the
number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.names import col
from layerflow.session import cut


def jump_to_roots(parents: DataFrame) -> DataFrame:
    """(node, up) with each node's parent, to (node, up) with the root it leads to. A root is
    its own parent or has no row. Paths halve in each round."""
    parents = cut(parents)
    while True:
        onward = parents.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
        moved = cut(parents.join(onward, "up", "left").select("node", F.coalesce("beyond", "up").alias("up"), (F.col("beyond") != F.col("up")).alias("went")))
        parents = moved.select("node", "up")
        if moved.where("went").isEmpty():
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected graph, with the smallest node of its
    component as the root. Edges with a null end are left out; direction, repeats and loops
    do not matter.

    Each node points to its smallest neighbour, or itself; the trees this makes become single
    nodes, named by their roots, and the edges between them are the next round's graph.
    """
    pairs = edges.select(col(a).alias("a"), col(b).alias("b")).where("a is not null and b is not null")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    labels = cut(labels)
    pairs = pairs.where("a <> b")
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        roots = jump_to_roots(least.select(F.col("a").alias("node"), F.least("a", "low").alias("up")))
        labels = cut(
            labels.join(roots.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        )
        left = pairs.join(roots.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        met = left.join(roots.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        pairs = cut(met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without edges into or out of them are taken away, round by
    round: what runs in no circle and leads from or to none goes first."""
    edges = cut(edges)
    before = edges.count()
    while before:
        heads, tails = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = cut(edges.join(heads, "a", "left_semi").join(tails, "b", "left_semi"))
        now = edges.count()
        if now == before:
            break
        before = now
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node, itself included."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    colours = cut(nodes.withColumn("colour", F.col("node")))
    changed = colours
    while True:
        sent = changed.join(edges.withColumnRenamed("a", "node"), "node").groupBy("b").agg(F.min("colour").alias("new"))
        met = cut(
            colours.join(sent.withColumnRenamed("b", "node"), "node", "left").select(
                "node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("fresh")
            )
        )
        colours, changed = met.select("node", "colour"), met.where("fresh").select("node", "colour")
        if changed.isEmpty():
            return colours


def strong_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component, n_members) for every node that lies on a circle: nodes that reach one
    another share a component, named by its smallest node. Nodes on no circle have no row; a
    loop is a circle of one. Edges with a null end are left out, repeats do not matter.

    Trimming takes away all nodes that lie on no circle's way. In what is left every node gets
    the smallest node that reaches it as its colour; backwards from each colour's own node,
    within the colour, all nodes of its component are found and taken out, and the rest goes
    through the next round. All colours are worked on at once.
    """
    pairs = edges.select(col(a).alias("a"), col(b).alias("b")).where("a is not null and b is not null").distinct()
    loops = cut(pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")))
    left, found = _trimmed(pairs.where("a <> b")), None
    while not left.isEmpty():
        colours = _coloured(left)
        inside = left.join(colours.select(F.col("node").alias("a"), F.col("colour").alias("of_a")), "a")
        inside = inside.join(colours.select(F.col("node").alias("b"), F.col("colour").alias("of_b")), "b")
        inside = cut(inside.where("of_a = of_b").select("a", "b", F.col("of_a").alias("colour")))
        reached = cut(colours.where("node = colour"))
        front = reached
        while not front.isEmpty():
            back = front.join(inside.select("a", F.col("b").alias("node")), "node").select(F.col("a").alias("node"), "colour").distinct()
            front = cut(back.join(reached.select("node"), "node", "left_anti"))
            reached = cut(reached.unionByName(front))
        # a colour's node alone, without a way back to it, is no circle
        sizes = reached.groupBy("colour").count().where("count > 1")
        whole = cut(reached.join(sizes.select("colour"), "colour", "left_semi").select("node", F.col("colour").alias("component")))
        found = whole if found is None else found.unionByName(whole)
        gone = reached.select("node")
        rest = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        left = _trimmed(rest)
    if found is None:
        found = loops
    else:
        found = found.unionByName(loops.join(found.select("node"), "node", "left_anti"))
    found = cut(found)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    return found.join(sizes, "component").select("node", "component", "n_members")


def condensed(edges: DataFrame, components: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The distinct edges between components, without circles: (a, b), where a node on no circle
    stands for itself."""
    pairs = edges.select(col(a).alias("a"), col(b).alias("b")).where("a is not null and b is not null").distinct()
    for end in ("a", "b"):
        names = components.select(F.col("node").alias(end), F.col("component").alias("of"))
        pairs = pairs.join(names, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    return pairs.where("a <> b").select("a", "b").distinct()
