"""Walks over random graphs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from layerflow import (
    bfs_levels,
    bridge,
    derive_edges,
    edge_diff,
    inherit_ns,
    lineage_closure,
    node_roles,
    reachable,
    waves,
)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_edges(seed, nodes=24, n=40, acyclic=True):
    rng = random.Random(seed)
    edges = set()
    while len(edges) < n:
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        if a != b and (not acyclic or a < b):
            edges.add((f"n{min(a, b) if acyclic else a:02}", f"n{max(a, b) if acyclic else b:02}"))
    return sorted(edges)


def children(edges):
    out = {}
    for e in edges:
        out.setdefault(e[0], []).append(e[1:])
    return out


def reach(edges, seed):
    seen, todo, kids = set(), [seed], children(edges)
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [k[0] for k in kids.get(at, [])]
    return seen


@pytest.mark.parametrize("acyclic", [True, False])
def test_reachable_and_levels(spark, rows, acyclic):
    edges = random_edges(3, acyclic=acyclic)
    df = frame(spark, edges, "src string, dst string")
    seeds = ["n00", "n05", "lonely"]
    got = rows(reachable(df, frame(spark, [(s,) for s in seeds], "s string")))
    assert got == sorted([(s, n) for s in seeds for n in reach(edges, s)], key=repr)
    levels, front = {}, set(seeds)
    depth = 0
    while front:
        levels |= {n: depth for n in front}
        front = {k[0] for n in front for k in children(edges).get(n, [])} - levels.keys()
        depth += 1
    nodes = sorted({n for e in edges for n in e} | {"lonely", "apart"})
    got = dict(rows(bfs_levels(df, frame(spark, [(n,) for n in nodes], "n string"), frame(spark, [(s,) for s in seeds], "s string"))))
    assert got == {n: levels.get(n) for n in nodes}


def test_long_chain_is_rewritten_on_the_way(spark, rows):
    edges = [(i, i + 1) for i in range(24)]
    got = rows(waves(frame(spark, edges, "src int, dst int")))
    assert got == sorted([(i, i) for i in range(25)], key=repr)


def test_waves_are_longest_paths_and_cycles_raise(spark, rows):
    edges = random_edges(5)
    depth = {}
    for n in sorted({n for e in edges for n in e}):
        depth[n] = max([depth[s] + 1 for s, d in edges if d == n], default=0)
    assert dict(rows(waves(frame(spark, edges, "src string, dst string")))) == depth
    with pytest.raises(ValueError, match="cycle"):
        waves(frame(spark, [("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string"))
    assert waves(frame(spark, [], "src string, dst string")).count() == 0


def test_waves_of_long_chains_take_few_rounds(spark, rows, monkeypatch):
    """Tables written grow with the logarithm of a chain, and edges into one node do not count."""
    from layerflow.operators import lineage

    written = []
    monkeypatch.setattr(lineage, "cut", lambda df, cut=lineage.cut: written.append(1) or cut(df))
    chain = [(i, i + 1) for i in range(40)]
    got = rows(waves(frame(spark, [*chain, *chain, *[(i, 99) for i in range(41)]], "src int, dst int")))
    assert got == sorted([*[(i, i) for i in range(41)], (99, 41)], key=repr)
    assert len(written) < 20


@pytest.mark.parametrize("edges", [[(1, 1)], [(1, 2), (2, 3), (3, 4), (4, 1)], [(0, 1), (1, 2), (2, 1)], [(0, 1), (9, 1), (1, 2), (2, 1), (2, 3)]])
def test_waves_raise_on_circles_of_any_kind(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        waves(frame(spark, edges, "src int, dst int"))


def test_node_roles(spark):
    edges = frame(spark, [("a", "c"), ("b", "c"), ("c", "d"), ("c", "e")], "src string, dst string")
    nodes = frame(spark, [(n,) for n in "abcdex"], "node string")
    got = {r["node"]: r for r in node_roles(edges, nodes).collect()}
    assert set(got) == set("abcdex")
    assert got["a"]["is_source"] and got["d"]["is_sink"] and got["x"]["is_isolated"]
    assert got["c"]["is_merge"] and got["c"]["is_branch"] and (got["c"]["n_in"], got["c"]["n_out"]) == (2, 2)


def expected_bridges(edges, keep, outputs):
    kids = children(edges)
    parents = {}
    for _, dst, _ in edges:
        parents[dst] = parents.get(dst, 0) + 1
    out = set()
    for src, dst, ns in edges:
        if src not in keep:
            continue
        if dst in keep:
            out.add((src, dst, ns, dst, ns, "kept"))
            continue
        hits, todo, seen = set(), [(dst, False)], set()
        while todo:
            at, merged = todo.pop()
            if (at, merged) in seen or at in outputs:
                continue
            seen.add((at, merged))
            merged = merged or parents.get(at, 0) > 1
            for to, via in kids.get(at, []):
                if to in keep:
                    hits.add((to, via, merged))
                else:
                    todo.append((to, merged))
        targets = {h[:2] for h in hits}
        if not targets:
            out.add((src, dst, ns, None, None, "dropped"))
        elif len(targets) > 1:
            out.add((src, dst, ns, None, None, "ambiguous"))
        elif any(h[2] for h in hits):
            out.add((src, dst, ns, None, None, "merge_point"))
        else:
            out.add((src, dst, ns, *next(iter(targets)), "bridged"))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_bridge_over_random_graphs(spark, seed):
    rng = random.Random(100 + seed)
    acyclic = seed % 2 == 0
    base = random_edges(seed, nodes=30, n=24 + 4 * seed, acyclic=acyclic)
    edges = [(a, b, rng.choice(["Default", "L", "R"])) for a, b in base]
    nodes = sorted({n for e in edges for n in e[:2]})
    keep = set(rng.sample(nodes, len(nodes) // 3))
    outputs = set(rng.sample(sorted(set(nodes) - keep), 2))
    got = bridge(
        frame(spark, edges, "src string, dst string, ns string"),
        frame(spark, [(k,) for k in keep], "node string"),
        frame(spark, [(o,) for o in outputs], "node string"),
    )
    assert {tuple(r) for r in got.collect()} == expected_bridges(edges, keep, outputs)


def test_bridge_carries_the_last_namespace_and_sees_circles(spark, rows):
    edges = frame(
        spark,
        [("k1", "x", "in"), ("x", "y", "mid"), ("y", "k2", None), ("k1", "loop", "Default"), ("loop", "pool", "Default"), ("pool", "loop", "Default")],
        "src string, dst string, ns string",
    )
    keep = frame(spark, [("k1",), ("k2",)], "node string")
    assert rows(bridge(edges, keep)) == [
        ("k1", "loop", "Default", None, None, "dropped"), ("k1", "x", "in", "k2", "Default", "bridged"),
    ]


def test_closure(spark, rows):
    source = frame(spark, [("i1", "a"), ("a", "j"), ("i2", "b"), ("b", "j"), ("j", "out")], "src string, dst string")
    new = frame(spark, [("p1", "a"), ("p1", "b"), ("b", "j"), ("p3", "new"), ("new", "out")], "src string, dst string")
    inputs = frame(spark, [("p1", "i1"), ("p3", None), ("p4", "i2")], "input string, source string")
    # b hangs on the wrong input; j is fed by p1 through b, and i1 is its ancestor; out has no ancestor input
    assert rows(lineage_closure(new, source, inputs)) == [("b",), ("out",)]
    more = inputs.unionByName(frame(spark, [("p1", "i2"), ("p3", "j")], "input string, source string"))
    assert lineage_closure(new, source, more).count() == 0
    assert rows(lineage_closure(new, source, more, frame(spark, [("i2",)], "node string"))) == [("i2",)]


def test_closure_of_many_inputs_with_circles(spark):
    """More inputs than bits of a number, circles in both graphs, against plain walks."""
    rng = random.Random(8)
    names = [f"n{i}" for i in range(60)]
    source = sorted({(rng.choice(names), rng.choice(names)) for _ in range(70)})
    new = sorted({(rng.choice(names), rng.choice(names)) for _ in range(50)} | {(f"in{i}", rng.choice(names)) for i in range(200)})
    inputs = [(f"in{i}", rng.choice([*names, None, "elsewhere"])) for i in range(200) for _ in range(rng.randint(1, 2))]

    def walk(edges, start):
        found, todo = {start}, [start]
        while todo:
            at = todo.pop()
            fresh = {b for a, b in edges if a == at} - found
            found |= fresh
            todo += fresh
        return found

    reached = {i: walk(new, i) for i, _ in inputs}
    below = {s: walk(source, s) for _, s in inputs if s is not None}
    closed = {n for i, s in inputs if s is not None for n in reached[i] & below[s]}
    judged = {n for e in new for n in e} & {n for e in source for n in e}
    got = lineage_closure(
        frame(spark, new, "src string, dst string"), frame(spark, source, "src string, dst string"), frame(spark, inputs, "input string, source string")
    )
    assert sorted(r.node for r in got.collect()) == sorted(judged - closed)
    assert judged - closed and judged & closed


def test_edge_diff(spark, rows):
    source = frame(spark, [("a", "j", "Left"), ("b", "j", "Right"), ("c", "d", None)], "src string, dst string, ns string")
    new = frame(
        spark,
        [("p", "j", None), ("b", "j", "Right"), ("c", "d", "Default"), ("x", "y", "Left"), ("b", "d", "Left"), ("a", "j", "Odd")],
        "src string, dst string, ns string",
    )
    subst = frame(spark, [("p", "a")], "node string, source_node string")
    bridged = frame(spark, [("a", "j", "Odd")], "src string, dst string, ns string")
    assert rows(edge_diff(new, source, subst, bridged)) == [("p", "j", "a", "Default", "Left")]
    assert rows(edge_diff(new, source)) == [("a", "j", "a", "Odd", "Left")]


def test_derived_and_inherited_edges(spark, rows):
    outputs = frame(spark, [("f1", "t", "p1"), ("f2", "t", "p2")], "flow string, name string, project string")
    inputs = frame(spark, [("g1", "t", "p2"), ("g2", "t", None), ("g3", "u", None)], "flow string, name string, project string")
    assert rows(derive_edges(outputs, inputs, "project")) == [("f1", "g2", "t"), ("f2", "g1", "t"), ("f2", "g2", "t")]
    assert derive_edges(outputs, inputs).count() == 4
    source = frame(spark, [("a", "j", "Left"), ("b", "j", "Right")], "src string, dst string, ns string")
    new = frame(spark, [("p", "j"), ("p", "fresh"), ("b", "j")], "src string, dst string")
    replaces = frame(spark, [("p", "a"), ("p", "zz")], "node string, predecessor string")
    assert rows(inherit_ns(new, source, replaces)) == [("p", "fresh", "Default"), ("p", "j", "Left")]


def test_rounds_are_written_tables(spark):
    """Cut tables have a known size and can be pruned; nothing is kept on single executors."""
    from layerflow.session import cut

    df = cut(spark.range(0, 1000).withColumn("x", F.lit("wide")))
    plan = df.select("id")._jdf.queryExecution().optimizedPlan()
    assert "Relation" in plan.toString()
    assert 0 < int(str(plan.stats().sizeInBytes())) < 10**6
