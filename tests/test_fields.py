"""Field lineage against a plain walk."""

import random
from collections import defaultdict

import pytest

from layerflow.operators.fields import absent_fields, chain_actions, field_lineage


def walk(edges, inputs, actions, removed):
    """What each step puts out: {(step, name): origins}, and the uses of absent columns."""
    nodes = {n for e in edges for n in e} | {s for s, _ in inputs} | {a[0] for a in actions}
    parents = defaultdict(set)
    for a, b in edges:
        parents[b].add(a)
    out, absent, done = {}, set(), []
    while len(done) < len(nodes):
        step = min(n for n in nodes if n not in done and all(p in done for p in parents[n]))
        done.append(step)
        have = defaultdict(set)
        for s, c in inputs:
            if s == step:
                have[c].add((s, c))
        for p in parents[step]:
            for name, origins in out[p].items():
                have[name] |= origins
        mine = [(n, s) for t, n, s in actions if t == step]
        gone = {n for t, n in removed if t == step}
        after = {n: o for n, o in have.items() if n not in gone and n not in {m for m, _ in mine}}
        for name, source in mine:
            after.setdefault(name, set())
            if source is not None:
                after[name] = after[name] | have.get(source, set())
                if source not in have:
                    absent.add((step, name, source))
        out[step] = {n: o or {(step, n)} for n, o in after.items()}
    return {(s, n, *o) for s, names in out.items() for n, origins in names.items() for o in origins}, absent


@pytest.mark.parametrize("seed", [1, 2])
def test_lineage_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    steps = [f"s{k:02}" for k in range(9)]
    edges = [(steps[rng.randrange(k)], steps[k]) for k in range(1, 9) for _ in range(rng.randint(0, 2))]
    names = ["a", "b", "c", "d"]
    inputs = [(steps[0], "a"), (steps[0], "b"), (steps[3], "c"), ("alone", "a")]
    actions = [(rng.choice(steps), rng.choice(names), rng.choice([*names, None])) for _ in range(9)]
    removed = [(rng.choice(steps), rng.choice(names)) for _ in range(5)]
    tables = [
        spark.createDataFrame(edges + edges[:2] + [(None, "s01")], "src string, dst string"),
        spark.createDataFrame(inputs + [(None, "x"), ("s00", None)], "step string, column string"),
        spark.createDataFrame(actions + actions[:2], "step string, name string, source string"),
        spark.createDataFrame(removed, "step string, name string"),
    ]
    origins, absent = walk(edges, inputs, actions, removed)
    assert set(map(tuple, field_lineage(*tables).collect())) == origins
    assert set(map(tuple, absent_fields(*tables).collect())) == absent


def test_ordered_actions_are_steps_of_their_own(spark):
    actions = spark.createDataFrame(
        [("m", 1, "x", "a"), ("m", 2, "y", "x"), ("m", 3, "z", "late"), ("m", 4, "late", "a")], "step string, position int, name string, source string"
    )
    edges = spark.createDataFrame([("in", "m"), ("m", "out")], "src string, dst string")
    inputs = spark.createDataFrame([("in", "a")], "step string, column string")
    none = spark.createDataFrame([], "step string, name string")
    named, whole = chain_actions(actions, edges)
    assert {tuple(r) for r in absent_fields(whole, inputs, named, none).collect()} == {("m#000000003", "z", "late")}
    found = {(r.name, r.origin_step, r.origin) for r in field_lineage(whole, inputs, named, none).collect() if r.step == "out"}
    assert found == {(n, "in", "a") for n in ("a", "x", "y", "late")} | {("z", "m#000000003", "z")}
    empty = field_lineage(edges.limit(0), inputs.limit(0), actions.limit(0), none)
    assert empty.count() == 0 and empty.columns == ["step", "name", "origin_step", "origin"]


def test_a_circle_of_steps_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    none = spark.createDataFrame([], "step string, name string")
    with pytest.raises(ValueError, match="cycle"):
        field_lineage(edges, none.withColumnRenamed("name", "column"), spark.createDataFrame([], "step string, name string, source string"), none)


def chain(spark):
    """Six steps in a row; every step makes a column, the second removes one."""
    edges = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(5)], "src string, dst string")
    inputs = spark.createDataFrame([("s0", "a"), ("s0", "b")], "step string, column string")
    actions = spark.createDataFrame([(f"s{k}", f"m{k}", "a" if k % 2 else "b") for k in range(6)], "step string, name string, source string")
    return edges, inputs, actions, spark.createDataFrame([("s1", "b"), ("s4", "m0")], "step string, name string")


def test_every_step_is_worked_out_once(spark, monkeypatch):
    """A wave takes the actions and removals of its own steps, and no step is done again."""
    from layerflow.operators import fields

    taken = []
    plain = fields._passed_on
    monkeypatch.setattr(fields, "_passed_on", lambda *tables: taken.append([t.count() for t in tables[1:]]) or plain(*tables))
    found = {tuple(r) for r in field_lineage(*chain(spark)).where("step = 's5'").collect()}
    assert found == {
        ("s5", "a", "s0", "a"), ("s5", "m1", "s0", "a"), ("s5", "m2", "s2", "m2"), ("s5", "m3", "s0", "a"),
        ("s5", "m4", "s4", "m4"), ("s5", "m5", "s0", "a"),
    }
    assert [sum(n) for n in zip(*taken, strict=True)] == [6, 8]


def test_absent_fields_carry_names_only(spark, monkeypatch):
    """No origins are written for uses of columns that are not there."""
    from layerflow.operators import fields

    paths = []
    plain = fields.scratch_path
    monkeypatch.setattr(fields, "scratch_path", lambda *args: paths.append(plain(*args)) or paths[-1])
    assert {tuple(r) for r in absent_fields(*chain(spark)).collect()} == {("s2", "m2", "b"), ("s4", "m4", "b")}
    assert paths and not any("origin" in spark.read.parquet(p).columns for p in paths)
