"""Similar values, sketches, digests and graph components against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from layerflow.operators.digests import digest_diff, digest_tree, differing_leaves, publish_digested
from layerflow.operators.graphs import condensed, connected_components, strong_components
from layerflow.operators.parity import value_diff
from layerflow.operators.sketches import DISTINCT_ERROR, column_profile, frequent_values, merge_profiles, profile_diff, read_profile
from layerflow.operators.spellings import group_similar, similar_pairs, similar_values
from layerflow.session import cut


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_similar_pairs_are_those_of_brute_force(spark, rows, distance):
    rng = random.Random(distance)
    words = sorted({"".join(rng.choice("abü") for _ in range(rng.randint(0, 7))) for _ in range(150)} | {"", "a"})
    table = spark.createDataFrame([(w,) for w in words + words[:9]] + [(None,)], "w string")
    found = similar_pairs(table, "w", distance)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = []
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if edits(a, b) <= distance:
                want.append((*sorted((a, b), key=lambda w: (len(w), w)), edits(a, b)))
    assert rows(found) == sorted(want, key=repr)


def test_spellings_become_one(spark, rows):
    words = ["Color"] * 3 + ["color", "Colour", "colur", None, "size", "sizes", "Width", ""]
    table = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    assert rows(similar_values(table, "w")) == sorted(
        [(w, "Color") for w in ("Color", "color", "Colour", "colur")] + [("size", "size"), ("sizes", "size")], key=repr
    )
    grouped = {r.id: r.w for r in group_similar(table, "w").collect()}
    assert [grouped[i] for i in range(11)] == ["Color"] * 6 + [None, "size", "size", "Width", ""]
    sounds = spark.createDataFrame([("Robert",), ("Robert",), ("Rupert",), ("Ashcraft",), ("7up",), (None,)], "w string")
    assert rows(similar_values(sounds, "w", by="pronunciation")) == [("Robert", "Robert"), ("Rupert", "Robert")]
    assert similar_values(table.limit(0), "w").count() == 0
    with pytest.raises(ValueError):
        similar_values(table, "w", by="look")


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, rows, seed):
    edges = random_graph(seed, 60, 35) + [(None, 1), (2, None), (7, 7), (500, 500)] + [(k, k + 1) for k in range(100, 140)]
    up = {n: n for e in edges if None not in e for n in e}

    def top(n):
        return n if up[n] == n else top(up[n])

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    table = spark.createDataFrame(edges, "a int, b int")
    assert rows(connected_components(table)) == sorted(((n, top(n)) for n in up), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, rows, seed):
    edges = random_graph(seed, 30, 42) + [(40, 41), (41, 42), (42, 40), (42, 43), (44, 44), (50, 51), (None, 50)]
    nodes = {n for e in edges for n in e if n is not None}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [b for a, b in edges if a == n]
        while todo:
            x = todo.pop()
            if x is not None and x not in reach[n]:
                reach[n].add(x)
                todo += [b for a, b in edges if a == x]
    groups = {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}
    table = spark.createDataFrame(edges, "a int, b int")
    found = strong_components(table)
    assert rows(found) == sorted(((n, min(g), len(g)) for n, g in groups.items()), key=repr)
    between = {(min(groups.get(a, {a})), min(groups.get(b, {b}))) for a, b in edges if a is not None}
    assert rows(condensed(table, found)) == sorted(((a, b) for a, b in between if a != b), key=repr)
    assert strong_components(table.limit(0)).count() == 0


def test_profiles_merge_and_stay_within_their_error(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    parts = [column_profile(lines.where(c)) for c in ("l_orderkey % 3 = 0", "l_orderkey % 3 <> 0")]
    stored = [cut(p) for p in parts]
    merged = {r.column: r for r in read_profile(merge_profiles(*stored)).collect()}
    whole = {r.column: r for r in read_profile(column_profile(lines)).collect()}
    for name in lines.columns:
        exact = lines.agg(F.countDistinct(name), F.min(name).cast("string"), F.max(name).cast("string"), F.count_if(F.col(name).isNull())).first()
        for got in (merged[name], whole[name]):
            assert (got["min"], got["max"], got["nulls"], got["rows"]) == (*exact[1:], 6000)
            assert abs(got["distinct"] - exact[0]) <= max(1, 4 * DISTINCT_ERROR * exact[0])
    prices = sorted(r[0] for r in lines.select("l_extendedprice").collect())
    for q, value in zip((0.05, 0.25, 0.5, 0.75, 0.95), merged["l_extendedprice"].quantiles):
        rank = sum(p <= value for p in prices) / len(prices)
        assert abs(rank - q) < 0.02
    plan = profile_diff(*stored)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_profile_edges(spark, rows):
    odd = spark.createDataFrame([(None, [1], float("nan"), "a"), (2, None, None, None)], "i int, l array<int>, d double, `x.y` string")
    got = {r.column: r for r in read_profile(column_profile(odd)).collect()}
    assert (got["i"].nulls, got["i"].distinct, got["l"].nulls, got["l"].distinct, got["x.y"].nulls) == (1, 1, 1, None, 1)
    none = {r.column: r for r in read_profile(column_profile(odd.limit(0))).collect()}
    assert (none["i"].rows, none["i"].nulls, none["i"].distinct, none["i"].min, none["i"].quantiles) == (0, 0, 0, None, None)
    diff = {r.column: r.same for r in profile_diff(column_profile(odd), column_profile(odd.drop("d").withColumn("i", F.lit(5)))).collect()}
    assert diff == {"i": False, "l": True, "d": False, "x.y": True}
    assert rows(frequent_values(spark.createDataFrame([("b",), ("a",), ("a",), ("c",), (None,)], "v string"), "v", 2)) == [("a", 2), ("b", 1)]


def test_digests_find_changed_rows_in_their_leaves(spark, data, tmp_path, rows):
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 33, 1.0).otherwise(F.col("o_totalprice")))
    paths = [str(tmp_path / p) for p in ("a", "b", "c")]
    publish_digested(orders, paths[0], "o_orderkey", leaves=64, fanout=4)
    publish_digested(orders.repartition(5).orderBy("o_custkey").select("o_orderstatus", *orders.columns[:3]), paths[1], "o_orderkey", 64, 4)
    assert digest_diff(spark, paths[0], paths[1], "o_orderkey", fanout=4).count() == 0
    publish_digested(changed.where("o_orderkey <> 5").unionByName(orders.where("o_orderkey = 7")), paths[2], "o_orderkey", 64, 4)
    found = digest_diff(spark, paths[0], paths[2], "o_orderkey", fanout=4)
    assert rows(found) == rows(value_diff(orders, spark.read.parquet(f"{paths[2]}/rows/data").drop("__leaf", "write"), "o_orderkey"))
    assert {r.status for r in found.collect()} == {"differs", "only_a", "repeated_key"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [__leaf") == plan.count("PartitionFilters: [") > 0
    trees = [digest_tree(df, "o_orderkey", 64, 4) for df in (orders, changed)]
    assert len(differing_leaves(*trees, 4)) == 1
    assert differing_leaves(trees[0], digest_tree(orders.limit(0), "o_orderkey", 64, 4), 4)
    with pytest.raises(ValueError, match="publish it again"):
        digest_diff(spark, paths[0], str(tmp_path / "none"), "o_orderkey")
