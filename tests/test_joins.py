import pytest
from pyspark.sql import functions as F

from layerflow import (
    attach,
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
    self_union,
    union_mapped,
)


@pytest.fixture
def left(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")


@pytest.fixture
def right(spark):
    return spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, v string")


def test_join_names_and_kinds(left, right, rows):
    assert join(left, right, "k").columns == ["k", "v", "v-1"]
    assert rows(join(left, right, "k", "inner")) == [(1, "a", "x"), (1, "b", "x")]
    full = rows(join(left, right, "k", "full"))
    assert (3, None, "y") in full and (None, "d", None) in full and (None, None, "z") in full and len(full) == 6
    assert rows(join(left, right, "k", "right")) == sorted(
        [(1, "a", "x"), (1, "b", "x"), (3, None, "y"), (None, None, "z")], key=repr
    )
    with pytest.raises(ValueError, match="no column"):
        join(left, right, "nope")


def test_self_join_roles(left, rows):
    got = self_join(left, "k")
    assert got.columns == ["k_l", "v_l", "k_r", "v_r"]
    assert got.count() == 5


def test_presence_and_nulls(left, right, rows):
    doubled = right.unionByName(right)
    assert rows(exists_in(left, doubled, "k")) == [(1, "a"), (1, "b")]
    assert rows(missing_from(left, doubled, "k")) == [(2, "c"), (None, "d")]
    assert missing_from(left, right.where("false"), "k").count() == 4


def test_keys_of_different_width_meet(spark, left, rows):
    wide = spark.createDataFrame([(1, 2.5), (7, 1.0)], "key bigint, x double")
    assert rows(exists_in(left, wide, [("k", "key")])) == [(1, "a"), (1, "b")]
    assert rows(missing_from(wide, left, [("key", "k")])) == [(7, 1.0)]
    grouped = wide.groupBy("key").agg(F.sum("x").alias("x"))
    assert rows(attach(left, grouped, [("k", "key")], how="inner", unique=True)) == [(1, "a", 2.5), (1, "b", 2.5)]
    assert rows(attach(left, wide, [("k", "key")], how="inner")) == [(1, "a", 2.5), (1, "b", 2.5)]
    as_double = wide.select(F.col("key").cast("double").alias("key"))
    assert rows(exists_in(left, as_double, [("k", "key")])) == [(1, "a"), (1, "b")]


def test_attach_checks_and_keeps_rows(spark, left, right, rows):
    lookup = right.select("k", F.col("v").alias("w"))
    assert rows(attach(left, lookup, "k", found="hit")) == sorted(
        [(1, "a", "x", True), (1, "b", "x", True), (2, "c", None, False), (None, "d", None, False)], key=repr
    )
    with pytest.raises(Exception, match="several rows for one key"):
        attach(left, lookup.unionByName(lookup), "k").collect()
    # the check holds even when no added column is read
    with pytest.raises(Exception, match="several rows for one key"):
        attach(left, lookup.unionByName(lookup), "k").select("v").collect()


@pytest.mark.parametrize(
    ("keys_left", "keys_right", "expected"),
    [([1, 2], [1, 2], "1:1"), ([1], [1, 1], "1:N"), ([1, 1], [1], "N:1"), ([1, 1], [2, 2], "N:N"), ([], [1], "unknown"), ([None, None, 1], [1], "1:1")],
)
def test_cardinality(spark, keys_left, keys_right, expected):
    sides = [spark.createDataFrame([(k,) for k in ks], "k int") for ks in (keys_left, keys_right)]
    assert join_cardinality(*sides, "k").first()["cardinality"] == expected


def test_checked_join_lists_breaking_keys(left, right, rows):
    joined, broken = checked_join(left, right, "k", "left", "1:1")
    assert joined.count() == 4
    assert rows(broken) == [("left", 1, 2)]
    assert checked_join(left, right, "k", "left", "N:1")[1].count() == 0
    assert checked_join(left, right, "k", "left", "N:N")[1].count() == 0
    # a repeated key without partner breaks nothing
    assert checked_join(left, right.where("k = 3"), "k", "left", "1:1")[1].count() == 0
    with pytest.raises(ValueError):
        checked_join(left, right, "k", "left", "2:1")


def test_match_falls_back_on_null_keys_only(spark, rows):
    mine = spark.createDataFrame([(1, "L1", "n1"), (2, None, "n1"), (3, "gone", "n1"), (4, None, "zz")], "i int, luid string, name string")
    theirs = spark.createDataFrame([("L1", "n1"), ("L2", "n1")], "luid string, name string")
    got = match_with_fallback(mine, theirs, "luid", "name")
    assert rows(got.select("i", "matched_by", "match_luid")) == [
        (1, "luid", "L1"), (2, "name", "L1"), (2, "name", "L2"), (3, None, None), (4, None, None),
    ]


def test_resolve_names(spark, rows):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    catalog = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("z", 4)], "name string, id int")
    assert rows(resolve_names(names, catalog)) == [("a", 1, 1), ("b", 2, 2), ("b", 2, 3), ("c", 0, None)]
    resolved, ambiguous = resolve_names(names, catalog, strict=True)
    assert resolved.count() == 4 and rows(ambiguous) == [("b", 2)]


def test_fill_never_overwrites(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "kept"), (None, None)], "k int, v string")
    lookup = spark.createDataFrame([(1, "one"), (2, "two"), (None, "null")], "k int, v string")
    assert rows(fill_from_lookup(df, lookup, "k", "v")) == sorted([(1, "one"), (2, "kept"), (None, None)], key=repr)


def test_lookup_chain_has_no_fallback_past_a_wrapper(spark, rows):
    df = spark.createDataFrame([("w1",), ("w2",), ("b2",), ("nope",), (None,)], "k string")
    wrapper = spark.createDataFrame([("w1", "b1"), ("w2", "lost")], "wk string, wb string")
    base = spark.createDataFrame([("b1", "one"), ("b2", "two")], "bk string, name string")
    got = lookup_chain(df, wrapper, base, "k", "wk", "wb", "bk").select("k", "name", "via")
    assert rows(got) == sorted(
        [("w1", "one", "wrapped"), ("w2", None, None), ("b2", "two", "direct"), ("nope", None, None), (None, None, None)], key=repr
    )


def test_union_fills_and_names(spark, left, right, rows):
    got = union_mapped({"l": left, "r": right.withColumnRenamed("v", "other")}, {"r": {"k": "key"}})
    assert set(got.columns) == {"k", "v", "Table Names", "key", "other"}
    assert got.where("`Table Names` = 'r'").count() == 3
    twice = self_union(left, lambda d: d.where("k = 1"), lambda d: d.where("k = 2"))
    assert twice.count() == 3
    with pytest.raises(ValueError, match="no column"):
        union_mapped({"l": left}, {"l": {"nope": "x"}})


def test_big_joins_are_not_broadcast_by_hint(spark, data):
    """Nothing in the joins forces a broadcast: with the threshold off none is planned."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders, lines = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "lineitem"))
        for df in (
            join(lines, orders, [("l_orderkey", "o_orderkey")]),
            exists_in(orders, lines, [("o_orderkey", "l_orderkey")]),
            attach(lines, orders, [("l_orderkey", "o_orderkey")]),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
