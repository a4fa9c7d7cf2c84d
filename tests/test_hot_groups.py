"""A third of all rows under one key: results stay whole and no task gets the group."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from layerflow import (
    aggregate,
    attach,
    exists_in,
    fill_dates,
    fill_sequence,
    fixed,
    join,
    match_with_fallback,
    missing_from,
    renumber,
    row_number,
    script_by,
    shown_tokens,
    unknown_tokens,
    upsert_latest,
    value_diff,
)
from layerflow.operators.windows import accumulate

N = 6000


@pytest.fixture
def hot(spark):
    """Key 0 holds a third of the rows; key 1 is null; the rest are spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 1, F.col("id") % 50 + 1)
    return spark.range(0, N, 1, 6).select(
        key.alias("k"), F.col("id"), ((F.col("id") * 7919) % 997).cast("double").alias("v")
    )


def test_row_number_splits_hot_groups(spark, hot, conf, rows):
    plain = rows(row_number(hot, "k", ["v", "id"], "n"))
    conf(spark__layerflow__maxGroupRows=100)
    split = row_number(hot, "k", ["v", "id"], "n")
    assert rows(split) == plain
    assert len(plain) == N


def test_row_number_descending_and_ungrouped(hot, conf, rows):
    expected = hot.toPandas().sort_values(["v", "id"], ascending=[False, True])
    expected["n"] = range(1, N + 1)
    got = row_number(hot, [], [("v", "desc"), "id"], "n")
    assert rows(got.select("id", "n")) == sorted(zip(expected["id"], expected["n"], strict=True), key=repr)


def test_largest_task_is_bounded(spark, hot, conf):
    """The hot group is cut into pieces: rows of one piece stay near the even share."""
    conf(spark__layerflow__maxGroupRows=100)
    from layerflow.operators import windows

    placed = {}
    real = windows.cut

    def watch(df):
        out = real(df)
        if "__piece" in df.columns:
            placed["largest"] = out.groupBy("__piece").count().agg(F.max("count")).first()[0]
            placed["all"] = out.count()
        return out

    windows.cut = watch
    try:
        row_number(hot, "k", ["v", "id"], "n").count()
    finally:
        windows.cut = real
    assert placed["largest"] < placed["all"] / 3


def test_renumber_after_filter(hot, conf, rows):
    numbered = row_number(hot, "k", ["v", "id"], "n")
    plain = rows(renumber(numbered.where("id % 2 = 0"), "k", "n", "n"))
    conf(spark__layerflow__maxGroupRows=100)
    assert rows(renumber(numbered.where("id % 2 = 0"), "k", "n", "n")) == plain


@pytest.mark.parametrize("by", [["k"], []])
def test_median_of_hot_groups_is_exact(hot, conf, rows, by):
    aggs = {"mid": ("median", "v"), "n": ("count", "id"), "d": ("countd", "v")}
    plain = rows(aggregate(hot, by, aggs))
    conf(spark__layerflow__maxGroupRows=100)
    assert rows(aggregate(hot, by, aggs)) == plain


def test_median_ignores_nulls(spark, conf, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None)], "k string, v double")
    conf(spark__layerflow__maxGroupRows=1)
    assert rows(aggregate(df, "k", {"v": "median"})) == [("a", 2.5), ("b", None)]


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skew_conf(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor=1.5,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB",
    )


def test_fixed_joins_back_with_skew_handling(hot, skew_conf):
    out = fixed(hot, "k", "max", "v", "top")
    assert "SortMergeJoin(skew=true)" in _final_plan(out)
    want = hot.toPandas().groupby("k", dropna=False)["v"].transform("max")
    assert sorted(out.toPandas()["top"]) == sorted(want)


def test_lookups_and_presence_checks_handle_skew(spark, hot, skew_conf):
    keys = spark.range(0, 40).select(F.col("id").cast("int").alias("key"), F.concat(F.lit("x"), "id").alias("label"))
    many = keys.unionByName(keys).select("key")
    ints = hot.withColumn("k", F.col("k").cast("int"))
    for out in (
        attach(ints, keys, [("k", "key")]),
        exists_in(ints, many, [("k", "key")]),
        missing_from(ints, many, [("k", "key")]),
    ):
        assert "skew=true" in _final_plan(out)


def test_plain_joins_handle_skew(spark, hot, skew_conf):
    ints = hot.withColumn("k", F.col("k").cast("int"))
    dims = spark.range(0, 60).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("x"), "id").alias("label"))
    out = join(ints, dims, "k", "left")
    assert "SortMergeJoin(skew=true)" in _final_plan(out)
    assert out.count() == N


@pytest.mark.parametrize("how", ["left", "right", "full", "inner"])
def test_outer_joins_split_the_filled_side(spark, hot, conf, rows, how):
    """A third of the right rows under one key: an outer join cannot split it by itself."""
    left = spark.range(0, 70).select(F.when(F.col("id") != 9, F.col("id")).alias("k"), (F.col("id") + 1).alias("w"))
    right = hot.where("k IS NULL OR k <> 20")
    plain = rows(join(left, right, "k", how))
    swapped = rows(join(right, left, "k", how))
    conf(spark__layerflow__maxGroupRows=100)
    assert rows(join(left, right, "k", how)) == plain
    assert rows(join(right, left, "k", how)) == swapped


def test_hot_filled_side_is_split_by_the_inner_join(spark, hot, conf, skew_conf):
    conf(spark__layerflow__maxGroupRows=500)
    left = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
    out = join(left, hot, "k", "left")
    assert "SortMergeJoin(skew=true)" in _final_plan(out)
    assert out.count() == left.toPandas().merge(hot.toPandas().dropna(), on="k", how="left").shape[0]


def test_name_matches_survive_hot_names(spark, conf, rows):
    mine = spark.range(0, 30).select("id", F.lit(None).cast("string").alias("luid"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"))
    theirs = spark.range(0, 300).select(F.concat(F.lit("L"), "id").alias("luid"), F.when(F.col("id") % 3 == 0, "n0").otherwise(F.concat(F.lit("m"), "id")).alias("name"))
    plain = rows(match_with_fallback(mine, theirs, "luid", "name"))
    conf(spark__layerflow__maxGroupRows=50)
    assert rows(match_with_fallback(mine, theirs, "luid", "name")) == plain
    assert len(plain) == 10 * 100 + 20


def test_copies_collapse_before_the_shuffle(spark):
    same = spark.range(0, 5000, 1, 4).select(F.lit("a").alias("x"), F.lit(1).alias("y"))
    out = value_diff(same, same.limit(4990))
    plan = _final_plan(out)
    assert "partial_count" in plan and out.first()["copies_a"] == 5000


def test_upsert_is_an_aggregate(hot):
    out = upsert_latest(hot.where("false"), hot, "k", "id")
    plan = _final_plan(out)
    assert "Window" not in plan and "partial_max" in plan
    assert out.count() == hot.select("k").distinct().count()


def test_token_ranking_is_limited_before_the_shuffle(spark):
    tokens = spark.range(0, 3003, 1, 4).select(
        F.when(F.col("id") < 3000, "flow").otherwise("other").alias("flow"), F.format_string("t%05d", "id").alias("token")
    )
    unknown = unknown_tokens(tokens, tokens.where("false"), "flow")
    assert unknown.count() == 3003
    out = shown_tokens(unknown, "flow")
    assert "WindowGroupLimit" in _final_plan(out)
    row = out.where("flow = 'flow'").first()
    assert row["n_unknown"] == 3000
    assert row["shown"].startswith("[t00000], [t00001]") and row["shown"].endswith("[t00007] (+2992)")


def test_script_by_never_gathers_a_group(spark, hot, conf):
    def sums(pdf):
        return pdf.groupby("k", as_index=False, dropna=False).agg(n=("id", "size"), total=("v", "sum"))

    def merge(pdf):
        return pdf.groupby("k", as_index=False, dropna=False).agg(n=("n", "sum"), total=("total", "sum"))

    conf(spark__sql__execution__arrow__maxRecordsPerBatch=64)
    typed = hot.withColumn("k", F.col("k").cast("double"))
    out = script_by(typed, "k", sums, merge, "k double, n bigint, total double").toPandas()
    want = typed.toPandas().groupby("k", dropna=False).agg(n=("id", "size"), total=("v", "sum")).reset_index()
    got = out.sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.sort_values("k").reset_index(drop=True))


def test_gap_search_in_chunks(spark, conf, rows, monkeypatch):
    from layerflow.operators import reshape

    days = spark.sql(
        "SELECT 'a' AS k, date_add(DATE'2024-01-01', CAST(id * id AS INT)) AS d, CAST(id AS INT) AS v FROM range(0, 40)"
    )
    whole = rows(fill_dates(days, "k", "d", "day", fill="carry"))
    assert len(whole) == 39 * 39 + 1
    monkeypatch.setattr(reshape, "CHUNK_STEPS", 7)
    assert rows(fill_dates(days, "k", "d", "day", fill="carry")) == whole


@pytest.mark.parametrize("most", [3, 10**9])
def test_running_sum_over_nulls_is_the_same_split_or_not(spark, conf, rows, most):
    values = [0, None, None, 0, None, None, 6, None, 1, None, None, None, 2]
    data = [("hot", i, v) for i, v in enumerate(values)] + [("late", 0, None), ("late", 1, None), ("late", 2, 5), ("late", 3, None)]
    df = spark.createDataFrame(data, "k string, id int, v int")
    conf(spark__layerflow__maxGroupRows=most)
    want, held = [], {}
    for k, i, v in data:
        held[k] = held.get(k) if v is None else (held.get(k) or 0) + v
        want.append((k, i, held[k]))
    assert rows(accumulate(df, ["k"], "id", "s", "v").select("k", "id", "s")) == sorted(want, key=repr)


def test_long_gaps_are_filled_in_bounded_runs(spark):
    df = spark.createDataFrame([("a", 0), ("a", 250_000), ("b", 5)], "k string, n bigint")
    got = fill_sequence(df, "k", "n", lo=-30_000, hi=300_000)
    counts = {r["k"]: (r["rows"], r["apart"]) for r in got.groupBy("k").agg(F.count("*").alias("rows"), F.countDistinct("n").alias("apart")).collect()}
    assert counts == {"a": (330_001, 330_001), "b": (330_001, 330_001)}
