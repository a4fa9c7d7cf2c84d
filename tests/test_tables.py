import datetime as dt

import pytest
from pyspark.sql import functions as F

from layerflow import (
    add_missing_rows,
    aggregate,
    classify_max,
    fill_dates,
    fill_sequence,
    fixed,
    metric,
    pivot,
    recompute_check,
    rollup_grain,
    script,
    unpivot,
)


@pytest.fixture
def sales(spark):
    return spark.sql(
        """SELECT * FROM VALUES ('a', DATE'2024-01-30', 1, 10), ('a', DATE'2024-02-02', 2, 20), ('a', DATE'2024-04-01', 3, 5),
           ('b', DATE'2024-02-10', 4, 7), (NULL, DATE'2024-02-11', 5, 1) AS t(k, d, id, v)"""
    )


def test_fixed_counts_nulls_as_a_group(sales, rows):
    assert rows(fixed(sales, "k", "sum", "v", "s").select("id", "s")) == [(1, 35), (2, 35), (3, 35), (4, 7), (5, 1)]


def test_aggregate_forms(sales, rows):
    assert rows(aggregate(sales, [], {"v": "sum", "n": ("count", "id")})) == [(43, 5)]
    with pytest.raises(ValueError, match="unknown aggregate"):
        aggregate(sales, "k", {"v": "mode"})


def test_recompute_check_finds_stale_groups(sales, rows):
    stored = aggregate(sales, "k", {"v": "sum"})
    assert recompute_check(stored, sales, "k", {"v": "sum"}).count() == 0
    stale = stored.withColumn("v", F.when(F.col("k") == "b", 8).otherwise(F.col("v")).cast("bigint"))
    assert rows(recompute_check(stale, sales, "k", {"v": "sum"}).select("k", "status")) == [("b", "differs")]
    assert recompute_check(stale, sales, "k", {"v": "sum"}, tol=1).count() == 0


def test_classify_takes_the_most_downstream_class(spark, rows):
    steps = spark.createDataFrame([("f", "rename"), ("f", "join"), ("g", "rename"), ("h", "odd")], "flow string, step string")
    rules = spark.createDataFrame([("rename", "staging", 1), ("join", "intermediate", 2)], "step string, class string, rank int")
    assert rows(classify_max(steps, rules, "step", "flow")) == [("f", "intermediate", 2), ("g", "staging", 1), ("h", None, None)]


def test_pivot_and_unpivot_are_inverse(spark, rows):
    long = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, "x", 7), (2, "y", None)], "id int, name string, value int")
    wide = pivot(long, "id", "name", ["x", "y"], {"v": ("max", "value")})
    assert wide.columns == ["id", "x", "y"]
    assert rows(unpivot(wide, "id", ["x", "y"])) == rows(long)


def test_fill_dates_months_and_carry(sales, rows):
    got = fill_dates(sales, "k", "d", "month", fill="carry")
    new = rows(got.where("d = DATE'2024-03-01'"))
    assert new == [("a", dt.date(2024, 3, 1), 2, 20)]
    assert got.count() == 6
    empty = fill_dates(sales, "k", "d", "day")
    assert empty.where("k = 'a' AND v IS NULL").count() == (dt.date(2024, 4, 1) - dt.date(2024, 1, 30)).days - 2
    assert fill_dates(sales.where("false"), "k", "d", "day").count() == 0
    assert fill_dates(sales, [], "d", "day").select("d").distinct().count() == 63
    with pytest.raises(ValueError):
        fill_dates(sales, "k", "d", "day", fill="guess")


def test_fill_keeps_several_rows_of_one_step(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 01:10:00', 1), (TIMESTAMP_NTZ'2024-01-01 01:50:00', 2), (TIMESTAMP_NTZ'2024-01-01 04:00:00', 3) AS t(ts, v)")
    got = rows(fill_dates(df, [], "ts", "hour", fill="carry"))
    assert len(got) == 5
    assert (dt.datetime(2024, 1, 1, 2), 2) in got and (dt.datetime(2024, 1, 1, 3), 2) in got


def test_fill_sequence_bounds_and_stride(spark, rows):
    df = spark.createDataFrame([("a", 4, 1.0), ("a", 10, 2.0), ("b", 6, 3.0)], "k string, n int, v double")
    got = rows(fill_sequence(df, "k", "n", step=2, lo=2, hi=12).select("k", "n"))
    assert got == sorted([(k, n) for k in "ab" for n in (2, 4, 6, 8, 10, 12)], key=repr)
    assert rows(fill_sequence(df, "k", "n", step=2, fill="carry").where("n = 8")) == [("a", 8, 1.0)]


def test_missing_combinations(spark, rows):
    df = spark.createDataFrame([("a", 1, 9), ("b", 2, 8), ("b", None, 7), (None, 1, 6)], "k string, c int, v int")
    found = add_missing_rows(df, "k", "c", [1, 2, None, 2])
    assert {("a", 2, None), ("b", 1, None), (None, 2, None)} <= set(rows(found))
    assert found.count() == 7
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert add_missing_rows(df, "k", "c", []).count() == 4
    assert add_missing_rows(df, "k", "c", range(20_000)).count() == 4 + 3 * 20_000 - 3
    assert len(rows(add_missing_rows(df, "k", "c", values=[1, 2, 3]))) == 10


def test_script_sees_only_the_named_columns(spark, sales, rows):
    def double(pdf):
        assert list(pdf.columns) == ["id", "v"]
        return pdf.assign(v=pdf["v"] * 2)

    assert rows(script(sales, double, "id int, v int", ["id", "v"]))[0] == (1, 20)


def test_metric_comparisons_follow_the_calendar(sales, rows):
    got = metric(sales, "v", "sum", "d", "month", dims="k", running_total=True, compare="previous")
    assert got.columns == ["k", "period", "value", "running_total", "previous", "change", "ratio"]
    assert rows(got.where("k = 'a'")) == [
        ("a", dt.date(2024, 1, 1), 10, 10, None, None, None),
        ("a", dt.date(2024, 2, 1), 20, 30, 10, 10, 2.0),
        ("a", dt.date(2024, 4, 1), 5, 35, None, None, None),  # no March to compare with
    ]
    zero = metric(sales.withColumn("v", F.lit(0)), "v", "sum", "d", "month", dims="k", compare="previous")
    assert zero.where("ratio IS NOT NULL").count() == 0
    assert metric(sales, "v", "sum", "d", "year", filters=["k = 'a'", "v > 5"]).first()["value"] == 30
    with pytest.raises(ValueError, match="not additive"):
        metric(sales, "v", "countd", "d", "month", running_total=True)


def test_rollup_has_map_side_combine(sales):
    plan = rollup_grain(sales, "d", "month", "k", {"v": "sum"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
