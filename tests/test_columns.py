import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow import (
    action,
    add_column,
    add_row_unit,
    augment,
    cast,
    clean,
    filter_rows,
    fix_case,
    group_values,
    hide,
    limit_rows,
    read_csv,
    read_sql,
    rename,
    rename_back,
    replace_value,
    sample_rows,
    scan,
    split_column,
    trim_whitespace,
    value_filter,
)


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, "x", "p"), (2, None, "q"), (3, "y", None)], "a int, b string, c string")


def test_rename_runs_in_order(small):
    assert rename(small, [("a", "t"), ("t", "d")]).columns == ["d", "b", "c"]
    swapped = rename(small, [("a", "t"), ("b", "a"), ("t", "b")])
    assert swapped.columns == ["b", "a", "c"]
    assert swapped.first()["b"] == 1


def test_rename_refuses_doubles_and_unknown_names(small):
    with pytest.raises(ValueError, match="several columns"):
        rename(small, [("a", "b"), ("b", "z")])
    with pytest.raises(ValueError, match="no column"):
        rename(small, [("nope", "z")])


def test_rename_back_keeps_suffixes(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "harvest_week int, `harvest_week_北` int, orchard int, harvest int")
    got = rename_back(df, [("orchard", "果樹園"), ("harvest_week", "収穫週"), ("harvest", "h")])
    assert got.columns == ["収穫週", "収穫週_北", "果樹園", "h"]
    with pytest.raises(ValueError, match="several columns"):
        rename_back(df, [("orchard", "harvest")])


def test_cast_gives_null_or_fails(spark):
    df = spark.createDataFrame([("12", "x.5"), ("no", "1.5")], "a string, b string")
    got = cast(df, {"a": "integer", "b": "real"}).collect()
    assert [tuple(r) for r in got] == [(12, None), (None, 1.5)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast(df, {"a": "integer"}, on_error="fail").collect()


def test_augment_follows_the_mapping_rules(spark):
    schema = T.StructType(
        [
            T.StructField("raw1", T.StringType(), metadata={"caption": "Caption One"}),
            T.StructField("raw2", T.StringType()),
            T.StructField("raw3", T.StringType()),
            T.StructField("gen", T.StringType(), metadata={"isGenerated": True}),
        ]
    )
    df = spark.createDataFrame([("7", "b", "c", "g")], schema)
    got = augment(
        df,
        [
            {"op": "hide", "column_name": "[raw3]"},
            {"op": "rename", "column_name": "[raw3]", "to_caption": "still hidden"},
            {"op": "rename", "column_name": "[raw2]", "to_caption": "first"},
            {"op": "rename", "column_name": "[raw2]", "to_caption": "second"},
            {"op": "cast", "column_name": "[raw1]", "to_caption": "number", "to_datatype": "integer"},
            {"op": "rename", "column_name": "[Caption One]", "to_caption": "not by caption"},
        ],
    )
    assert got.columns == ["number", "second"]
    assert got.first()[0] == 7
    assert augment(df, []).columns == ["Caption One", "raw2", "raw3"]
    with pytest.raises(ValueError, match="no column operation"):
        augment(df, [{"op": "filter", "column_name": "[raw1]"}])


def test_names_with_dots_and_brackets(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `[c]` int")
    assert hide(rename(df, [("a.b", "x.y")]), "[c]").columns == ["x.y"]
    assert augment(df, [{"op": "hide", "column_name": "[a.b]"}]).columns == ["[c]"]


def test_value_filter_and_nulls(small, rows):
    assert [r[0] for r in rows(value_filter(small, "b", exclude=["x"]))] == [2, 3]
    assert [r[0] for r in rows(value_filter(small, "b", exclude=["x", None]))] == [3]
    assert [r[0] for r in rows(value_filter(small, "b", keep=["x", None]))] == [1, 2]
    assert [r[0] for r in rows(value_filter(small, "b", not_null=True))] == [1, 3]
    assert rows(value_filter(small, "b", keep=[])) == []


def test_group_values_by_small_and_large_mapping(spark, small, rows):
    assert {r[1] for r in rows(group_values(small, "b", {"x": "z"}))} == {"z", None, "y"}
    large = {f"k{i}": "v" for i in range(500)} | {"x": "z"}
    assert rows(group_values(small, "b", large)) == rows(group_values(small, "b", {"x": "z"}))
    numbers = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, n bigint")
    few, many = {5.0: 6, None: 1}, {5.0: 6, None: 1} | {float(i): i for i in range(1000, 1300)}
    assert rows(group_values(numbers, "n", few)) == rows(group_values(numbers, "n", many)) == [(1, 6), (2, None), (3, 7)]
    assert rows(group_values(numbers, "n", {})) == rows(numbers)
    double = spark.createDataFrame([("x", "1"), ("x", "2")], "s string, v string")
    with pytest.raises(Exception, match="several rows for one key"):
        group_values(small, "b", double).collect()


def test_split_trim_case_replace(spark):
    df = spark.createDataFrame([("a.b..c", " \t x y\n"), ("", "MIXED case"), (None, None)], "p string, q string")
    split = split_column(df, "p", ".", 4, "part").select("part_1", "part_2", "part_3", "part_4").collect()
    assert [tuple(r) for r in split] == [("a", "b", "", "c"), ("", None, None, None), (None,) * 4]
    assert [r[1] for r in trim_whitespace(df, "q").collect()] == ["x y", "MIXED case", None]
    assert [r[1] for r in fix_case(df, "q", "title").collect()][1:] == ["Mixed Case", None]
    assert [r[0] for r in replace_value(df, "p", None, "none").collect()] == ["a.b..c", "", "none"]
    assert replace_value(df, "p", ".", "-", exact=False).first()[0] == "a-b--c"


def test_clean_slices_compose_to_the_whole(small, rows):
    actions = [
        action(rename, [("b", "z")]),
        action(add_column, "n", "a * 2"),
        action(filter_rows, "n > 2"),
        action(hide, "c"),
    ]
    whole = rows(clean(small, actions))
    for cut in range(len(actions) + 1):
        first = clean(small, actions, indices=range(cut))
        assert rows(clean(first, actions, indices=range(cut, len(actions)))) == whole
    assert rows(clean(small, actions, indices=[2, 1, 0, 3])) == whole  # list order, not index order
    for bad in ([4], [-1]):
        with pytest.raises(IndexError):
            clean(small, actions, indices=bad)


def test_row_unit_and_limit(small, rows):
    assert add_row_unit(small).agg(F.sum("`Number of Rows`")).first()[0] == 3
    assert [r[0] for r in rows(limit_rows(small, 2, "a"))] == [1, 2]


def test_sampling_is_stable_under_repartitioning(spark, rows):
    df = spark.range(0, 4000)
    sample = rows(sample_rows(df, 0.25, seed=1, key="id"))
    assert rows(sample_rows(df.repartition(13), 0.25, seed=1, key="id")) == sample
    assert 850 < len(sample) < 1150
    assert rows(sample_rows(df, 0.25, seed=2, key="id")) != sample
    assert rows(sample_rows(df, 1.0, seed=2, key="id")) == rows(df)
    assert 0 < sample_rows(df, 0.1, seed=3).count() < 1000
    grouped = df.withColumn("g", F.col("id") % 2)
    assert sample_rows(grouped, {0: 1.0}, by="g", key="id").count() == 2000
    assert sample_rows(grouped, {0: 1.0}, by="g").count() == 2000


def test_sql_and_csv(spark, small, tmp_path):
    got = read_sql(spark, "SELECT a FROM {t} WHERE a >= :least ORDER BY a", {"least": 2}, t=small)
    assert [r[0] for r in got.collect()] == [2, 3]
    small.write.csv(str(tmp_path / "c"), header=True)
    back = read_csv(spark, str(tmp_path / "c"), "a INT, b STRING, c STRING")
    assert sorted(r[0] for r in back.collect()) == [1, 2, 3]


def test_periods_match_the_calendar(spark):
    from layerflow.functions.periods import GRAINS, period_start

    df = spark.sql(
        """SELECT ts FROM VALUES (TIMESTAMP_NTZ'1969-12-31 23:59:59.5'), (TIMESTAMP_NTZ'2024-02-29 13:45:10.25'),
           (TIMESTAMP_NTZ'2023-01-01 00:00:00'), (TIMESTAMP_NTZ'1901-05-05 05:05:05') AS t(ts)"""
    )
    got = df.select("ts", *[period_start(F.col("ts"), g).alias(g) for g in GRAINS]).collect()
    for r in got:
        day = r["ts"].date()
        assert r["day"] == day
        assert r["week"] == day - dt.timedelta(days=day.weekday())
        assert r["month"] == day.replace(day=1)
        assert r["quarter"] == day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1)
        assert r["year"] == day.replace(month=1, day=1)
        assert r["hour"] == r["ts"].replace(minute=0, second=0, microsecond=0)
        assert r["minute"] == r["ts"].replace(second=0, microsecond=0)
        assert r["second"] == r["ts"].replace(microsecond=0)


def test_scan_reaches_the_reader(spark, data):
    df = scan(spark.read.parquet(f"{data}/lineitem.parquet"), ["l_orderkey", "l_quantity"], "l_returnflag = 'R'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
