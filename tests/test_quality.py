import pytest
from pyspark.sql import functions as F

from layerflow import (
    column_diff,
    count_diff,
    coverage,
    expect_count,
    expect_disjoint,
    expect_in,
    expect_padded_steps,
    expect_pattern,
    expect_range,
    expect_ref,
    expect_required,
    expect_unique,
    expect_when,
    extract_tokens,
    resolve_pairs,
    run_expectations,
    shown_tokens,
    unknown_tokens,
    value_diff,
)
from layerflow.operators import expectations as ex


@pytest.fixture
def a(spark):
    return spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (2, "y", 2.0), (None, None, None)], "k int, s string, v double")


def test_value_diff_counts_copies(a, rows):
    assert value_diff(a, a.select("v", "s", "k")).count() == 0
    assert rows(value_diff(a, a.distinct())) == [(2, "y", 2.0, 2, 1)]
    with pytest.raises(ValueError, match="column names differ"):
        value_diff(a, a.drop("v"))


def test_value_diff_by_key(spark, rows):
    one = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 3.0), (5, "d", 0.0), (5, "d", 0.0)], "k int, s string, v double")
    two = spark.createDataFrame([(1, "x", 1.05), (2, "Y", 2.0), (4, "w", 4.0), (5, "d", 0.0)], "k int, s string, v double")
    assert rows(value_diff(one, two, key="k", tol=0.1)) == [
        (2, "differs", ["s", "v"]), (3, "only_a", []), (4, "only_b", []), (5, "repeated_key", []),
    ]
    assert (1, "differs", ["v"]) in rows(value_diff(one, two, key="k", tol=0.01))


def test_column_and_count_diff(a, rows):
    changed = a.select("k", F.col("v").cast("string").alias("v"), F.lit(1).alias("extra"))
    got = {r["column"]: r for r in column_diff(a, changed).collect()}
    assert set(got) == {"k", "s", "v", "extra"}
    assert got["k"]["same"] and not got["v"]["same"]
    assert (got["s"]["in_a"], got["s"]["in_b"]) == (True, False)
    assert (got["extra"]["in_a"], got["extra"]["in_b"]) == (False, True)
    assert got["k"]["nulls_a"] == 1 and got["k"]["distinct_a"] == 2
    assert column_diff(a, a, distinct=False).where("NOT same").count() == 0
    assert rows(count_diff(a, a.where("k = 2"), "k")) == sorted([(1, 1, 0, -1), (2, 2, 2, 0), (None, 1, 0, -1)], key=repr)
    assert rows(count_diff(a, a.where("false"))) == [(4, 0, -4)]


def test_resolve_pairs_never_guesses(spark, rows):
    original = spark.createDataFrame([("o1",), ("o2",)], "name string")
    made = spark.createDataFrame([("o1", "f1"), ("o1", "f2"), ("O2", "f3"), (None, "f4")], "declared string, flow string")
    assert rows(resolve_pairs(original, made, "name", "declared", "flow")) == [
        ("O2", "f3", "unknown_original"), ("o1", "f1", "paired"), ("o1", "f2", "paired"), ("o2", None, "no_successor"),
    ]


def test_simple_expectations(spark, a, rows):
    assert expect_required(a, ["k", "s"]).count() == 1
    assert expect_required(a.withColumn("s", F.lit("")), "s").count() == 4
    assert rows(expect_in(a, "s", ["x"])) == [(2, "y", 2.0)] * 2
    assert rows(expect_unique(a, "k")) == [(2, 2)]
    assert expect_when(a, "k = 2", "v > 5").count() == 2
    assert expect_when(a, "k IS NULL", "v > 5").count() == 1
    other = spark.createDataFrame([(1,)], "id int")
    assert expect_ref(a, "k", other, "id").count() == 2
    assert rows(expect_range(a, "k", 1, 2).select("k")) == [(2,), (2,)]
    assert expect_range(a, "k").count() == 0
    assert rows(expect_disjoint(a, other, [("k", "id")])) == [(1,)]
    assert expect_count(a, 4).count() == 0 and rows(expect_count(a, 5)) == [(5, 4)]


def test_names(spark, rows):
    names = [
        "stg_crm__opportunities", "int_orders_joined", "fct_sales", "agg_revenue_monthly", "_scratch_try",
        "Orders", "stg_orders_v2", "FCT_SALES", "int_orders-joined",
    ]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert rows(expect_pattern(df, "name")) == sorted(
        [
            ("FCT_SALES", "prefix"), ("FCT_SALES", "snake_case"), ("Orders", "prefix"), ("Orders", "snake_case"),
            ("int_orders-joined", "snake_case"), ("stg_orders_v2", "no_version"), ("stg_orders_v2", "staging_source"),
        ],
        key=repr,
    )
    steps = [f"int_a_step{i}_x" for i in range(1, 4)] + [f"int_b_step{i}" for i in (1, 9, 10)] + ["int_c_step02"]
    assert rows(expect_padded_steps(spark.createDataFrame([(s,) for s in steps], "name string"), "name")) == [
        ("int_b_step1",), ("int_b_step9",),
    ]


def test_run_expectations_reports_everything_in_one_pass(spark, a, rows):
    rules = [
        ex.required("set", a, ["k", "s"]), ex.within("range", "v", 0, 1.5), ex.unique("one", "k"),
        ex.implied("rule", "k = 2", "s = 'z'"), ex.counted("count", 4),
    ]
    got = rows(run_expectations(a, "k", rules).select("rule", "key"))
    assert got == sorted([("set", None), ("range", "2"), ("range", "2"), ("one", "2"), ("rule", "2"), ("rule", "2")], key=repr)
    with pytest.raises(ValueError):
        run_expectations(a, "k", [])


def test_row_rules_share_one_scan(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    rules = [ex.within("r1", "o_totalprice", 0, 1), ex.accepted("r2", "o_orderstatus", ["F"])]
    plan = run_expectations(orders, "o_orderkey", rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


def test_coverage(spark, rows):
    items = spark.createDataFrame([(1,), (2,), (3,)], "step int")
    assigned = spark.createDataFrame([(1, "f"), (2, "f"), (2, "g"), (2, "g")], "step int, flow string")
    assert rows(coverage(items, assigned, "step", "flow")) == [
        (2, "multiple", "f", 2), (2, "multiple", "g", 2), (3, "unassigned", None, 0),
    ]


def test_tokens(spark, rows):
    df = spark.createDataFrame(
        [("f", "{ PARTITION [銘柄]: { ORDERBY [約定日] ASC: ROW_NUMBER() } } + [Table Names]"), ("g", "no tokens"), ("h", None)],
        "flow string, expression string",
    )
    tokens = extract_tokens(df, "expression")
    assert rows(tokens) == sorted([("f", "銘柄"), ("f", "約定日"), ("f", "Table Names")], key=repr)
    allowed = spark.createDataFrame([("f", "銘柄"), ("g", "約定日")], "flow string, token string")
    assert rows(unknown_tokens(tokens, allowed, "flow")) == [("f", "約定日")]
    assert rows(shown_tokens(unknown_tokens(tokens, allowed, "flow"), "flow")) == [("f", 1, "[約定日]")]
    # in the order of the names, not of the bracketed names
    numbered = spark.createDataFrame([("f", "c1"), ("f", "c10"), ("f", "c2")], "flow string, token string")
    assert rows(shown_tokens(unknown_tokens(numbered, allowed, "flow"), "flow", show=2)) == [("f", 3, "[c1], [c10] (+1)")]


def test_null_in_the_accepted_list_hides_nothing(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, c string")
    assert rows(expect_in(df, "c", ["a", None])) == rows(expect_in(df, "c", ["a"])) == [(2, "z")]
    got = run_expectations(df, "id", [ex.accepted("known", "c", ["a", None])])
    assert rows(got.select("rule", "key")) == [("known", "2")]


def test_long_step_numbers(spark, rows):
    names = ["a_step1", "a_step20240101123456789012345678901234567890", "b_step1", "b_step0009", "c_step3", "c_step10_x"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert rows(expect_padded_steps(df, "name")) == [("a_step1",), ("c_step3",)]
