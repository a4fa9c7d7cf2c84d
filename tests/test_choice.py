"""Choosing rows: first rows of large tables, samples of exact sizes; JSON, mappings, domains."""

import json
import random

import pytest
from pyspark.sql import functions as F

from layerflow.functions.documents import json_collect
from layerflow.operators.clean import group_values
from layerflow.operators.columns import augment
from layerflow.operators.reshape import add_missing_rows
from layerflow.sources import first_rows, limit_rows, sample_groups
from layerflow.sources import tables as tb


@pytest.fixture
def many(spark):
    b = F.when(F.col("id") % 13 != 0, F.col("id") % 101)
    return spark.range(60_000).select((F.col("id") * 7919 % 977).alias("a"), b.alias("b"), "id").repartition(6)


@pytest.mark.parametrize("n", [0, 1, 20_000, 59_999, 60_000, 99_999])
def test_first_rows_are_those_of_a_sort(many, monkeypatch, n):
    monkeypatch.setattr(tb, "ROWS_IN_RANGE", 5000)
    monkeypatch.setattr(tb, "THRESHOLD_SAMPLE", 2000)
    found = first_rows(many, n, ["a", "b"])
    keys = lambda df: sorted((r.a, -1 if r.b is None else r.b) for r in df.collect())
    assert keys(found) == keys(many.orderBy("a", "b").limit(n))
    assert len({r.id for r in found.collect()}) == min(n, 60_000)


def test_limits_of_all_sizes_and_hot_ties(spark, many):
    assert limit_rows(many, 12_000, ["a", "id"]).count() == 12_000
    assert limit_rows(many, 5, "id").agg(F.max("id")).first()[0] == 4
    same = spark.range(30_000).select(F.lit(1).alias("a"), "id")
    assert first_rows(same, 11_000, "a").count() == 11_000
    times = spark.range(1000).select(F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, id % 50)").alias("t"), "id")
    got = {r.id for r in first_rows(times, 500, ["t", "id"]).collect()}
    assert got == {r.id for r in times.orderBy("t", "id").limit(500).collect()}
    assert first_rows(many.limit(0), 3, "a").count() == 0


def test_samples_have_exact_sizes_and_do_not_move(spark):
    rows = [(g, i, "x") for g, n in ((1, 500), (2, 3), (None, 40)) for i in range(n)] + [(2, 0, "x")]
    table = spark.createDataFrame(rows, "g int, k int, __draw string")
    picked = [sorted((tuple(r) for r in sample_groups(table.repartition(p), 10, "g", "k").collect()), key=repr) for p in (1, 7)]
    assert picked[0] == picked[1]
    sizes = {g: sum(r[0] == g for r in picked[0]) for g in (1, 2, None)}
    assert sizes == {1: 10, 2: 4, None: 10}
    assert sample_groups(table, 10, "g", "k", seed=1).count() == 24 != 0
    assert sample_groups(table.limit(0), 10, "g", "k").count() == 0


def strings_under(item, keys):
    """The plain walk."""
    out = set()
    if isinstance(item, dict):
        for k, v in item.items():
            if k in keys:
                out |= {x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)}
            out |= strings_under(v, keys)
    elif isinstance(item, list):
        for v in item:
            out |= strings_under(v, keys)
    return out


def test_json_at_any_depth_equals_a_walk(spark):
    rng = random.Random(6)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["s1", "s2", "", 5, 1.5, True, None, "ü"])
        if kind < 0.6:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: made(depth - 1) for k in rng.sample(["a", "b", "c", "a.b"], rng.randint(0, 3))}

    documents = [made(7) for _ in range(120)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)] + [(500, None), (501, "{broken"), (502, ""), (0, json.dumps(documents[0]))]
    table = spark.createDataFrame(rows, "id int, document string")
    found = json_collect(table, "document", ["a", "a.b"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = sorted((i, s) for i, d in [*enumerate(documents), (0, documents[0])] for s in strings_under(d, {"a", "a.b"}))
    assert sorted(map(tuple, found.collect())) == want
    assert json_collect(table.select("document"), "document", ["a"]).columns == ["value"]
    assert json_collect(table.limit(0), "document", ["a"]).count() == 0


def test_a_dict_is_looked_up_without_a_shuffle(spark, data, rows):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type")
    found = group_values(events, "event_type", {"click": "visit", "view": "visit", None: "never", "signup": None})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    kinds = {r.event_type for r in found.select("event_type").distinct().collect()}
    assert "visit" in kinds and "signup" in kinds and not kinds & {"click", "view"}
    numbers = spark.createDataFrame([(1, 2), (2, None)], "id int, n int")
    assert rows(group_values(numbers, "n", {2: 5})) == [(1, 5), (2, None)]
    assert rows(group_values(numbers, "n", {})) == [(1, 2), (2, None)]


def test_a_cast_without_a_caption_keeps_the_old_one(spark):
    table = spark.createDataFrame([("1",)], "a string")
    assert augment(table, [{"op": "cast", "column_name": "[a]", "to_datatype": "integer"}]).dtypes == [("a", "bigint")]
    both = [{"op": "rename", "column_name": "[a]", "to_caption": "b"}, {"op": "cast", "column_name": "[a]", "to_datatype": "integer"}]
    assert augment(table, both).dtypes == [("b", "bigint")]


def test_a_domain_may_be_a_table(spark, monkeypatch, rows):
    from layerflow.operators import reshape

    table = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (None, "c", 7), (2, None, 8)], "g int, k string, v int")
    domain = spark.createDataFrame([("a",), ("b",), ("z",), (None,), ("a",)], "m string")
    want = rows(add_missing_rows(table, "g", "k", ["a", "b", "z"]))
    assert rows(add_missing_rows(table, "g", "k", domain)) == want
    monkeypatch.setattr(reshape, "DOMAIN_PART", 1)
    assert rows(add_missing_rows(table, "g", "k", domain)) == want
    assert rows(add_missing_rows(table, "g", "k", domain.limit(0))) == rows(table)
