import json

import pytest

from layerflow import (
    consumer_impact,
    explode_object,
    failed_runs,
    json_collect,
    map_status,
    pending,
    record_runs,
    referenced_fields,
    run_summary,
    upsert_latest,
)


def test_upsert_is_replay_safe(spark, rows):
    state = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept"), ("c", 2, "tie")], "name string, at int, status string")
    updates = spark.createDataFrame(
        [("a", 2, "new"), ("a", 3, "newest"), ("b", 4, "late"), ("c", 2, "Tie wins"), ("d", 1, "first")],
        "name string, at int, status string",
    )
    once = upsert_latest(state, updates, "name", "at")
    assert rows(once) == [("a", 3, "newest"), ("b", 5, "kept"), ("c", 2, "Tie wins"), ("d", 1, "first")]
    assert rows(upsert_latest(once, updates, "name", "at")) == rows(once)


@pytest.fixture
def ledger(spark):
    return spark.createDataFrame(
        [
            ("f1", "marts", "published", "L1", "success", 5), ("f2", "marts", "published", "L2", "failed", 7),
            ("f3", "marts", "published", "L3", None, None), ("f4", "marts", "published", None, "n/a", None),
            ("f5", "marts", "pending", "L5", None, None), ("f6", "staging", "published", "L6", "timeout", 1800),
        ],
        "name string, layer string, publish_status string, flow_luid string, run_status string, secs int",
    )


def test_pending_and_summary(ledger, rows):
    assert rows(pending(ledger, "marts").select("name")) == [("f2",), ("f3",)]
    assert rows(run_summary(ledger, "layer", "secs")) == [("marts", 5, 1, 1, 0, 7), ("staging", 1, 0, 0, 1, 1800)]
    assert rows(failed_runs(ledger, "layer", "name")) == [("marts", "f2", "failed"), ("staging", "f6", "timeout")]


def test_runs_are_recorded_once_and_live_tables_never(spark, rows):
    schema = "name string, kind string, run_status string, finish_code int, run_at int"
    ledger = spark.createDataFrame(
        [("a", "flow", "pending", None, None), ("b", "flow", "failed", 1, 9), ("c", "pds_augment", "n/a", None, None), ("d", "flow", "success", 0, 1)],
        schema,
    )
    runs = spark.createDataFrame(
        [("a", 2, 5), ("a", 0, 6), ("b", 0, 8), ("c", 0, 7), ("d", None, 9), ("new", 0, 1)], "name string, finish_code int, run_at int"
    )
    once = record_runs(ledger, runs, "name")
    assert rows(once) == sorted(
        [("a", "flow", "success", 0, 6), ("b", "flow", "failed", 1, 9), ("c", "pds_augment", "n/a", None, None), ("d", "flow", "success", 0, 1)], key=repr
    )
    assert rows(record_runs(once, runs, "name")) == rows(once)


def test_status_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (9,), (None,)], "code int")
    assert [r[1] for r in map_status(df, "code").collect()] == ["success", "failed", "failed", "failed", "timeout"]


def test_consumer_verdicts(spark, rows):
    def frame(data, schema):
        return spark.createDataFrame(data, schema)

    got = consumer_impact(
        frame([("t1",), ("t2",), ("t3",), ("t4",)], "dataset string"),
        frame([("t1", "w1"), ("t1", "w2"), ("zz", "w3")], "dataset string, report string"),
        frame([("d2", "t2"), ("d3", "t3"), ("d3b", "t3")], "definition string, dataset string"),
        frame([("d2", "m1"), ("d3", "m2"), ("d3", "m3")], "definition string, metric string"),
        frame([("m3",), ("m3",)], "metric string"),
    )
    assert rows(got) == [
        ("t1", 2, 0, 0, "repoint"), ("t2", 0, 1, 0, "cleanup_only"), ("t3", 0, 2, 1, "repoint"), ("t4", 0, 0, 0, "none"),
    ]


def test_referenced_fields(spark, rows):
    viz = {"vizState": {"rows": [{"fieldCaption": "r"}], "columns": [{"other": 1}], "filters": [{"fieldCaption": "f"}]}}
    full = {
        "specification": {
            "basic_specification": {"measure": {"field": "m"}, "time_dimension": {"field": "t"}, "filters": [{"field": "f"}, {}]},
            "viz_state_specification": {"viz_state_string": json.dumps(viz)},
        },
        "extension_options": {"allowed_dimensions": ["d", "m"]},
    }
    broken = {"specification": {"basic_specification": {"measure": {"field": ""}}, "viz_state_specification": {"viz_state_string": "{not json"}}}
    df = spark.createDataFrame([("1", json.dumps(full)), ("2", json.dumps(broken)), ("3", "{}"), ("4", None)], "id string, doc string")
    assert rows(referenced_fields(df, "id", "doc")) == [("1", f) for f in ("d", "f", "m", "r", "t")]


def test_json_members_and_deep_strings(spark, rows):
    doc = {"a": {"name": "x", "list": [{"columnNames": ["p", 1, "q"]}, [{"name": "y"}]]}, "name": None, "other": "no"}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "broken"), (3, None), (4, '["name"]')], "id int, doc string")
    assert rows(json_collect(df, "doc", ["name", "columnNames"])) == [(1, "p"), (1, "q"), (1, "x"), (1, "y")]
    objects = spark.createDataFrame([(1, '{"k": {"z": 1}, "l": "t"}'), (2, None)], "id int, doc string")
    assert rows(explode_object(objects, "doc", "key")) == [(1, "k", '{"z":1}'), (1, "l", "t")]
