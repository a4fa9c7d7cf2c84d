import datetime as dt

import pytest
from pyspark.sql import functions as F

from layerflow import (
    append,
    backfill,
    incremental_append,
    incremental_stream,
    join,
    publish,
    publish_view,
    read_dataset,
    refresh_mode,
    write_extract,
)


@pytest.fixture
def src(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "t int, v string")


def test_publish_overwrites_and_layers_are_checked(src, spark, tmp_path, rows):
    root = str(tmp_path)
    publish(src, root, "staging", "stg_x__y")
    assert publish(src.where("t = 1"), root, "staging", "stg_x__y").count() == 1
    assert rows(read_dataset(spark, root, "stg_x__y", layer="staging")) == [(1, "a")]
    with pytest.raises(ValueError, match="layer must be"):
        publish(src, root, "gold", "x")


def test_view_stores_nothing(src, spark):
    assert publish_view(src, "live_src").count() == 4
    assert spark.sql("SELECT count(*) FROM live_src").first()[0] == 4
    assert read_dataset(spark, None, "live_src").count() == 4


def test_incremental_takes_rows_past_the_mark_only(src, tmp_path, rows):
    out = str(tmp_path / "out")
    assert incremental_append(src.where("t <= 1"), out, "t").count() == 1
    assert rows(incremental_append(src.where("v <> 'c'"), out, "t")) == [(1, "a"), (2, "b"), (3, "d")]
    # (2, c) ties with a stored control value and is late
    assert rows(incremental_append(src, out, "t")) == [(1, "a"), (2, "b"), (3, "d")]
    assert incremental_append(src, out, "t", mode="full").count() == 7


def test_incremental_plus_initial_equals_full_without_ties(src, tmp_path, rows):
    out = str(tmp_path / "out")
    for most in (1, 2, 3):
        stored = incremental_append(src.where(F.col("t") <= most), out, "t")
    assert rows(stored) == rows(src)


def test_incremental_output_may_name_the_field_differently(spark, src, tmp_path):
    out = str(tmp_path / "out")
    both = src.withColumn("stored_t", F.col("t"))
    incremental_append(both.where("t <= 2"), out, "t", "stored_t")
    assert incremental_append(both, out, "t", "stored_t").count() == 4
    with pytest.raises(ValueError, match="no column"):
        incremental_append(both, out, "t", "gone")


def test_nothing_is_written_when_the_schema_no_longer_fits(src, tmp_path, spark):
    out = str(tmp_path / "out")
    incremental_append(src, out, "t")
    with pytest.raises(ValueError, match="do not fit"):
        incremental_append(src.withColumn("extra", F.lit(1)), out, "t")
    with pytest.raises(ValueError, match="do not fit"):
        append(src.withColumn("v", F.col("t")), out)
    with pytest.raises(ValueError, match="is gone"):
        incremental_append(src.withColumnRenamed("t", "u"), str(tmp_path / "other"), "t")
    assert spark.read.parquet(out).count() == 4


def test_mark_reaches_the_reader(spark, data, tmp_path):
    from layerflow.operators.refresh import newer_rows

    orders = spark.read.parquet(f"{data}/orders.parquet")
    old = orders.where("o_orderdate < TIMESTAMP_NTZ'1998-01-01'")
    plan = newer_rows(orders, old, "o_orderdate", "o_orderdate")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate,1997-12-" in plan


def test_stream_equals_batch_and_survives_replay(src, spark, tmp_path, rows):
    arriving, out, marks = (str(tmp_path / p) for p in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    assert incremental_stream(spark, arriving, out, "t", marks, src.schema).count() == 0
    src.where("t <= 2").coalesce(1).write.mode("append").parquet(arriving)
    assert incremental_stream(spark, arriving, out, "t", marks, src.schema).count() == 3
    src.where("t > 2").coalesce(1).write.mode("append").parquet(arriving)
    assert rows(incremental_stream(spark, arriving, out, "t", marks, src.schema)) == rows(src)
    # a lost checkpoint replays every file; known rows are not stored again
    assert incremental_stream(spark, arriving, out, "t", str(tmp_path / "fresh"), src.schema).count() == 4


def test_partitioned_outputs_keep_types_and_order(spark, src, tmp_path, rows):
    root = str(tmp_path)
    by_text = src.select(F.lpad(F.col("t").cast("string"), 2, "0").alias("code"), "t", "v")
    stored = publish(by_text, root, "marts", "fct_x", partition_by="code")
    assert stored.schema == by_text.schema and rows(stored) == rows(by_text)
    plan = stored.where("code = '02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(code" in plan
    out = str(tmp_path / "out")
    incremental_append(by_text.where("t <= 2"), out, "t", partition_by="code")
    assert rows(incremental_append(by_text, out, "t", partition_by="code")) == rows(by_text)
    append(by_text, out, partition_by="code")
    assert spark.read.parquet(out).count() == 8


def test_bucketed_tables_join_without_a_shuffle(spark, data, conf, tmp_path):
    conf(spark__sql__autoBroadcastJoinThreshold=-1)
    root = str(tmp_path)
    orders = publish(spark.read.parquet(f"{data}/orders.parquet"), root, "staging", "stg_b__orders", bucket_by="o_orderkey", buckets=4)
    lines = publish(spark.read.parquet(f"{data}/lineitem.parquet"), root, "staging", "stg_b__lines", bucket_by="l_orderkey", buckets=4)
    joined = join(lines, orders, [("l_orderkey", "o_orderkey")], "inner")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 6000
    again = publish(spark.read.parquet(f"{data}/orders.parquet"), root, "staging", "stg_b__orders", bucket_by="o_orderkey", buckets=4)
    assert again.count() == 1500
    with pytest.raises(ValueError, match="choose"):
        publish(orders, root, "staging", "x", partition_by="o_orderstatus", bucket_by="o_orderkey")
    for name in ("stg_b__orders", "stg_b__lines"):
        spark.sql(f"DROP TABLE {name}")


def test_refresh_mode_rules(spark, rows):
    settings = spark.createDataFrame(
        [("a", True, "d", "o"), ("b", True, None, "o"), ("b", True, "", "o"), ("c", False, "d", "o"), ("d", True, "d", "o"), ("e", None, "d", "o")],
        "flow string, incremental_enabled boolean, control_field string, output_node_id string",
    )
    add, other = "outputOperationTypeAppend", "outputOperationTypeReplace"
    outputs = spark.createDataFrame(
        [("a", add, other), ("b", add, add), ("c", add, add), ("d", other, None), ("f", None, add)],
        "flow string, output_operation_type string, incremental_output_operation_type string",
    )
    fields = {r["flow"]: r["control_fields"] for r in refresh_mode(settings, outputs, "flow").collect()}
    assert fields == {"a": "d", "b": "", "c": "", "d": "d", "e": "", "f": ""}
    got = {r["flow"]: (r["run_type"], r["n_inert"]) for r in refresh_mode(settings, outputs, "flow").collect()}
    assert got == {"a": ("incremental", 0), "b": ("full", 2), "c": ("full", 0), "d": ("full", 0), "e": ("full", 0), "f": ("full", 0)}


def test_backfill_cuts_at_the_first_new_value(spark, rows):
    old = spark.createDataFrame([(1, "o"), (2, "o"), (3, "o")], "t int, v string")
    new = spark.createDataFrame([(2, "n"), (4, "n")], "t int, v string")
    assert rows(backfill(new, old, "t")) == [(1, "o"), (2, "n"), (4, "n")]
    assert backfill(new.where("false"), old, "t").count() == 3


def test_extract_keeps_column_types(spark, tmp_path):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts, CAST(1 AS DOUBLE) AS x")
    got = write_extract(df, str(tmp_path / "x"))
    assert got.schema == df.schema or [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    assert got.first()["ts"] == dt.datetime(2024, 1, 1, 10)


def test_shared_folder_comes_from_the_session(spark):
    from layerflow.session import scratch_path

    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(named)


def test_scratch_is_removed_at_the_end_of_its_scope(spark, data):
    from pathlib import Path

    from layerflow import scratch_scope
    from layerflow.plans.catalog import QUERIES
    from layerflow.session import shared_folder

    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    with scratch_scope(spark):
        assert QUERIES["m1_reachable"](spark, data).count() > 0
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before


def test_stream_that_keeps_ties_and_late_rows(src, spark, tmp_path, rows):
    arriving, out, marks = (str(tmp_path / p) for p in ("arriving", "out", "marks"))
    for part in ("v = 'd'", "v = 'b'", "v in ('a', 'c')"):
        src.where(part).coalesce(1).write.mode("append").parquet(arriving)
        stored = incremental_stream(spark, arriving, out, "t", marks, src.schema, late="keep")
    assert rows(stored) == rows(src)
    assert rows(incremental_stream(spark, arriving, out, "t", marks, src.schema, late="keep")) == rows(src)
    with pytest.raises(ValueError, match="late must be"):
        incremental_stream(spark, arriving, out, "t", marks, src.schema, late="maybe")
