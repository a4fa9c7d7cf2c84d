"""Versioned tables: atomic refresh, stored marks, rollups kept up to date, streams."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from layerflow.operators.aggregates import aggregate, recompute_check
from layerflow.operators.versions import (
    VersionConflict,
    _commit,
    append_version,
    compact,
    current_version,
    drop_versions,
    publish_version,
    read_rollup,
    read_version,
    refresh_rollup,
    republish,
    table_versions,
)
from layerflow.streaming.versions import compact_ledger, ledger_stream, version_stream


@pytest.fixture
def src(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None)], "t int, v string")


def test_a_failing_write_leaves_the_old_table(spark, src, tmp_path, rows):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        read_version(spark, path)
    publish_version(src, path)
    broken = src.select("t", F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        publish_version(broken, path)
    assert rows(read_version(spark, path)) == rows(src)
    assert len(glob.glob(f"{path}/commits/*.json")) == 1
    # what the failed write left is no part of the table, and goes
    assert drop_versions(spark, path, 1) == 0
    assert len(os.listdir(f"{path}/data")) == 1
    assert rows(read_version(spark, path)) == rows(src)


def test_readers_keep_the_version_they_opened(spark, src, tmp_path, rows):
    path = str(tmp_path / "t")
    before = publish_version(src, path)
    # a table may be refreshed from its own rows
    after = publish_version(read_version(spark, path).where("t > 1").withColumn("v", F.upper("v")), path)
    assert rows(before) == rows(src)
    assert rows(after) == rows(read_version(spark, path)) == [(2, "B"), (2, "C"), (3, None)]
    assert rows(read_version(spark, path, 1)) == rows(src)
    assert [(r.version, r.kind, r.rows) for r in table_versions(spark, path).collect()] == [(1, "full", 4), (2, "full", 3)]
    assert drop_versions(spark, path, 1) == 1
    assert current_version(spark, path, 1) is None and rows(read_version(spark, path)) == rows(after)


def test_repeated_publishing_does_nothing(spark, src, tmp_path, rows):
    path, other = str(tmp_path / "t"), str(tmp_path / "u")
    publish_version(src, path, token="run 7")
    broken = src.select("t", F.raise_error(F.lit("evaluated")).cast("string").alias("v"))
    assert rows(publish_version(broken, path, token="run 7")) == rows(src)
    for _ in range(2):
        assert rows(republish(spark, path, other)) == rows(src)
    assert current_version(spark, other).number == 1
    publish_version(src.limit(0), path)
    assert republish(spark, path, other).count() == 0 and current_version(spark, other).number == 2


def test_two_writers_from_one_version(spark, src, tmp_path, rows):
    path = str(tmp_path / "t")
    publish_version(src, path)
    version = current_version(spark, path)
    version.number += 1
    publish_version(src.where("t = 1"), path)
    with pytest.raises(VersionConflict):
        _commit(spark, path, version)
    assert rows(read_version(spark, path)) == [(1, "a")]


def test_mark_is_stored_and_the_table_is_not_read(spark, src, tmp_path, rows):
    path = str(tmp_path / "t")
    append_version(src.where("t <= 2"), path, "t", partition_by="v")
    assert current_version(spark, path).mark == "2"
    for file in glob.glob(f"{path}/data/**/*.parquet", recursive=True):
        os.rename(file, file + ".away")
    append_version(src, path, "t")  # takes t = 3 without the stored rows
    for file in glob.glob(f"{path}/data/**/*.away", recursive=True):
        os.rename(file, file.removesuffix(".away"))
    assert rows(read_version(spark, path)) == rows(src)
    assert current_version(spark, path).number == 2
    append_version(src, path, "t")  # nothing new, no version
    append_version(src.withColumn("t", F.lit(None).cast("int")), path, "t")
    assert current_version(spark, path).number == 2
    assert append_version(src, path, "t", mode="full").count() == 8
    with pytest.raises(ValueError, match="do not fit"):
        append_version(src.withColumn("v", F.lit(1)), path, "t")
    with pytest.raises(ValueError, match="no column"):
        append_version(src.drop("t"), path, "t")
    assert rows(compact(spark, path)) == rows(src.unionByName(src)) and len(current_version(spark, path).parts) == 1


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "decimal(9,2)", "double", "string"])
def test_marks_of_all_types(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    values = {"decimal(9,2)": ("9.50", "10.25"), "double": ("0.1", "1e300"), "string": ("it's", "ü")}
    low, high = values.get(kind, ("2020-01-31", "2020-02-01"))
    table = spark.createDataFrame([(low,), (high,)], "c string").select(F.col("c").cast(kind).alias("c"))
    append_version(table.where(F.col("c") < F.lit(high).cast(kind)), path, "c")
    assert append_version(table, path, "c").count() == append_version(table, path, "c").count() == 2


@pytest.fixture
def measures(spark):
    return {
        "total": ("sum", F.col("x").cast("decimal(18,2)")),
        "n": ("count", F.lit(1)),
        "low": ("min", "x"),
        "high": ("max", "x"),
        "mean": ("avg", F.col("x").cast("decimal(18,2)")),
        "kinds": ("countd", "k"),
        "middle": ("median", "x"),
    }


def _fact(spark):
    rows = [(t, None if t % 11 == 0 else f"g{t % 7}", t % 5, None if t % 13 == 0 else float(t * 37 % 101)) for t in range(200)]
    return spark.createDataFrame(rows, "t int, g string, k int, x double")


def test_rollup_stays_equal_to_the_fact(spark, tmp_path, rows, measures):
    path, fact = str(tmp_path / "agg"), _fact(spark)
    for upto in (50, 51, 120, 120, 200):
        now = fact.where(F.col("t") < upto)
        stored = refresh_rollup(now, path, "t", "g", measures, buckets=4)
        assert recompute_check(stored, now, "g", measures).collect() == []
    assert current_version(spark, path).number == 4  # one run found nothing new
    assert stored.count() == 8


def test_only_touched_buckets_are_written(spark, tmp_path, rows, measures):
    path, fact = str(tmp_path / "agg"), _fact(spark)
    refresh_rollup(fact.where("t < 150"), path, "t", "g", measures, buckets=32)
    before = set(current_version(spark, path).parts)
    delta = fact.where("t < 150").unionByName(fact.where("t >= 150 and g = 'g3'"))
    refresh_rollup(delta, path, "t", "g", measures, buckets=32)
    after = set(current_version(spark, path).parts)
    assert len(after - before) == 1 and len(before & after) == len(before) - 1
    assert recompute_check(read_rollup(spark, path, "g", measures), delta, "g", measures).collect() == []


def test_rollup_edges(spark, tmp_path, rows, measures):
    fact = _fact(spark)
    path = str(tmp_path / "all")
    for upto in (0, 100, 200):
        now = fact.where(F.col("t") < upto)
        stored = refresh_rollup(now, path, "t", [], measures)
    assert rows(stored) == rows(aggregate(fact, [], measures).select(stored.columns))
    with pytest.raises(ValueError, match="no keys"):
        refresh_rollup(fact, path, "t", "g", measures, part_by="k")
    # a repeated row counts again, keys together in one bucket
    path = str(tmp_path / "two")
    refresh_rollup(fact.unionByName(fact), path, "t", ["g", "k"], {"n": ("count", F.lit(1))}, part_by="k", buckets=3)
    assert read_rollup(spark, path, ["g", "k"], {"n": "count"}).agg(F.sum("n")).first()[0] == 400


def test_stream_commits_batches_once(spark, src, tmp_path, rows):
    arriving, path, marks = (str(tmp_path / p) for p in ("in", "t", "marks"))
    (tmp_path / "in").mkdir()
    assert version_stream(spark, arriving, path, "t", marks, src.schema).count() == 0
    src.where("t <= 2").coalesce(1).write.mode("append").parquet(arriving)
    assert version_stream(spark, arriving, path, "t", marks, src.schema).count() == 3
    src.coalesce(1).write.mode("append").parquet(arriving)
    assert rows(version_stream(spark, arriving, path, "t", marks, src.schema)) == rows(src)
    number = current_version(spark, path).number
    # a batch that is replayed is known by its number, whatever it holds
    batch = max(current_version(spark, path).batches.values())
    append_version(src, path, "t", "full", batch=(marks, batch))
    assert current_version(spark, path).number == number
    # a lost checkpoint replays all files; nothing is above the mark
    assert rows(version_stream(spark, arriving, path, "t", str(tmp_path / "new"), src.schema)) == rows(src)


def test_stream_keeps_late_rows(spark, src, tmp_path, rows):
    arriving, path, marks = (str(tmp_path / p) for p in ("in", "t", "marks"))
    for part in ("t = 3", "t < 3"):
        src.where(part).coalesce(1).write.mode("append").parquet(arriving)
        found = version_stream(spark, arriving, path, "t", marks, src.schema, late="keep")
    assert rows(found) == rows(src)


def test_ledger_stream_takes_late_and_repeated_rows(spark, tmp_path, rows):
    arriving, path, marks = (str(tmp_path / p) for p in ("in", "ledger", "marks"))
    kinds = "flow string, at int, code int"
    batches = [
        [("a", 5, 0), ("b", 1, 1), (None, 2, 0)],
        [("a", 3, 1), ("b", 1, 2), ("b", 1, 2), ("c", None, 4)],  # late, tied and without a time
        [("c", 1, 0), ("a", 6, 3), ("a", 5, 9)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(arriving)
        found = ledger_stream(spark, arriving, path, marks, kinds, "flow", "at")
    want = sorted([("a", 6, 3), ("b", 1, 2), (None, 2, 0), ("c", 1, 0)], key=repr)
    assert rows(found) == want
    assert rows(compact_ledger(spark, path, "flow", "at")) == want
    assert rows(ledger_stream(spark, arriving, path, marks, kinds, "flow", "at")) == want
    # all files once more under a new checkpoint
    assert rows(ledger_stream(spark, arriving, path, str(tmp_path / "new"), kinds, "flow", "at")) == want
