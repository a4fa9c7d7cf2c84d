"""Tables in versions: readers never see half a refresh, and a refresh may be repeated.

A table at ``path`` has its rows in ``path/data/write=<id>`` folders, which are written once and
never changed, and its versions in ``path/commits/<number>.json``. A version names the folders
that make up the table; its file appears by one atomic rename after all rows are written. So a
writer that fails leaves no version, a reader keeps the folders of the version it opened, and of
two writers that start from the same version one gets an error. High-water marks and the last
batch of each stream are kept in the version: they are committed with the rows they belong to,
and nobody reads the table to find them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.functions.names import as_list, col, require_columns
from layerflow.operators.aggregates import Aggs, _parts, aggregate
from layerflow.session import cut

WRITE = "write"
BUCKET = "__bucket"


class VersionConflict(RuntimeError):
    """Another writer has stored a version in the meantime. Nothing of this one is visible."""


@dataclass
class Version:
    number: int
    kind: str
    parts: list[str]
    schema: dict
    partition_by: list[str] = field(default_factory=list)
    mark: str | None = None
    mark_type: str | None = None
    token: str | None = None
    rows: int = 0
    batches: dict[str, int] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    def mark_literal(self) -> Column | None:
        return None if self.mark is None else F.lit(self.mark).cast(self.mark_type)


class _Files:
    """The few file operations of commits, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self.path(path).getFileSystem(self._conf)

    def path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self.path(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self.path(folder))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a file that does not exist yet, whole or not at all; whether it was written."""
        folder, last = name.rsplit("/", 1)
        draft = f"{folder}/.{last}-{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(draft), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.path(draft), self.path(name), none)
            return True
        except Py4JJavaError as error:
            self.remove(draft)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


def current_version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version of a table, or the numbered one; None where there is none."""
    files = _Files(spark, path)
    found = sorted(int(n[:-5]) for n in files.names(f"{path}/commits") if n.endswith(".json") and n[:-5].isdigit())
    if number is None:
        number = found[-1] if found else None
    if number is None or number not in found:
        return None
    return Version(**json.loads(files.read(f"{path}/commits/{number:020d}.json")))


def _commit(spark: SparkSession, path: str, version: Version) -> Version:
    if not _Files(spark, path).write_new(f"{path}/commits/{version.number:020d}.json", json.dumps(version.__dict__)):
        raise VersionConflict(f"version {version.number} of {path} exists already")
    return version


def _read_parts(spark: SparkSession, path: str, parts: Sequence[str], schema: T.StructType) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField(WRITE, T.StringType())])
    rows = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{p}" for p in parts])
    return rows.select(*[col(f.name) for f in schema.fields])


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of its newest version, or the numbered one. What is opened stays as it is,
    whatever is published later."""
    version = current_version(spark, path, number)
    if version is None:
        raise ValueError(f"no version {'' if number is None else number} of a table at {path}")
    return _read_parts(spark, path, version.parts, version.struct())


def table_versions(spark: SparkSession, path: str) -> DataFrame:
    """The history: (version, kind, rows, parts, mark, token), one row for each commit."""
    files = _Files(spark, path)
    names = sorted(n for n in files.names(f"{path}/commits") if n.endswith(".json") and n[:-5].isdigit())
    found = [Version(**json.loads(files.read(f"{path}/commits/{n}"))) for n in names]
    rows = [(v.number, v.kind, v.rows, len(v.parts), v.mark, v.token) for v in found]
    return spark.createDataFrame(rows, "version long, kind string, rows long, parts int, mark string, token string")


def _observed(seen: Observation) -> dict[str, Any]:
    """What was seen while a table was written. A plan that Spark found to be empty before it
    ran has seen nothing, and says so by a failed assertion."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if "AssertionError" not in error.java_exception.getClass().getName():
            raise
        return {"rows": 0, "mark": None}


def _store(df: DataFrame, path: str, partition_by: Sequence[str], control: str | None) -> tuple[str, int, str | None]:
    """Write rows to a new folder; its name, the rows and the largest control value, both
    observed while writing."""
    part, seen = f"{WRITE}={uuid.uuid4().hex}", Observation()
    measures = [F.count(F.lit(1)).alias("rows")]
    if control is not None:
        measures.append(F.max(col(control)).cast("string").alias("mark"))
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    rows.observe(seen, *measures).write.partitionBy(*partition_by).parquet(f"{path}/data/{part}")
    got = _observed(seen)
    return part, int(got["rows"]), got.get("mark")


def publish_version(
    df: DataFrame,
    path: str,
    partition_by: str | Sequence[str] | None = None,
    token: str | None = None,
    control: str | None = None,
) -> DataFrame:
    """Full refresh: the rows of ``df`` become the next version, and are given back as stored.

    The old version stays readable until the new one is whole, also when the write fails. A
    ``token`` names the run: publishing again with the token of the newest version writes
    nothing. ``control`` stores its largest value as the mark for later increments. ``df`` may
    read the table itself.
    """
    spark, columns = df.sparkSession, as_list(partition_by)
    require_columns(df, [*columns, *as_list(control)], "publish_version")
    now = current_version(spark, path)
    if now is not None and token is not None and now.token == token:
        return read_version(spark, path, now.number)
    part, rows, mark = _store(df, path, columns, control)
    kind = None if control is None else df.schema[control].dataType.simpleString()
    version = Version(
        (now.number if now else 0) + 1, "full", [part], df.schema.jsonValue(), columns, mark, kind, token, rows,
        dict(now.batches) if now else {},
    )
    _commit(spark, path, version)
    return read_version(spark, path, version.number)


def republish(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Store another table's newest version unchanged. Repeating it is a no-op until the
    source has a new version."""
    version = current_version(spark, source)
    if version is None:
        raise ValueError(f"no version of a table at {source}")
    rows = _read_parts(spark, source, version.parts, version.struct())
    return publish_version(rows, target, version.partition_by, token=f"{source}@{version.number}")


def append_version(
    src: DataFrame,
    path: str,
    control: str,
    mode: str = "incremental",
    partition_by: str | Sequence[str] | None = None,
    token: str | None = None,
    batch: tuple[str, int] | None = None,
) -> DataFrame:
    """Incremental refresh by a mark that is stored with the version.

    ``mode="incremental"`` adds the rows of ``src`` whose control value is above the mark,
    ``mode="full"`` all rows; a null control value is never above a mark, and counts as new
    only when nothing is stored. The table is not read: the mark is a literal in the filter of
    the source. Without new rows there is no new version. ``token`` and ``batch`` (a stream and
    its batch number) make a repeated call a no-op.
    """
    if mode not in ("incremental", "full"):
        raise ValueError("mode must be 'incremental' or 'full'")
    spark = src.sparkSession
    require_columns(src, [control, *as_list(partition_by)], "append_version")
    now = current_version(spark, path)
    if now is not None:
        if token is not None and now.token == token or batch is not None and now.batches.get(batch[0], -1) >= batch[1]:
            return read_version(spark, path, now.number)
        mine = {f.name: f.dataType.simpleString() for f in src.schema.fields}
        theirs = {f.name: f.dataType.simpleString() for f in now.struct().fields}
        if mine != theirs:
            differing = sorted(n for n in mine.keys() | theirs.keys() if mine.get(n) != theirs.get(n))
            raise ValueError(f"append_version: columns {differing} do not fit the stored table")
    mark = None if now is None else now.mark_literal()
    fresh = src if mode == "full" or mark is None else src.where(col(control) > mark)
    columns = as_list(partition_by) if now is None else now.partition_by
    part, rows, highest = _store(fresh, path, columns, control)
    if not rows and now is not None and batch is None:
        return read_version(spark, path, now.number)
    kind = src.schema[control].dataType
    top = now.mark if now else None
    if highest is not None and top is not None:
        # compared as values of the control's type
        top = spark.range(1).select(F.greatest(F.lit(top).cast(kind), F.lit(highest).cast(kind)).cast("string")).first()[0]
    else:
        top = highest if highest is not None else top
    batches = dict(now.batches) if now else {}
    if batch is not None:
        batches[batch[0]] = batch[1]
    version = Version(
        (now.number if now else 0) + 1, "append", [*(now.parts if now else []), *([part] if rows or now is None else [])],
        now.schema if now else src.schema.jsonValue(), columns, top, kind.simpleString(), token, rows, batches,
    )
    _commit(spark, path, version)
    return read_version(spark, path, version.number)


def compact(spark: SparkSession, path: str) -> DataFrame:
    """One folder instead of many: the same rows, mark and batches as the next version."""
    now = current_version(spark, path)
    if now is None:
        raise ValueError(f"no version of a table at {path}")
    part, rows, _ = _store(_read_parts(spark, path, now.parts, now.struct()), path, now.partition_by, None)
    version = Version(**{**now.__dict__, "number": now.number + 1, "kind": "compact", "parts": [part], "rows": rows})
    _commit(spark, path, version)
    return read_version(spark, path, version.number)


def drop_versions(spark: SparkSession, path: str, keep: int) -> int:
    """Remove all but the ``keep`` newest versions and every folder that none of these names,
    those of failed writes among them; the number of versions removed. Run it while nobody
    writes, and keep the versions that are still read."""
    if keep < 1:
        raise ValueError("drop_versions: at least one version stays")
    files = _Files(spark, path)
    numbers = sorted(int(n[:-5]) for n in files.names(f"{path}/commits") if n.endswith(".json") and n[:-5].isdigit())
    kept = [current_version(spark, path, n) for n in numbers[-keep:]]
    used = {part.split("/")[0] for version in kept if version for part in version.parts}
    # versions go first, so that none is ever listed without its folders
    for number in numbers[:-keep]:
        files.remove(f"{path}/commits/{number:020d}.json")
    for folder in files.names(f"{path}/data"):
        if folder not in used:
            files.remove(f"{path}/data/{folder}")
    return len(numbers[:-keep])


#: Aggregates whose states of two sets of rows give the state of both together.
_MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _states(parts: dict[str, tuple[str, Column]]) -> dict[str, tuple[str, Column]]:
    """The mergeable states a rollup keeps, by column name: an average is a sum and a count."""
    out = {}
    for name, (fn, value) in parts.items():
        if fn == "avg":
            out[f"{name}__sum"], out[f"{name}__count"] = ("sum", value), ("count", value)
        elif fn in _MERGED:
            out[name] = (fn, value)
    return out


def read_rollup(spark: SparkSession, path: str, by: str | Sequence[str], measures: Aggs, number: int | None = None) -> DataFrame:
    """The stored rollup as plain columns: the keys and the measures."""
    rows, columns = read_version(spark, path, number), []
    for name, (fn, _) in _parts(measures).items():
        if fn == "avg":
            kind = rows.schema[f"{name}__sum"].dataType
            mean = col(f"{name}__sum") / F.when(col(f"{name}__count") > 0, col(f"{name}__count"))
            if isinstance(kind, T.DecimalType):
                # the type of avg, which has four digits more than its values; sums have ten
                mean = mean.cast(T.DecimalType(min(kind.precision - 6, 38), min(kind.scale + 4, 38)))
            columns.append(mean.alias(name))
        else:
            columns.append(col(name))
    return rows.select(*[col(k) for k in as_list(by)], *columns)


def refresh_rollup(
    fact: DataFrame,
    path: str,
    control: str,
    by: str | Sequence[str],
    measures: Aggs,
    part_by: str | Sequence[str] | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Bring a stored pre-aggregate up to date with the rows that the fact gained.

    Rows past the stored mark are aggregated to one state for each group they touch. Groups lie
    in ``buckets`` by hash of ``part_by`` (all keys by default; a period puts a day's groups
    together); only buckets with touched groups are read, merged and written, all others are
    taken over by name. Sums, counts, averages, minima and maxima are merged. Distinct counts
    and medians have no small state: those of the touched groups are computed again from the
    fact. The new version holds the mark, so a repeated call changes nothing.

    The fact must only grow past its mark: late rows are not seen (``recompute_check`` finds
    them). Rows with a null control value count in the first run only. An empty fact stores an
    empty rollup.
    """
    spark, keys, parts = fact.sparkSession, as_list(by), _parts(measures)
    require_columns(fact, [*keys, control, *as_list(part_by)], "refresh_rollup")
    placing = as_list(part_by) or keys
    outside = [k for k in placing if k not in keys]
    if outside:
        raise ValueError(f"refresh_rollup: {outside} are no keys of the groups")
    now = current_version(spark, path)
    mark = None if now is None else now.mark_literal()
    fresh = fact if mark is None else fact.where(col(control) > mark)
    states, again = _states(parts), {n: measures[n] for n, (fn, _) in parts.items() if fn in ("countd", "median")}
    again = {n: (s, n) if isinstance(s, str) else s for n, s in again.items()}
    seen = Observation()
    watched = fresh.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(col(control)).cast("string").alias("mark"))
    place = F.pmod(F.xxhash64(*[col(k) for k in placing]), F.lit(buckets)).cast("int") if placing else F.lit(0)
    # one row at least for each touched group, also when nothing is merged
    kept = {**states, "__rows": ("count", F.lit(1))}
    delta = cut(aggregate(watched, keys, kept).withColumn(BUCKET, place))
    got = _observed(seen)
    if now is not None and not got["rows"]:
        return read_rollup(spark, path, keys, measures)
    if not got["rows"]:
        delta = delta.limit(0)
    if again:
        touched = delta.select(*[col(k) for k in keys], BUCKET)
        mine = fact
        if now is not None and keys:
            # groups that the delta touches, null keys included
            names = {k: f"__key_{i}" for i, k in enumerate(keys)}
            known = touched.select(*[col(k).alias(names[k]) for k in keys])
            same = [col(k).eqNullSafe(col(names[k])) for k in keys]
            mine = fact.join(known, same, "left_semi")
        whole = aggregate(mine, keys, again)
        if keys:
            names = {k: f"__key_{i}" for i, k in enumerate(keys)}
            same = [col(k).eqNullSafe(col(n)) for k, n in names.items()]
            delta = delta.join(whole.withColumnsRenamed(names), same, "left").drop(*names.values())
        else:
            only = whole.first()
            delta = delta.withColumns({n: F.lit(only[n]).cast(whole.schema[n].dataType) for n in again})
    held = [*keys, *states, *again, "__rows"]
    schema = T.StructType([delta.schema[c] for c in [*held, BUCKET]])
    touched_buckets = [r[0] for r in delta.select(BUCKET).distinct().collect()]
    old, left = [], []
    for name in now.parts if now else []:
        (old if int(name.rsplit("=", 1)[1]) in touched_buckets else left).append(name)
    new = delta.select(*held, BUCKET, F.lit(1).alias("__new"))
    stored = now.struct() if now else schema
    both = new if not old else new.unionByName(_read_parts(spark, path, old, stored).withColumn("__new", F.lit(0)))
    merged = both.groupBy(*[col(k) for k in keys], BUCKET).agg(
        *[_MERGED[fn](col(n)).cast(schema[n].dataType).alias(n) for n, (fn, _) in states.items()],
        *[F.max_by(col(n), "__new").alias(n) for n in again],
        F.sum("__rows").alias("__rows"),
    )
    part, rows, _ = _store(merged.select(*held, BUCKET), path, [BUCKET], None)
    parts_now = left + [f"{part}/{BUCKET}={b}" for b in sorted(touched_buckets)]
    version = Version(
        (now.number if now else 0) + 1, "rollup", parts_now, schema.jsonValue(), [BUCKET],
        got["mark"] if got["mark"] is not None else (now.mark if now else None),
        fact.schema[control].dataType.simpleString(), None, rows, {},
    )
    _commit(spark, path, version)
    return read_rollup(spark, path, keys, measures, version.number)

