"""Compare a query with its SQL in DuckDB, as sets of rows with their copies.

Run as a script: ``python tests/compare.py <data folder> [query …]``.
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

#: The smallest sample tables.
DATA = "/root/testdata/sf0.001"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _kind(name: str) -> str:
    name = name.lower()
    for kinds, label in (
        (("bigint", "long", "hugeint"), "bigint"), (("int", "integer"), "int"), (("varchar", "string"), "text"),
        (("timestamp", "timestamp_ntz"), "timestamp"), (("double",), "double"),
    ):
        if name in kinds:
            return label
    return name


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 5) -> list[str]:
    result = con.execute(sql)
    theirs = [(d[0], _kind(str(d[1]))) for d in result.description]
    types = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    names = sorted(types)
    problems = []
    if sorted(n for n, _ in theirs) != names:
        return [f"columns {names} against {sorted(n for n, _ in theirs)}"]
    order = [[n for n, _ in theirs].index(n) for n in names]
    want = Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    got = Counter(tuple(_plain(r[n]) for n in names) for r in spark_df.collect())
    if want != got:
        problems.append(f"rows {sum(got.values())} against {sum(want.values())}")
        problems += [f"only in Spark: {dict(zip(names, r))}" for r in list((got - want))[:limit]]
        problems += [f"only in SQL: {dict(zip(names, r))}" for r in list((want - got))[:limit]]
    kinds = {n: (types[n], k) for n, k in theirs if types[n] != k}
    if kinds and not problems:
        print(f"    types differ: {kinds}")
    return problems


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from layerflow import build_session

    root, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(root), oracle_sql(), 0
    for name, run in queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            df = run(spark, root)
            found = differences(df, con, sqls[name]) if name in sqls else [] if df.count() >= 0 else []
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - start:.2f}s")
        for line in found:
            print("    " + line)
    print(f"{bad} queries differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
