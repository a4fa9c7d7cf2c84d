"""Column operations: everything a staging table may do."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from layerflow.functions.names import (
    as_list,
    col,
    require_columns,
    require_distinct,
    spark_type,
)


def rename(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rename in list order, so ``a→b, b→c`` moves ``a`` to ``c``. One projection."""
    names = list(df.columns)
    for old, new in pairs:
        if old not in names:
            raise ValueError(f"rename: no column {old!r} among {names}")
        names[names.index(old)] = new
        require_distinct(names, "rename")
    return df.toDF(*names)


def rename_back(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Restore original names at the mart edge. A pair names the base: a column that is the
    base, or the base plus ``_suffix``, gets the original base and keeps its suffix. The
    longest base that fits wins."""
    by_length = sorted(pairs, key=lambda p: len(p[0]), reverse=True)

    def restored(name: str) -> str:
        for base, original in by_length:
            if name == base or name.startswith(base + "_"):
                return original + name[len(base):]
        return name

    names = [restored(n) for n in df.columns]
    require_distinct(names, "rename_back")
    return df.toDF(*names)


def cast(df: DataFrame, types: Mapping[str, str], on_error: str = "null") -> DataFrame:
    """Change column types. ``on_error``: ``"null"`` keeps the row with a null, ``"fail"``
    stops the query."""
    require_columns(df, types, "cast")
    if on_error not in ("null", "fail"):
        raise ValueError("on_error must be 'null' or 'fail'")

    def typed(name: str):
        if name not in types:
            return col(name)
        wanted = spark_type(types[name])
        value = col(name).try_cast(wanted) if on_error == "null" else col(name).cast(wanted)
        return value.alias(name)

    return df.select(*[typed(n) for n in df.columns])


def hide(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    return df.drop(*as_list(columns))


def augment(df: DataFrame, transforms: Sequence[Mapping[str, str]]) -> DataFrame:
    """Column mapping of a staging table: ``rename``, ``cast`` and ``hide`` records keyed by
    the source name in brackets.

    Source order is kept; columns whose field metadata says ``isGenerated`` are left out; a
    name the source lacks is passed over; of several records for one column the later wins,
    but a hidden column stays hidden. A cast also sets the caption; without one the caption
    stays.
    """
    caption, datatype, hidden = {}, {}, set()
    for record in transforms:
        op = record["op"]
        if op not in ("rename", "cast", "hide"):
            raise ValueError(f"augment: {op!r} is no column operation")
        source = record["column_name"]
        if op == "hide":
            hidden.add(source)
            continue
        if op == "rename" or record.get("to_caption"):
            caption[source] = record["to_caption"]
        if op == "cast":
            datatype[source] = record["to_datatype"]

    mapped, names = [], []
    for field in df.schema.fields:
        source = f"[{field.name}]"
        if source in hidden or field.metadata.get("isGenerated"):
            continue
        name = caption.get(source) or field.metadata.get("caption") or field.name
        value = col(field.name)
        if source in datatype:
            value = value.try_cast(spark_type(datatype[source]))
        mapped.append(value.alias(name))
        names.append(name)
    require_distinct(names, "augment")
    return df.select(*mapped)
