"""Calendar grains without any dependence on the session time zone.

Every grain has an integer index, so gaps, chunks and increments are plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"hour": 3600, "minute": 60, "second": 1}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")

_EPOCH_DATE = "DATE'1970-01-01'"
_EPOCH_TIME = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _check(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")


def _days(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.expr(_EPOCH_DATE)).cast("bigint")


def period_index(ts: Column, grain: str) -> Column:
    """Whole periods since the epoch, as BIGINT."""
    _check(grain)
    if grain == "day":
        return _days(ts)
    if grain == "week":  # weeks start on Monday; 1970-01-01 was a Thursday
        return F.floor((_days(ts) + 3) / 7).cast("bigint")
    if grain in _MONTHS:
        months = (F.year(ts) * 12 + F.month(ts) - 1).cast("bigint")
        return months if grain == "month" else F.floor(months / _MONTHS[grain]).cast("bigint")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.floor((_days(ts) * 86400 + clock) / _SECONDS[grain]).cast("bigint")


def index_start(index: Column, grain: str) -> Column:
    """First instant of a period: DATE for grains of a day and above, else TIMESTAMP_NTZ."""
    _check(grain)
    if grain == "day":
        return F.date_add(F.expr(_EPOCH_DATE), index.cast("int"))
    if grain == "week":
        return F.date_add(F.expr(_EPOCH_DATE), (index * 7 - 3).cast("int"))
    if grain in _MONTHS:
        months = index * _MONTHS[grain]
        return F.make_date(
            F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1)
        )
    seconds = index * _SECONDS[grain]
    return F.expr(_EPOCH_TIME) + F.make_dt_interval(
        F.floor(seconds / 86400).cast("int"),
        F.lit(0),
        F.lit(0),
        F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"),
    )


def period_start(ts: Column, grain: str) -> Column:
    """The period a timestamp falls in, named by its first instant."""
    _check(grain)
    if grain == "day":
        return ts.cast("date")
    if grain == "week" or grain in _MONTHS:
        return F.trunc(ts.cast("date"), grain)
    return index_start(period_index(ts, grain), grain)
