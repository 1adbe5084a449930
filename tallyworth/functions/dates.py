"""Dates and timestamps from their parts; impossible parts give null rather than an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(text: Column, position: int) -> Column:
    return F.split_part(text, F.lit(":"), F.lit(position)).try_cast("int")


def _second(text: Column) -> Column:
    """Seconds, 0 where the text stops at the minute. Casting the missing part instead would work too, but a
    failed cast costs some hundred times a good one."""
    return F.when(F.split_part(text, F.lit(":"), F.lit(3)) == "", F.lit(0)).otherwise(_part(text, 3))


def time_text(column: str) -> Column:
    """`7:05` or `07:05` to `07:05:00`."""
    text = F.col(column)
    hour, minute = _part(text, 1), _part(text, 2)
    second = _second(text)
    return F.when(
        hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59),
        F.concat_ws(":", *(F.lpad(p.cast("string"), 2, "0") for p in (hour, minute, second))),
    )


def timestamp_of(year: str, month: str, day: str, time: str) -> Column:
    """Timestamp without zone from integer date parts and `HH:mm` or `HH:mm:ss` text."""
    text = F.col(time)
    return F.try_make_timestamp_ntz(
        F.col(year), F.col(month), F.col(day),
        _part(text, 1), _part(text, 2), _second(text).cast("decimal(16,6)"),
    )


def date_of(year: str, month: str, day: str) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(
        F.col(year), F.col(month), F.col(day), zero, zero, zero.cast("decimal(16,6)")
    ).cast("date")
