"""Time expressions. Every operator takes ``as_of`` instead of reading the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = str | datetime


def timestamp_lit(value: AsOf) -> Column:
    """A timestamp literal read in the session time zone (folds at planning, so filters on it push down)."""
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp")


def days_before(as_of: AsOf, days: int, *, from_midnight: bool = True) -> Column:
    """``as_of`` minus ``days``; from midnight of that day unless ``from_midnight`` is off."""
    base = timestamp_lit(as_of)
    if from_midnight:
        base = F.date_trunc("day", base)
    return base - F.expr(f"INTERVAL {int(days)} DAYS")


def in_window(ts: str | Column, as_of: AsOf, days: int, *, from_midnight: bool = True) -> Column:
    """True for rows from the window start up to, not including, ``as_of``."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return (col >= days_before(as_of, days, from_midnight=from_midnight)) & (col < timestamp_lit(as_of))


def seconds_between(end: str | Column, start: str | Column) -> Column:
    """``end - start`` in seconds as a double, microseconds kept."""
    return (F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(1_000_000.0)


def hours_between(end: str | Column, start: str | Column) -> Column:
    return seconds_between(end, start) / F.lit(3600.0)


def hour_of_day(ts: str | Column) -> Column:
    return F.hour(_col(ts))


def day_of_week(ts: str | Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(_col(ts)) - F.lit(1)


def day_name(dow: str | Column) -> Column:
    # fixed values: English day names, Sunday first
    names = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (_col(dow) + 1).cast("int"))


def duration_label(seconds: str | Column) -> Column:
    """``12.5m`` below an hour, ``1.3h`` from there on."""
    s = _col(seconds)
    return F.when(s < 3600, F.format_string("%.1fm", s / F.lit(60.0))).otherwise(
        F.format_string("%.1fh", s / F.lit(3600.0))
    )


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
