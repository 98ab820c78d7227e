"""Ratios, rounding and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as a double, null where the denominator is zero."""
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


def percent(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    return F.round(ratio(num, den) * 100.0, digits)


def kilobytes(size: str | Column, digits: int = 2) -> Column:
    return F.round(_col(size) / F.lit(1024.0), digits)


def megabytes(size: str | Column, digits: int = 2) -> Column:
    return F.round(_col(size) / F.lit(1048576.0), digits)


def pretty_size(size: str | Column) -> Column:
    """Human-readable size in whole units; a unit is used from 10240 of the next smaller one (rounded) on."""
    s = _col(size).cast("long")
    out = F.format_string("%d bytes", s)
    # fixed values: unit names, smallest first
    for power, unit in enumerate(["kB", "MB", "GB", "TB", "PB"], start=1):
        half_unit = 512 * 1024 ** (power - 1)
        from_size = 10_240 if power == 1 else 20_479 * (half_unit // 1024)
        units = F.shiftright(F.shiftright(s, 10 * power - 1) + F.lit(1), 1)
        out = F.when(s >= from_size, F.format_string(f"%d {unit}", units)).otherwise(out)
    return out


def first_label(*rules: tuple[Column, str], otherwise: str) -> Column:
    """Label of the first rule that holds."""
    cond, label = rules[0]
    out = F.when(cond, F.lit(label))
    for cond, label in rules[1:]:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def labels_that_hold(*rules: tuple[Column, str]) -> Column:
    """Array of the labels of all rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in rules]))
