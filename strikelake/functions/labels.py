"""Text labels and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikelake.functions.prices import as_col


def axis_label(ts: Column | str, with_day: bool = True) -> Column:
    """``11-Mar 09:15``, or ``09:15`` alone."""
    return F.date_format(as_col(ts), "dd-MMM HH:mm" if with_day else "HH:mm")


def value_label(x: Column | str) -> Column:
    """Two decimals with thousands separators; none from a million up."""
    v = as_col(x)
    return F.when(F.abs(v) >= 1_000_000, F.format_number(v, 0)).otherwise(F.format_number(v, 2))


def pair_label(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws(", ", as_col(a).cast("string"), as_col(b).cast("string"))


def lookback_days(as_of: Column | str, days: int) -> Column:
    """History window in days: one more on a Saturday, two more on a Sunday."""
    wd = F.weekday(as_col(as_of))
    return F.lit(days) + F.when(wd == 5, 1).when(wd == 6, 2).otherwise(0)


def synthetic_time(rownum: Column | str, base: str = "2026-01-01 09:15:00", minutes: int = 3) -> Column:
    """A bar time made from the row number, for rows that carry none."""
    mins = (as_col(rownum) * minutes).cast("int")
    return F.lit(base).cast("timestamp_ntz") + F.make_interval(mins=mins)


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(as_col(ts)) * 60 + F.minute(as_col(ts))
