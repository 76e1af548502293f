"""Price arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(x: Column | str) -> Column:
    """Round half up to 2 places. Going through DECIMAL makes 1.005 round up although the
    nearest double lies below it."""
    return F.round(as_col(x).cast("decimal(18,6)"), 2).cast("double")


def ohlc4(o="open", h="high", l="low", c="close") -> Column:
    return round2((as_col(o) + as_col(h) + as_col(l) + as_col(c)) / 4)


def ratio(num: Column | str, den: Column | str) -> Column:
    """NULL where the denominator is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def weighted_average(sum_xw: Column, sum_w: Column) -> Column:
    return F.try_divide(sum_xw, F.nullif(sum_w.cast("double"), F.lit(0.0)))


def trailing_stop_line(running_min: Column, running_avg: Column) -> Column:
    """Half way between the lowest close so far and the average close so far."""
    return (running_min + running_avg) / 2


def profit(last: Column | str, average: Column | str, quantity: Column | str) -> Column:
    return (as_col(last) - as_col(average)) * as_col(quantity)
