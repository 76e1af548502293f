"""Indicators over bars. ``keys`` is the series; every indicator is computed for all series at once.

``shared`` as for ``segments.cut``: on for bars that come out of a shuffle, off for those read from a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from strikelake.functions import labels, prices
from strikelake.operators.segments import DAYS_PER_SEGMENT, Segmented, cut
from strikelake.schemas import SERIES

# Window lengths and factors of the indicators.
ROC_LENGTH = 20
ROC_DIVISOR = 2
BOLLINGER_LENGTH = 20
BOLLINGER_WIDTH = 2
OI_DIFF_LENGTH = 21
RANGE_PADDING = 0.05


# --- columns -------------------------------------------------------------------------------------

def roc_sum(
    x: Column | str, w: WindowSpec, length: int = ROC_LENGTH,
    divisor: float = ROC_DIVISOR, scale: float = 1,
) -> Column:
    """Sum of the relative changes against each of the last ``length`` rows, over ``divisor``.

    NULL until ``length`` earlier rows exist, and where one of them is zero or NULL. Every change is taken
    by itself, so a flat price gives exactly zero; all lags share one window.
    """
    v = prices.as_col(x)
    earlier = [F.lag(v, k).over(w) for k in range(1, length + 1)]
    changes = [F.try_divide(v - e, e) for e in earlier]
    return reduce(lambda a, b: a + b, changes) * (scale / divisor)


def bollinger(x: Column | str, w: WindowSpec, width: float = BOLLINGER_WIDTH) -> dict[str, Column]:
    """Mean and bands of a rolling frame; one row alone has no spread."""
    v = prices.as_col(x)
    mid = F.avg(v).over(w)
    spread = F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0)) * width
    return {"bb_mid": mid, "bb_upper": mid + spread, "bb_lower": mid - spread}


def leg_ratio_columns() -> dict[str, Column]:
    return {"ce_pe_ratio": prices.ratio("CE_close", "PE_close"),
            "oi_pcr": prices.ratio("PE_oi", "CE_oi")}


# --- running statistics --------------------------------------------------------------------------

def close_stats() -> dict[str, tuple[str, Column]]:
    return {
        "close_sum": ("sum", F.col("close")),
        "close_min": ("min", F.col("close")),
        "close_count": ("count", F.col("close")),
        "oi_sum": ("sum", F.col("oi")),
    }


def leg_stats() -> dict[str, tuple[str, Column]]:
    return {
        "ce_sum": ("sum", F.col("CE_close")),
        "pe_sum": ("sum", F.col("PE_close")),
        "ce_min": ("min", F.col("CE_close")),
        "pe_min": ("min", F.col("PE_close")),
    }


# The totals of a series up to a row, by the column of the result that shows each, from which a later run can go on.
RUNNING_TOTALS = {
    "close_sum": "cumulative_sum_close", "close_min": "cumulative_min_close", "close_count": "cumulative_count", "oi_sum": "cumulative_sum_oi",
    "ce_sum": "cumulative_sum_CE_close", "pe_sum": "cumulative_sum_PE_close", "ce_min": "running_min_ce", "pe_min": "running_min_pe",
    "MAX_incremental_close_avg": "MAX_incremental_close_avg", "rows": "rownum"}


def with_running_stats(seg: Segmented, df: DataFrame, legs: bool) -> DataFrame:
    """Running sums, averages and minima of a segmented frame, and the running maximum of the
    running average. The leg averages divide by the count of the combined close."""
    df = df.withColumns({
        "cumulative_sum_close": seg.running("close_sum"),
        "cumulative_count": seg.running("close_count"),
        "cumulative_sum_oi": seg.running("oi_sum"),
        "cumulative_min_close": seg.running("close_min"),
    })
    count = F.col("cumulative_count")
    averages = {
        "incremental_min_close": F.col("cumulative_min_close"),
        "incremental_close_avg": prices.ratio("cumulative_sum_close", count),
        "incremental_oi_avg": prices.ratio("cumulative_sum_oi", count),
    }
    if legs:
        df = df.withColumns({"cumulative_sum_CE_close": seg.running("ce_sum"), "cumulative_sum_PE_close": seg.running("pe_sum")})
        averages |= {
            "incremental_CE_close_avg": prices.ratio("cumulative_sum_CE_close", count),
            "incremental_PE_close_avg": prices.ratio("cumulative_sum_PE_close", count),
            "running_min_ce": seg.running("ce_min"),
            "running_min_pe": seg.running("pe_min"),
        }
    df = df.withColumns(averages)
    df = seg.add_running(df, MAX_incremental_close_avg=("max", F.col("incremental_close_avg")))
    return df.withColumn(
        "trailing_sl",
        prices.trailing_stop_line(F.col("incremental_min_close"), F.col("incremental_close_avg")))


def running_stats(bars: DataFrame, keys: Sequence[str] = SERIES, legs: bool = True,
                  days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    carry = {**close_stats(), **(leg_stats() if legs else {})}
    seg = cut(bars, keys, carry=carry, days=days, shared=shared)
    return seg.finish(with_running_stats(seg, seg.df, legs))


# --- stand-alone indicators ----------------------------------------------------------------------

def roc_average(bars: DataFrame, columns: Sequence[str] = ("close", "CE_close", "PE_close"),
                keys: Sequence[str] = SERIES, order: str | Sequence[str] = "date",
                length: int = ROC_LENGTH, divisor: float = ROC_DIVISOR, scale: float = 1,
                days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """``ROC_AVG_<column>`` for each column, with one sort for all of them."""
    seg = cut(bars, keys, order=order, lookback=length, days=days, shared=shared)
    rocs = {f"ROC_AVG_{c}": roc_sum(c, seg.window, length, divisor, scale) for c in columns}
    out = seg.finish(seg.df.withColumns(rocs))
    if {"CE_close", "PE_close"} <= set(columns):
        out = out.withColumn(
            "ROC_AVG_CEPE_AVG", (F.col("ROC_AVG_CE_close") + F.col("ROC_AVG_PE_close")) / 2)
    return out


def bollinger_bands(bars: DataFrame, keys: Sequence[str] = SERIES, length: int = BOLLINGER_LENGTH,
                    days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    seg = cut(bars, keys, lookback=length, days=days, shared=shared)
    return seg.finish(seg.df.withColumns(bollinger("close", seg.rolling(length))))


def weighted_prices(bars: DataFrame, keys: Sequence[str] = SERIES,
                    days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """Running price weighted by volume (``vwap``) and by open interest (``oiwap``)."""
    seg = cut(bars, keys, carry=weight_stats(), days=days, shared=shared)
    return seg.finish(seg.df.withColumns(weighted_price_columns(seg)))


def weight_stats() -> dict[str, tuple[str, Column]]:
    close = F.col("close")
    return {
        "pv": ("sum", close * F.col("volume")), "v": ("sum", F.col("volume")),
        "po": ("sum", close * F.col("oi")), "o": ("sum", F.col("oi")),
    }


def weighted_price_columns(seg: Segmented) -> dict[str, Column]:
    def shown(weight: str, value: Column) -> Column:
        return F.when(F.col("close").isNotNull() & F.col(weight).isNotNull(), value)
    return {
        "vwap": shown("volume", prices.weighted_average(seg.running("pv"), seg.running("v"))),
        "oiwap": shown("oi", prices.weighted_average(seg.running("po"), seg.running("o"))),
    }


def leg_ratios(bars: DataFrame) -> DataFrame:
    return bars.withColumns(leg_ratio_columns())


def oi_difference(bars: DataFrame, keys: Sequence[str] = SERIES, length: int = OI_DIFF_LENGTH,
                  days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """Put minus call open interest and its rolling mean."""
    seg = cut(bars.withColumn("oi_diff", F.col("PE_oi") - F.col("CE_oi")), keys,
              lookback=length, days=days, shared=shared)
    return seg.finish(seg.df.withColumn("oi_diff_avg", F.avg("oi_diff").over(seg.rolling(length))))


def roc_expanding(bars: DataFrame, keys: Sequence[str] = SERIES,
                  days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """Mean of all ``ROC_AVG_close`` values so far."""
    roc = F.col("ROC_AVG_close")
    seg = cut(bars, keys, lookback=ROC_LENGTH, days=days, shared=shared)
    df = seg.df.withColumn("ROC_AVG_close", roc_sum("close", seg.window))
    df = seg.add_running(df, _sum=("sum", roc), _count=("count", roc))
    mean = F.try_divide(F.col("_sum"), F.nullif(F.col("_count"), F.lit(0).cast("bigint")))
    return seg.finish(df.withColumn("roc_mean", mean).drop("_sum", "_count"))


def premium_decay(bars: DataFrame, keys: Sequence[str] = SERIES,
                  days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """Change in percent from the first close of the series."""
    seg = cut(bars, keys, carry={"first": ("first", F.col("close"))}, days=days, shared=shared)
    first = seg.running("first")
    pct = F.try_divide(F.col("close") - first, first) * 100
    return seg.finish(seg.df.withColumn("premium_decay_pct", pct))


def extra_indicators(bars: DataFrame, keys: Sequence[str] = SERIES,
                     days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """Bands, leg ratios, open-interest difference, weighted prices and decay in one pass."""
    seg = cut(bars.withColumn("oi_diff", F.col("PE_oi") - F.col("CE_oi")), keys,
              lookback=OI_DIFF_LENGTH, days=days, shared=shared,
              carry={**weight_stats(), "first": ("first", F.col("close"))})
    first = seg.running("first")
    out = seg.df.withColumns({
        **bollinger("close", seg.rolling(BOLLINGER_LENGTH)),
        **leg_ratio_columns(),
        "oi_diff_avg": F.avg("oi_diff").over(seg.rolling(OI_DIFF_LENGTH)),
        **weighted_price_columns(seg),
        "premium_decay_pct": F.try_divide(F.col("close") - first, first) * 100,
    })
    return seg.finish(out)


def day_boundaries(bars: DataFrame, keys: Sequence[str] = SERIES,
                   days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """Bars whose calendar date differs from the bar before, with their axis label."""
    seg = cut(bars, keys, lookback=1, days=days, shared=shared)
    today = F.to_date("date")
    changed = today != F.lag(today).over(seg.window)
    return (seg.finish(seg.df.withColumn("_changed", changed))
            .where("_changed").drop("_changed")
            .withColumns({"x_label": labels.axis_label("date"),
                          "time_label": labels.axis_label("date", with_day=False)}))


def numbered(bars: DataFrame, keys: Sequence[str] = SERIES,
             days: int = DAYS_PER_SEGMENT, shared: bool = True) -> DataFrame:
    """Add ``rownum``, 1 for the first bar of each series."""
    seg = cut(bars, keys, days=days, shared=shared)
    return seg.finish(seg.df.withColumn("rownum", seg.rownum()))


# --- one row per series --------------------------------------------------------------------------

def latest_values(bars: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """The newest value of each column and its chart label; NULLs are passed over."""
    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    out = bars.groupBy(*keys).agg(
        F.max("date").alias("date"), *[newest(c).alias(c) for c in columns])
    return out.withColumns({f"{c}_label": labels.value_label(F.col(c).cast("double")) for c in columns})


def candle_summary(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("close") >= F.col("open"), F.lit(False))).alias("green"),
    ).withColumn("red", F.col("total") - F.col("green"))


def series_range(bars: DataFrame, a: str, b: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Axis limits around two columns: 5 % padding, or 1 where all values agree."""
    lo = F.least(F.min(a), F.min(b)).cast("double")
    hi = F.greatest(F.max(a), F.max(b)).cast("double")
    out = bars.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
    pad = F.when(F.col("hi") != F.col("lo"), (F.col("hi") - F.col("lo")) * RANGE_PADDING).otherwise(1.0)
    return out.select(*keys, (F.col("lo") - pad).alias("axis_min"), (F.col("hi") + pad).alias("axis_max"))
