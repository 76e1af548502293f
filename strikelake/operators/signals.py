"""Stop loss and entry rules over straddle bars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelake.operators import indicators as ind
from strikelake.operators.segments import DAYS_PER_SEGMENT, Segmented, cut
from strikelake.schemas import SERIES


def raw_stop() -> Column:
    """The stop of one bar, before it is held down over the day.

    The running averages and minima and ``ROC_AVG_close`` must be on the row. A NULL in a condition
    (the first bars have no ROC) counts as not met.
    """
    ce, pe, high = F.col("CE_close"), F.col("PE_close"), F.col("high")
    ce_avg, pe_avg = F.col("incremental_CE_close_avg"), F.col("incremental_PE_close_avg")
    ceiling = F.col("MAX_incremental_close_avg")
    floor = F.col("trailing_sl")

    rising = F.col("ROC_AVG_close") > 0
    breakout = rising & (F.greatest(ce, pe) > F.greatest(ce_avg, pe_avg))
    call_low = (ce == F.col("running_min_ce")) & (ce > pe) & (F.col("CE_oi") < F.col("PE_oi"))
    put_low = (pe == F.col("running_min_pe")) & (pe > ce) & (F.col("CE_oi") > F.col("PE_oi"))

    # Either event lifts the stop to the bar's high, otherwise it rests on the ceiling.
    stop = F.when(call_low | put_low | breakout, high).otherwise(ceiling)
    stop = F.when(stop > ceiling, ceiling).otherwise(stop)
    # Below the trailing line it is pulled up to the mean of the three levels.
    lifted = (floor * 2 + stop) / 3
    return F.when(stop < floor, lifted).otherwise(stop)


def entry_columns(first_ce: Column, first_pe: Column) -> dict[str, Column]:
    """``Open_Max_Close`` and ``EntryAllowed`` from the first leg closes of the day."""
    opening = F.when(first_ce >= first_pe, first_ce).otherwise(first_pe)
    above_open = (F.col("CE_close") > opening) | (F.col("PE_close") > opening)
    blocked = above_open & (F.col("close") > F.col("trailing_sl"))
    return {"CE_close_On_Open": first_ce, "PE_close_On_Open": first_pe, "Open_Max_Close": opening,
            "EntryAllowed": F.when(blocked, F.lit(None).cast("double")).otherwise(F.col("close"))}


# Which rows the running statistics span.
LATEST, DAY, WHOLE = "latest", "day", "series"


def _displayed(
    bars: DataFrame, keys: Sequence[str], frame: str, legs: bool, days: int, shared: bool,
    warmup: Column | None = None, initial: DataFrame | None = None,
) -> tuple[Segmented, DataFrame]:
    """Rate of change over the whole history, then running statistics over the frame.

    The order matters: the rate of change of the first bars of a day reads the days before, while
    the running statistics start with the first bar of the frame.
    """
    if frame not in (LATEST, DAY, WHOLE):
        raise ValueError(f"unknown frame {frame!r}")
    stats = {**ind.close_stats(), **(ind.leg_stats() if legs else {})}
    needed = ["date", "CE_close", "PE_close"] if legs else ["date"]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    seg = cut(bars, keys, lookback=ind.ROC_LENGTH, carry=stats if frame == WHOLE else None, days=days,
              keep=complete, number_days="day_num" not in bars.columns, shared=shared,
              warmup=warmup, initial=initial)
    seg.carried = stats
    columns = ["close", "CE_close", "PE_close"] if legs else ["close"]
    # The middle line of older charts: always zero, kept for those that read it.
    df = seg.df.withColumn("MidPoint", F.lit(0))
    df = df.withColumns({
        **{f"ROC_AVG_{c}": ind.roc_sum(c, seg.window) for c in columns},
        "IS_LATEST_DAY": seg.is_latest_day()})
    if legs:
        df = df.withColumn("ROC_AVG_CEPE_AVG",
                           (F.col("ROC_AVG_CE_close") + F.col("ROC_AVG_PE_close")) / 2)
    if frame == LATEST:
        df = df.where("IS_LATEST_DAY")
    if frame != WHOLE:
        df = seg.restart(df)
    df = df.withColumn("rownum", seg.rownum())
    return seg, ind.with_running_stats(seg, df, legs)


def straddle_signals(
    bars: DataFrame, keys: Sequence[str] = SERIES, frame: str = LATEST,
    days: int = DAYS_PER_SEGMENT, shared: bool = True, warmup: Column | None = None, initial: DataFrame | None = None,
) -> DataFrame:
    """All straddle analytics for every series: ROC, running statistics, StopLoss, EntryAllowed.

    Bars without a time or without either leg are dropped; unless ``bars`` has a ``day_num`` already,
    their days are numbered before that.

    ``frame`` is ``latest`` (rows of the last trading day), ``day`` (all days, each on its own) or
    ``series`` (all days as one running frame). ``shared``, ``warmup`` and ``initial`` as for
    ``segments.cut``: the last goes on from ``indicators.RUNNING_TOTALS`` of an earlier run.
    """
    if initial is not None and frame != WHOLE:
        raise ValueError("only the frame of a whole series goes on from earlier totals")
    seg, df = _displayed(bars, keys, frame, legs=True, days=days, shared=shared, warmup=warmup, initial=initial)
    in_day = seg.day_window()
    df = df.withColumn("_raw_stop", raw_stop())
    df = df.withColumns({
        "StopLoss": F.min("_raw_stop").over(in_day),
        **entry_columns(F.first("CE_close").over(in_day), F.first("PE_close").over(in_day)),
    })
    return seg.finish(df.drop("_raw_stop"))


def leg_signals(
    bars: DataFrame, keys: Sequence[str] = SERIES, frame: str = LATEST,
    days: int = DAYS_PER_SEGMENT, shared: bool = False,
) -> DataFrame:
    """Single-leg analytics: ROC and running statistics, no stop and no entry rule."""
    seg, df = _displayed(bars, keys, frame, legs=False, days=days, shared=shared)
    return seg.finish(df)


def compat_names(signals: DataFrame) -> DataFrame:
    """The column names charts of older versions read. The two MAX columns hold running minima."""
    return signals.withColumnsRenamed({
        "running_min_ce": "cumulative_MAX_CE_close", "running_min_pe": "cumulative_MAX_PE_close"})

