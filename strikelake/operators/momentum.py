"""Momentum comparison of two symbols, smoothed bars, time-frame alignment and RSI."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelake.functions import prices
from strikelake.operators import indicators as ind
from strikelake.operators.segments import DAYS_PER_SEGMENT, cut

# Fixed values.
ROC_SCALE = 100
RANGE_LENGTH = 21
RSI_LENGTH = 14
RSI_LOW, RSI_HIGH = 30, 70
SMOOTHING = 0.5

OHLC = ("open", "high", "low", "close")


def ratio_bars(bars: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars of one symbol divided, price by price, by those of another at the same time.

    ``keys`` pair the two; an inner join on (keys, date).
    """
    other = base.select(*keys, "date", *[F.col(c).alias(f"_b_{c}") for c in OHLC])
    joined = bars.select(*keys, "day", "date", *OHLC).join(other, [*keys, "date"])
    return joined.select(
        *keys, "day", "date", *[prices.ratio(c, f"_b_{c}").alias(c) for c in OHLC])


def smoothed_close(o="open", h="high", l="low", c="close") -> Column:
    return (F.col(o) + F.col(h) + F.col(l) + F.col(c)) / 4


def heikin_ashi(bars: DataFrame, keys: Sequence[str], days: int = DAYS_PER_SEGMENT) -> DataFrame:
    """Smoothed bars: the close is the mean price of the bar, the open the mean of the smoothed
    open and close of the bar before, starting from the mean of the first open and close.

    Every bar maps the open before it to the next one, ``x -> x / 2 + close / 2``; these maps are carried over segments
    as one map, so the recursion is followed from the first bar on. A bar that lacks a price has no smoothed prices
    and changes nothing for the bars after it.
    """
    bars = bars.withColumn("ha_close", smoothed_close())
    priced = F.col("ha_close").isNotNull()
    seg = cut(bars, keys, days=days, carry={
        "seed": ("first", F.when(priced, (F.col("open") + F.col("close")) / 2)),
        "open": ("decay", F.col("ha_close") * SMOOTHING, SMOOTHING)})
    df = seg.df.withColumn("_seed", seg.running("seed"))
    df = seg.add_decayed(df, "ha_open", "open", F.col("_seed"), before_row=True)
    df = df.withColumn("ha_open", F.when(priced, F.col("ha_open"))).withColumns({
        "ha_high": F.when(priced, F.greatest("high", "ha_open", "ha_close")),
        "ha_low": F.when(priced, F.least("low", "ha_open", "ha_close")),
    })
    return seg.finish(df.drop("_seed"))


def roc_mean(bars: DataFrame, column: str, keys: Sequence[str], length: int = ind.ROC_LENGTH,
             days: int = DAYS_PER_SEGMENT, shared: bool = False) -> DataFrame:
    """Mean rate of change in percent over the last ``length`` rows."""
    seg = cut(bars, keys, lookback=length, days=days, shared=shared)
    value = ind.roc_sum(column, seg.window, length, divisor=length, scale=ROC_SCALE)
    return seg.finish(seg.df.withColumn("roc_mean", value))


def as_of(chart: DataFrame, coarse: DataFrame, value: str, visible: str, keys: Sequence[str],
          days: int = DAYS_PER_SEGMENT) -> DataFrame:
    """The newest coarse value that was known at each chart bar.

    ``visible`` is the time a coarse value becomes known (the close of its bar). Both sides are put
    in one frame and the value is carried forward, so there is no range join: every row is
    shuffled once, and a hot series is split into segments.
    """
    keys = list(keys)
    known = coarse.select(*keys, F.col(visible).alias("date"), F.col(value).alias("_value"),
                          F.lit(0).alias("_side"))
    rows = (chart.withColumn("_value", F.lit(None).cast(coarse.schema[value].dataType))
            .withColumn("_side", F.lit(1))
            .unionByName(known, allowMissingColumns=True)
            .withColumn("_day", F.to_date("date")))
    seg = cut(rows, keys, order=["date", "_side"], day="_day",
              carry={"value": ("last", F.col("_value"))}, days=days)
    out = seg.finish(seg.df.withColumn(f"{value}_asof", seg.running("value")))
    return out.where(F.col("_side") == 1).drop("_value", "_side", "_day")


def base_average(columns: Sequence[Column]) -> Column:
    """Mean of the enabled comparisons; NULL as soon as one of them is."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / F.lit(float(len(columns)))


def mmi(base: DataFrame, keys: Sequence[str], column: str = "base_avg", length: int = RANGE_LENGTH,
        days: int = DAYS_PER_SEGMENT, shared: bool = False) -> DataFrame:
    """Momentum lines from the base average.

    ``neg_mmi`` is the distance below the highest, ``pos_mmi`` the distance above the lowest value
    of the last ``length`` bars, both measured from zero at least. ``crosspoint`` holds the middle
    of the two lines where they last crossed; ``signal_up`` is the bar colour.
    """
    seg = cut(base, keys, lookback=length + 1, days=days, shared=shared)
    w, x = seg.window, F.col(column)
    df = seg.df.withColumn("rownum", seg.rownum())
    # A halo row has no own number, but it always lies a full frame behind the first own row.
    full = (F.count(F.lit(1)).over(seg.rolling(length)) == length)
    highest = F.when(full, F.max(x).over(seg.rolling(length)))
    lowest = F.when(full, F.min(x).over(seg.rolling(length)))
    df = df.withColumns({"_hi": highest, "_lo": lowest})
    zero = F.lit(0.0)
    df = df.withColumns({
        "neg_mmi": F.when(F.col("_hi").isNotNull(), F.greatest("_hi", zero)) - x,
        "pos_mmi": x - F.when(F.col("_lo").isNotNull(), F.least("_lo", zero)),
    })
    pos, neg = F.col("pos_mmi"), F.col("neg_mmi")
    pos_before, neg_before = F.lag(pos).over(w), F.lag(neg).over(w)
    crossed = (((pos > neg) & (pos_before <= neg_before)) | ((pos < neg) & (pos_before >= neg_before)))
    df = df.withColumn("crossed", F.coalesce(crossed, F.lit(False)))
    df = seg.add_running(df, crosspoint=("last", F.when(F.col("crossed"), (pos + neg) / 2)))
    df = df.withColumn("signal_up", F.coalesce((pos >= neg) | (x >= 0), F.lit(False)))
    return seg.finish(df.drop("_hi", "_lo"))


def latest_reading(momentum: DataFrame, keys: Sequence[str], column: str = "base_avg") -> DataFrame:
    """The base average of the last bar, rounded to 2, with its colour."""
    return (momentum.groupBy(*keys)
            .agg(F.max_by(F.struct("date", column, "signal_up"), F.col("date")).alias("r"))
            .select(*keys, F.col("r.date").alias("date"),
                    prices.round2(F.col(f"r.{column}")).alias("reading"), "r.signal_up"))


def rsi(bars: DataFrame, keys: Sequence[str], length: int = RSI_LENGTH,
        days: int = DAYS_PER_SEGMENT) -> DataFrame:
    """Relative strength of the last bar of each series, with its last two closes.

    A gain is measured against the close before, a loss against the current close. The average
    starts as the mean of the first ``length`` changes; each later change enters with weight
    ``1/length`` and shrinks what came before by ``(length-1)/length``. Written out, the average at
    the last bar is a weighted sum over all changes whose weight depends only on the distance to the
    last bar, so it is an ordinary aggregation with a map-side combine.
    """
    keys = list(keys)
    seg = cut(bars, keys, lookback=1, days=days)
    close, before = F.col("close"), F.lag("close").over(seg.window)
    df = seg.finish(seg.df.withColumns(
        {"rownum": seg.rownum(), "bars": seg.rows_in_series(), "_before": before}))
    gain, loss = _gain(close, F.col("_before")), _loss(close, F.col("_before"))
    change = F.col("rownum") - 1
    distance = F.col("bars") - 1 - F.greatest(change, F.lit(length))
    weight = F.when(change >= 1, F.pow(F.lit((length - 1) / length), distance) / length)
    newest = F.struct("date")
    out = df.groupBy(*keys).agg(
        F.max("bars").alias("bars"),
        F.sum(gain * weight).alias("avg_gain"),
        F.sum(loss * weight).alias("avg_loss"),
        F.max_by("close", newest).alias("last_close"),
        F.max_by("_before", newest).alias("previous_close"),
    )
    return out.select(*keys, "bars", _reading(length).alias("rsi"), "last_close", "previous_close")


def _gain(close: Column, before: Column) -> Column:
    return F.when(close > before, F.try_divide(close - before, before)).otherwise(0.0) * 100


def _loss(close: Column, before: Column) -> Column:
    return F.when(close > before, 0.0).otherwise(F.try_divide(before - close, close)) * 100


def _reading(length: int) -> Column:
    """The index from ``bars``, ``avg_gain`` and ``avg_loss``; NULL until there are ``length`` changes."""
    return prices.round2(
        F.when(F.col("bars") <= length, F.lit(None))
        .when(F.col("avg_loss") == 0, 100.0)
        .otherwise(100 - 100 / (1 + F.col("avg_gain") / F.nullif(F.col("avg_loss"), F.lit(0.0)))))


# What is known of a series at the end of a day: its number of bars, the averages so far (sums over ``length`` during the
# first changes), and its last two closes.
RSI_STATE = ["bars", "avg_gain", "avg_loss", "last_close", "previous_close"]


def rsi_states(bars: DataFrame, prior: DataFrame, keys: Sequence[str], length: int = RSI_LENGTH) -> DataFrame:
    """The state of each series at the end of every day in ``bars``, as ``RSI_STATE``, and in ``start`` that before the day.

    ``prior`` holds the state of a series before its first bar here, as ``RSI_STATE`` under its keys; a series that is not
    in it starts anew. A change enters with a weight that depends on its number and on that of the day's last change only, so
    a day is one aggregation by (series, day); the days of a series, one row each, are then folded in order.
    """
    keys = list(keys)
    in_day = Window.partitionBy(*keys, "day").orderBy("date")
    rows = bars.select(*keys, "day", "date", "close").withColumns({"_own": F.lag("close").over(in_day), "_nth": F.row_number().over(in_day)})
    days = rows.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("_n"), F.max_by("close", "date").alias("_last"))
    series = Window.partitionBy(*keys).orderBy("day")
    earlier = F.coalesce(F.sum("_n").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = (days.join(prior.select(*keys, F.struct(*RSI_STATE).alias("_prior")), keys, "left")
            .withColumn("_base", earlier + F.coalesce(F.col("_prior.bars"), F.lit(0)))
            .withColumn("_entered", F.when(F.lag("day").over(series).isNull(), F.col("_prior.last_close")).otherwise(F.lag("_last").over(series))))
    rows = rows.join(days.select(*keys, "day", "_n", "_base", "_entered"), [*keys, "day"])
    before = F.when(F.col("_nth") == 1, F.col("_entered")).otherwise(F.col("_own"))
    change, newest = F.col("_base") + F.col("_nth") - 1, F.col("_base") + F.col("_n") - 1
    keep = F.lit((length - 1) / length)
    distance = F.greatest(newest, F.lit(length)) - F.greatest(change, F.lit(length))
    weight = F.when(change >= 1, F.pow(keep, distance) / length)
    close = F.col("close")
    rows = rows.withColumns({"_before": before, "_gain": _gain(close, before) * weight, "_loss": _loss(close, before) * weight})
    sums = rows.groupBy(*keys, "day").agg(
        F.max(newest + 1).alias("bars"), F.coalesce(F.sum("_gain"), F.lit(0.0)).alias("gain"), F.coalesce(F.sum("_loss"), F.lit(0.0)).alias("loss"),
        F.max_by("close", "date").alias("last_close"), F.max_by("_before", "date").alias("previous_close"))
    listed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "bars", "gain", "loss", "last_close", "previous_close"))).alias("_days"))
    listed = listed.join(prior.select(*keys, F.struct(*RSI_STATE).alias("_prior")), keys, "left")
    nothing = F.struct(F.lit(0).cast("bigint").alias("bars"), F.lit(0.0).alias("avg_gain"), F.lit(0.0).alias("avg_loss"),
                       F.lit(None).cast("double").alias("last_close"), F.lit(None).cast("double").alias("previous_close"))
    start = F.when(F.col("_prior.bars").isNull(), nothing).otherwise(F.col("_prior"))

    def advanced(state: Column, day: Column) -> Column:
        shrink = F.pow(keep, F.greatest(day["bars"] - 1, F.lit(length)) - F.greatest(state["bars"] - 1, F.lit(length)))
        return F.struct(day["bars"].alias("bars"), (state["avg_gain"] * shrink + day["gain"]).alias("avg_gain"),
                        (state["avg_loss"] * shrink + day["loss"]).alias("avg_loss"), day["last_close"].alias("last_close"),
                        day["previous_close"].alias("previous_close"))

    def step(acc: Column, day: Column) -> Column:
        now = advanced(acc["now"], day)
        entry = F.struct(day["day"].alias("day"), acc["now"].alias("start"), now.alias("end"))
        return F.struct(now.alias("now"), F.concat(acc["days"], F.array(entry)).alias("days"))

    state = F.struct(*[F.col(f"start.{c}").cast(t).alias(c) for c, t in zip(RSI_STATE, ("bigint", *["double"] * 4))])
    listed = listed.withColumn("start", start).withColumn("start", state)
    empty = F.slice(F.array(F.struct(F.lit(None).cast("date").alias("day"), F.col("start").alias("start"), F.col("start").alias("end"))), 1, 0)
    folded = F.aggregate("_days", F.struct(F.col("start").alias("now"), empty.alias("days")), step)["days"]
    return listed.select(*keys, F.inline(folded)).select(*keys, "day", *[F.col(f"end.{c}").alias(c) for c in RSI_STATE], "start")


def rsi_readings(states: DataFrame, keys: Sequence[str], length: int = RSI_LENGTH) -> DataFrame:
    """The index of each series at its latest state."""
    latest = states.groupBy(*keys).agg(F.max_by(F.struct("day", *RSI_STATE, "start"), "day").alias("s")).select(*keys, "s.*")
    return latest.withColumn("rsi", _reading(length))


def rsi_scan(readings: DataFrame, low: float = RSI_LOW, high: float = RSI_HIGH) -> DataFrame:
    """Oversold and turning up is a signal; otherwise the reading falls in a band."""
    r = F.col("rsi")
    turning = (r < low) & (F.col("last_close") > F.col("previous_close"))
    return readings.withColumns({
        "buy_signal": F.coalesce(turning, F.lit(False)),
        "band": F.when(r > high, "high").when(r < low, "low").when(r.isNotNull(), "neutral"),
    })
