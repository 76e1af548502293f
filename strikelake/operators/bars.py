"""Bars: from ticks, from legs, by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelake.functions import labels, prices
from strikelake.operators import segments
from strikelake.schemas import CALL, LEG, PUT, SERIES


def ohlc_bars(ticks: DataFrame, width: str, keys: Sequence[str] = LEG) -> DataFrame:
    """Ticks (``ts, event_id, price, k``) to OHLC bars with volume and open interest.

    One aggregation with a map-side combine, so a contract with a third of all ticks costs its
    shuffle no more than its number of bars.
    """
    at = F.struct("ts", "event_id")
    return (
        ticks.groupBy(*keys, F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).alias("volume"),
            F.sum("k").alias("oi"),
        )
        .withColumn("date", F.col("w.start"))
        .drop("w")
        .withColumn("day", F.to_date("date"))
    )


def latest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the one with the greatest ``version``, and of equal ones the greatest by all other columns, so that the
    choice never depends on the order of the rows. Aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != version]
    return (df.groupBy(*keys)
            .agg(F.max(F.struct(version, *rest)).alias("r"))
            .select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns]))


def traded(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("volume") > 0)


def clean_bars(bars: DataFrame, version: str | None = None) -> DataFrame:
    """Traded bars, one per contract and bar time."""
    rows = traded(bars)
    if version is None:
        return rows.dropDuplicates(["instrument_token", "expiry", "date"])
    return latest_version(rows, ["instrument_token", "expiry", "date"], version)


def day_numbers(
    bars: DataFrame, keys: Sequence[str] = SERIES, num_days: int | None = None, days_back: int = 0,
) -> DataFrame:
    """The day calendar of each series with ``day_num`` 1 for the latest day after ``days_back``.

    One row per (series, day). A series has as many rows here as it has trading days.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.col("day").desc())
    days = (segments.trading_days(bars, keys).drop("bars")
            .withColumn("day_num", F.row_number().over(newest_first).cast("bigint") - days_back)
            .where(F.col("day_num") > 0))
    return days if num_days is None else days.where(F.col("day_num") <= num_days)


def numbered_days(bars: DataFrame, keys: Sequence[str], num_days: int | None = None, days_back: int = 0,
                  keep: Column | None = None) -> DataFrame:
    """As ``last_days`` for bars that come out of a shuffle by (series, day), which are evaluated once. Only bars that
    meet ``keep`` are returned; the days of others are numbered as well."""
    bars = segments.marked(bars.where(F.col("day").isNotNull()))
    newest_first = Window.partitionBy(*keys).orderBy(F.col("day").desc())
    days = (bars.groupBy(*keys, "day").agg(segments.top_mark())
            .withColumn("day_num", F.row_number().over(newest_first).cast("bigint") - days_back).where(F.col("day_num") > 0))
    days = days if num_days is None else days.where(F.col("day_num") <= num_days)
    return segments.attached(bars, days, [*keys, "day"], keep)


def last_days(
    bars: DataFrame, keys: Sequence[str] = SERIES, num_days: int | None = None, days_back: int = 0,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Keep trading days ``days_back < rank <= days_back + num_days`` and add ``day_num``.

    On a table partitioned by ``day`` the join prunes the scan to the days kept. The days themselves are ranked on
    ``calendar``, rows of (series, day) such as the table kept beside the candles, if there is one; else on the bars.
    """
    return bars.join(day_numbers(bars if calendar is None else calendar, keys, num_days, days_back), [*keys, "day"])


def session_bars(bars: DataFrame, end_hour: int, end_minute: int) -> DataFrame:
    """Bars that start before the session cutoff."""
    return bars.where(labels.minute_of_day("date") < end_hour * 60 + end_minute)


def straddle_bars(
    legs: DataFrame,
    keys: Sequence[str] = SERIES,
    num_days: int | None = None,
    days_back: int = 0,
    both_legs: bool = True,
    numbered: bool = True,
    calendar: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Call and put bars of a strike summed per bar time.

    A bar with one leg only has NULL in the other leg's columns; it still counts its day in
    ``day_num`` and is dropped after that unless ``both_legs`` is off. ``numbered=False`` leaves out
    the day number and the join it takes. ``calendar`` as for ``last_days``. ``dealt`` says that the legs lie together by
    (series, day) already, as in a bucketed table, and are not to be shuffled for it.
    """
    rows = traded(legs)
    if num_days is not None or days_back:
        rows = last_days(rows, keys, num_days, days_back, calendar)
        day_num = [F.max("day_num").alias("day_num")]
    else:
        day_num = []
    is_ce, is_pe = F.col("instrument_type") == CALL, F.col("instrument_type") == PUT
    # Shuffled by (series, day) once; the sum per bar and all that follows per day stays in place.
    together = rows if dealt else rows.repartition(*keys, "day")
    summed = together.groupBy(*keys, "day", "date").agg(
        *[prices.round2(F.sum(c)).alias(c) for c in ("open", "high", "low", "close")],
        F.sum("volume").alias("volume"),
        F.sum("oi").alias("oi"),
        prices.round2(F.sum(F.when(is_ce, F.col("close")))).alias("CE_close"),
        prices.round2(F.sum(F.when(is_pe, F.col("close")))).alias("PE_close"),
        F.sum(F.when(is_ce, F.col("oi"))).alias("CE_oi"),
        F.sum(F.when(is_pe, F.col("oi"))).alias("PE_oi"),
        *day_num,
    )
    complete = F.col("date").isNotNull() & F.col("CE_close").isNotNull() & F.col("PE_close").isNotNull()
    if numbered and not day_num:
        summed = numbered_days(summed, keys, keep=complete if both_legs else None)
    elif both_legs:
        summed = summed.where(complete)
    return summed.withColumn("ohlc4", prices.ohlc4())


def leg_bars(
    legs: DataFrame, keys: Sequence[str] = LEG, num_days: int | None = None, days_back: int = 0,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Single-leg bars: traded, day numbered, positive close, with ``ohlc4``."""
    return (last_days(traded(legs), keys, num_days, days_back, calendar)
            .where(F.col("close") > 0)
            .withColumn("ohlc4", prices.ohlc4()))


def latest_day_flag(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add ``IS_LATEST_DAY``: the bar belongs to the last trading day of its own series."""
    last = bars.groupBy(*keys).agg(F.max("day").alias("_last"))
    return (bars.join(last, list(keys))
            .withColumn("IS_LATEST_DAY", F.col("day") == F.col("_last")).drop("_last"))


def first_bars(bars: DataFrame, n: int, keys: Sequence[str] = SERIES, order: str = "date",
               calendar: DataFrame | None = None) -> DataFrame:
    """The first ``n`` bars of each series.

    Which days they lie on follows from the running count of bars by day, of which there are few: whole days are
    taken by a join, and only the day in which the ``n``-th bar falls is ranked, by (series, day). So no task holds more
    than a day, whatever ``n``. ``calendar``, rows of (series, day, bars) such as the table kept beside the candles, spares
    counting them; on a table partitioned by day the join then prunes the scan to the days needed.
    """
    keys = list(keys)
    days = segments.trading_days(bars, keys) if calendar is None else calendar.select(*keys, "day", "bars")
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(n) - F.coalesce(F.sum("bars").over(earlier), F.lit(0))
    days = days.select(*keys, "day", "bars", left.alias("_left")).where(F.col("_left") > 0)
    rows = bars.join(days.withColumnRenamed("bars", "_bars"), [*keys, "day"])
    in_day = F.row_number().over(Window.partitionBy(*keys, "day").orderBy(order))
    return rows.withColumn("_nth", in_day).where(F.col("_nth") <= F.col("_left")).drop("_nth", "_left", "_bars")


def fill_gaps(bars: DataFrame, width_seconds: int, keys: Sequence[str], values: Sequence[str],
              days: int = segments.DAYS_PER_SEGMENT) -> DataFrame:
    """Put each series on a fixed grid from its first to its last bar, carrying values forward.

    The grid is grown day by day, so no row ever holds more than one day of slots, and the days are dealt
    out before their slots are made, so the grid is not made where the few spans stand.
    """
    if width_seconds <= 0 or 86_400 % width_seconds:
        raise ValueError("the grid must divide the day")
    keys = list(keys)
    span = bars.groupBy(*keys).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    slots = int(86_400 // width_seconds)
    step = F.make_dt_interval(secs=F.lit(width_seconds))
    grid = (
        span.withColumn("day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))
        .repartition(int(span.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "day")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        .withColumn("date", F.col("day").cast("timestamp_ntz") + step * F.col("_slot"))
        .where(F.col("date").between(F.col("_from"), F.col("_to")))
        .select(*keys, "day", "date")
    )
    rows = grid.join(bars.select(*keys, "date", *values), [*keys, "date"], "left")
    cutting = segments.cut(rows, keys, carry={v: ("last", F.col(v)) for v in values}, days=days)
    filled = cutting.df.withColumns({f"_f_{v}": cutting.running(v) for v in values})
    return cutting.finish(filled).select(
        *keys, "day", "date", *[F.col(f"_f_{v}").alias(v) for v in values])
