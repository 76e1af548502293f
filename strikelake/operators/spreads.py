"""Calendar and butterfly spreads: a short pair against a long pair of legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelake.functions import prices
from strikelake.operators import segments
from strikelake.operators.bars import numbered_days, traded
from strikelake.operators.indicators import ROC_LENGTH, roc_sum
from strikelake.schemas import CALL, PUT, STRIKE

SHORT, LONG = "Short", "Long"
PAIR = ["spread_id", "name", "near_expiry"]


def spread_legs(
    contracts: DataFrame, short_expiry, long_expiry, call_wing: float = 0, put_wing: float = 0,
) -> DataFrame:
    """Four legs for every strike of the near expiry.

    Short call and put at the strike in the near expiry, long call ``call_wing`` above and long put
    ``put_wing`` below it in the far one. One row per leg.
    """
    def leg(role: str, expiry, side: str, shift: float) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(expiry).cast("date").alias("expiry"),
                        F.lit(side).alias("instrument_type"), (F.col("at") + F.lit(shift).cast(STRIKE)).cast(STRIKE).alias("strike"))
    base = contracts.where(F.col("expiry") == F.lit(short_expiry).cast("date")).select(
        "name", F.col("strike").alias("at")).distinct()
    legs = F.array(leg(SHORT, short_expiry, CALL, 0.0), leg(SHORT, short_expiry, PUT, 0.0),
                   leg(LONG, long_expiry, CALL, float(call_wing)),
                   leg(LONG, long_expiry, PUT, -float(put_wing)))
    return base.select(
        F.concat_ws("-", "name", F.col("at").cast("bigint").cast("string")).alias("spread_id"), "name",
        F.lit(short_expiry).cast("date").alias("near_expiry"), F.explode(legs).alias("leg"),
    ).select("spread_id", "name", "near_expiry", "leg.*")


def resolve_legs(legs: DataFrame, contracts: DataFrame, inverted: bool = False) -> DataFrame:
    """Find the contract of each leg. ``inverted`` sells the long pair and buys the short one."""
    found = legs.join(
        contracts.select("name", "expiry", "strike", "instrument_type", "instrument_token"),
        ["name", "expiry", "strike", "instrument_type"])
    if inverted:
        found = found.withColumn("role", F.when(F.col("role") == SHORT, LONG).otherwise(SHORT))
    return found.select("spread_id", "name", "near_expiry", "role", "expiry", "strike",
                        "instrument_type", "instrument_token")


def pair_bars(
    bars: DataFrame, resolved: DataFrame, num_days: int | None = None, days_back: int = 0,
) -> DataFrame:
    """Call and put of each pair summed per bar; only bars with both legs above zero are kept.

    The day number is ranked per pair before that filter.
    """
    legs = (traded(bars).where(F.col("close") > 0)
            .withColumn("ohlc4", prices.ohlc4())
            .join(resolved.select("spread_id", "near_expiry", "role", "instrument_token", "expiry"),
                  ["instrument_token", "expiry"]))
    is_ce, is_pe = F.col("instrument_type") == CALL, F.col("instrument_type") == PUT
    keys = [*PAIR, "role"]

    def leg(side: Column, c: str) -> Column:
        return F.when(side, F.col(c))

    # Shuffled by (pair, day) once; the sum per bar and the numbering of days stay in place.
    summed = legs.repartition(*keys, "day").groupBy(*keys, "day", "date").agg(
        *[prices.round2(F.sum(c)).alias(c) for c in ("open", "high", "low", "close")],
        prices.round2(F.sum(leg(is_ce, "close"))).alias("CE_close"),
        prices.round2(F.sum(leg(is_pe, "close"))).alias("PE_close"),
        F.sum("oi").alias("oi"),
        F.sum(leg(is_ce, "oi")).alias("CE_oi"),
        F.sum(leg(is_pe, "oi")).alias("PE_oi"),
        prices.round2(F.sum(leg(is_ce, "ohlc4"))).alias("CE_ohlc4"),
        prices.round2(F.sum(leg(is_pe, "ohlc4"))).alias("PE_ohlc4"),
        F.max(leg(is_ce, "strike")).alias("CE_strike"),
        F.max(leg(is_pe, "strike")).alias("PE_strike"),
        F.concat_ws(", ", *[F.max(leg(side, "instrument_token")).cast("string") for side in (is_ce, is_pe)]).alias("instrument_token"),
    )
    return (numbered_days(summed, keys, num_days, days_back)
            .where((F.col("CE_close") > 0) & (F.col("PE_close") > 0))
            .withColumn("ohlc4", prices.ohlc4()))


def spread_bars(pairs: DataFrame) -> DataFrame:
    """Short and long pair side by side. Sides meet only where time and day number agree; with one
    side missing the difference and the sum are NULL."""
    def side(role: str, c: str) -> Column:
        return F.when(F.col("role") == role, F.col(c))

    short, long = F.sum(side(SHORT, "close")), F.sum(side(LONG, "close"))
    return pairs.groupBy(*PAIR, "day", "date", "day_num").agg(
        F.concat_ws(", ", F.max(side(SHORT, "instrument_token")), F.max(side(LONG, "instrument_token")))
        .alias("instrument_token"),
        prices.round2(short).alias("Short_close"),
        prices.round2(long).alias("Long_close"),
        prices.round2(short - long).alias("Close_Diff1"),
        prices.round2(short + long).alias("Close_Diff2"),
        F.sum(side(SHORT, "oi")).alias("Short_oi"),
        F.sum(side(LONG, "oi")).alias("Long_oi"),
        prices.round2(F.sum(side(SHORT, "ohlc4"))).alias("Short_ohlc4"),
        prices.round2(F.sum(side(LONG, "ohlc4"))).alias("Long_ohlc4"),
    )


def spread_signals(spreads: DataFrame, latest_only: bool = False,
                   days: int = segments.DAYS_PER_SEGMENT) -> DataFrame:
    """Rate of change of both pairs, their difference and their sum, plus the latest-day flag."""
    seg = segments.cut(spreads, PAIR, order=["date", "day_num"], lookback=ROC_LENGTH, days=days, shared=True,
                       whole={"newest": ("min", F.col("day_num"))})
    columns = ["Short_close", "Long_close", "Close_Diff1", "Close_Diff2"]
    out = seg.finish(seg.df.withColumns({
        **{f"ROC_AVG_{c}": roc_sum(c, seg.window) for c in columns},
        "IS_LATEST_DAY": F.col("day_num") == seg.whole("newest")}))
    return out.where("IS_LATEST_DAY") if latest_only else out
