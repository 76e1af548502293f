"""Instrument master, expiry calendar and the strike ladder around the money."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelake.functions import strikes
from strikelake.schemas import CALL, EXCHANGE, FUTURES_SEGMENT, OPTIONS_SEGMENT, PUT


def tradable(instruments: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Options and futures of the derivatives exchange, of the named underlyings or of all."""
    out = instruments.where(
        (F.col("exchange") == EXCHANGE) & F.col("segment").isin(OPTIONS_SEGMENT, FUTURES_SEGMENT))
    return out if names is None else out.where(F.col("name").isin(names))


def expiries(instruments: DataFrame) -> DataFrame:
    """Distinct expiries per underlying and segment."""
    return instruments.select("name", "segment", "expiry").distinct()


def expiry_calendar(instruments: DataFrame) -> DataFrame:
    """Current and next week (options) and month (futures) expiry of every underlying.

    One aggregation to distinct expiries, then a rank over those few; NULL where there is no second
    expiry or no futures.
    """
    w = Window.partitionBy("name", "segment").orderBy("expiry")
    ranked = expiries(instruments).withColumn("nth", F.row_number().over(w)).where("nth <= 2")

    def pick(segment: str, nth: int) -> Column:
        return F.max(F.when((F.col("segment") == segment) & (F.col("nth") == nth), F.col("expiry")))

    return ranked.groupBy("name").agg(
        pick(OPTIONS_SEGMENT, 1).alias("current_week_expiry"),
        pick(FUTURES_SEGMENT, 1).alias("current_month_expiry"),
        pick(OPTIONS_SEGMENT, 2).alias("next_week_expiry"),
        pick(FUTURES_SEGMENT, 2).alias("next_month_expiry"),
    )


def chosen_expiries(calendar: DataFrame, next_too: bool = False) -> DataFrame:
    """(name, expiry) of the current, and optionally the next, weekly expiry."""
    columns = ["current_week_expiry"] + (["next_week_expiry"] if next_too else [])
    return (calendar.select("name", F.explode(F.array(*columns)).alias("expiry"))
            .where(F.col("expiry").isNotNull()))


def latest_spot(spot: DataFrame) -> DataFrame:
    """Last price per underlying, by an aggregation with a map-side combine."""
    return spot.groupBy("name").agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("last_price"))


def atm_strikes(
    spot: DataFrame,
    steps: Mapping[str, float] | None = None,
    default_step: float = 100,
    custom: Mapping[str, float] | None = None,
) -> DataFrame:
    """At-the-money strike per underlying: the last price rounded to its strike step, or the strike
    given in ``custom``."""
    def looked_up(values: Mapping[str, float] | None, otherwise: Column) -> Column:
        out = otherwise
        for name, value in (values or {}).items():
            out = F.when(F.col("name") == name, F.lit(float(value))).otherwise(out)
        return out

    priced = latest_spot(spot).withColumn("step", looked_up(steps, F.lit(float(default_step))))
    computed = strikes.round_to_step("last_price", F.col("step"))
    chosen = looked_up(custom, F.lit(None).cast("double")).cast("bigint")
    return priced.withColumn("atm_strike", F.coalesce(chosen, computed))


def chain_slice(
    contracts: DataFrame, atm: DataFrame, num_strikes: int, wanted: DataFrame | None = None,
) -> DataFrame:
    """Contracts within ``num_strikes`` steps of the money, with level, type and name.

    ``atm`` has one row per underlying (name, atm_strike, step) and ``wanted`` one per
    (name, expiry); both are joined without a hint, so they are broadcast only while they are small.
    """
    rows = contracts if wanted is None else contracts.join(wanted, ["name", "expiry"], "left_semi")
    reach = F.col("step") * num_strikes
    level = strikes.strike_level("strike", "atm_strike", "step")
    return (
        rows.join(atm.select("name", "atm_strike", "step"), "name")
        .where(F.col("strike").between(F.col("atm_strike") - reach, F.col("atm_strike") + reach))
        .withColumn("Strike_level", level)
        .withColumns({
            "Strike_level_type": strikes.level_type("Strike_level"),
            "Strike_level_Name": strikes.level_name("Strike_level"),
            "moneyness": strikes.moneyness("Strike_level", "instrument_type"),
        })
        .select("name", "instrument_token", "expiry", "Strike_level_Name", "strike",
                "Strike_level_type", "lot_size", "instrument_type", "segment", "Strike_level",
                "moneyness")
    )


def chain_bars(bars: DataFrame, chain: DataFrame) -> DataFrame:
    """Bars of the contracts in a chain slice, with their level."""
    levels = chain.select("instrument_token", "expiry", "Strike_level", "Strike_level_Name",
                          "Strike_level_type", "lot_size")
    return bars.join(levels, ["instrument_token", "expiry"])


def bars_of(bars: DataFrame, chain: DataFrame) -> DataFrame:
    """Bars restricted to the contracts of a chain slice."""
    return bars.join(chain.select("instrument_token", "expiry"), ["instrument_token", "expiry"],
                     "left_semi")


def strike_tokens(chain: DataFrame) -> DataFrame:
    """Call and put contract of every level: one row per (name, expiry, level name)."""
    def token(side: str) -> Column:
        return F.max(F.when(F.col("instrument_type") == side, F.col("instrument_token")))
    return chain.groupBy("name", "expiry", "Strike_level_Name", "strike").agg(
        token(CALL).alias("ce_token"), token(PUT).alias("pe_token"))


def strike_token(chain: DataFrame, name: str, expiry, level: str, side: str) -> DataFrame:
    """The contract of one level, as a frame of at most one row per strike."""
    return chain.where(
        (F.col("name") == name) & (F.col("expiry") == F.lit(expiry))
        & (F.col("Strike_level_Name") == level) & (F.col("instrument_type") == side)
    ).select("instrument_token", "strike")
