"""Strike ladder arithmetic: rounding to a step, levels around the money and their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikelake.functions.prices import as_col


def round_to_step(x: Column | str, step: Column | float) -> Column:
    """Nearest multiple of ``step``; a price half way between two goes up, also below zero."""
    s = step if isinstance(step, Column) else F.lit(float(step))
    return (F.floor(as_col(x) / s + F.lit(0.5)) * s).cast("bigint")


def strike_level(strike: Column | str, atm: Column | str, step: Column | str) -> Column:
    return (as_col(strike).cast("double") - as_col(atm)) / as_col(step)


def level_type(level: Column | str) -> Column:
    """ITM / ATM / OTM by the call convention, whichever side the contract is."""
    lvl = as_col(level)
    return F.when(lvl < 0, "ITM").when(lvl > 0, "OTM").otherwise("ATM")


def moneyness(level: Column | str, instrument_type: Column | str) -> Column:
    """ITM / ATM / OTM as seen by the contract's own side."""
    lvl = as_col(level)
    seen = F.when(as_col(instrument_type) == "PE", -lvl).otherwise(lvl)
    return level_type(seen)


def level_name(level: Column | str) -> Column:
    """``ATM``, ``ATM+3``, ``ATM-2``, ``ATM+0.5``."""
    lvl = as_col(level)
    digits = F.regexp_replace(lvl.cast("string"), r"\.0$", "")
    return (F.when(lvl < 0, F.concat(F.lit("ATM"), digits))
             .when(lvl > 0, F.concat(F.lit("ATM+"), digits))
             .otherwise("ATM"))
