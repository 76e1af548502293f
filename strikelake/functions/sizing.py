"""Order sizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikelake.functions.prices import as_col, round2

TICK_CENTS = 5


def order_quantity(capital: float, margin: Column | str) -> Column:
    """Whole units the capital pays for."""
    return F.floor(F.try_divide(F.lit(float(capital)), as_col(margin).cast("double"))).cast("bigint")


def stop_trigger(price: Column | str, quantity: Column | str, loss: float, side: Column | str) -> Column:
    """The price at which ``loss`` is reached, cut down to a 0.05 tick; NULL for no quantity."""
    distance = F.try_divide(F.lit(float(loss)), as_col(quantity).cast("double"))
    p = as_col(price)
    raw = round2(F.when(as_col(side) == "BUY", p - distance).otherwise(p + distance))
    cents = F.round(raw.cast("decimal(18,6)") * 100, 0).cast("bigint")
    return (cents - F.pmod(cents, F.lit(TICK_CENTS))) / F.lit(100.0)
