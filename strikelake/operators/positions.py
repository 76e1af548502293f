"""Orders, positions and profit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelake.functions import prices, sizing

PENDING = "TRIGGER PENDING"


def open_positions(orders: DataFrame, first_by: str = "o_orderdate") -> DataFrame:
    """Pending stop orders with the average price of their parent order (NULL if there is none).

    A pending BUY closes a short, so its quantity is negative. A parent that appears several times
    counts once, its first row. Many stops may share one parent: the parent side is unique, and AQE
    splits the skewed stop side of the join.
    """
    stops = orders.where(F.col("status") == PENDING).select(
        "order_id", "parent_order_id", "tradingsymbol",
        F.when(F.col("transaction_type") == "BUY", -F.col("quantity"))
        .otherwise(F.col("quantity")).alias("quantity"))
    parents = (orders.groupBy(F.col("order_id").alias("parent_order_id"))
               .agg(F.min_by("average_price", F.struct(first_by, "average_price")).alias("average_price")))
    return stops.join(parents, "parent_order_id", "left")


def latest_quotes(orders: DataFrame) -> DataFrame:
    """Last price per symbol."""
    return orders.groupBy("tradingsymbol").agg(
        F.max_by("average_price", F.struct("o_orderdate", "order_id")).alias("last_price"))


def position_profit(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Profit of every position; NULL while its symbol has no quote."""
    return (positions.join(quotes, "tradingsymbol", "left")
            .withColumn("pnl", prices.profit("last_price", "average_price", "quantity")))


def profit_by_symbol(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Profit per symbol and in total (``tradingsymbol`` NULL), with the positions that have no quote."""
    return (position_profit(positions, quotes).rollup("tradingsymbol")
            .agg(F.count(F.lit(1)).alias("positions"), F.count_if(F.col("last_price").isNull()).alias("unquoted"),
                 F.sum("pnl").alias("pnl")))


def order_intents(
    signals: DataFrame, capital: float, loss: float, side: str = "BUY",
    price: str = "last_close", margin: str = "margin", max_orders: int | None = None,
    rank_by: str | Sequence[str] = (),
) -> DataFrame:
    """Quantity and stop for every signal; no order is sent anywhere.

    ``max_orders`` keeps the first so many by ``rank_by``, the order limit of a trading session; name the keys
    of a signal in it, so that the choice is unique.
    """
    out = signals.withColumn("side", F.lit(side)).withColumn(
        "quantity", sizing.order_quantity(capital, margin))
    sized = F.when(F.col("quantity") > 0, F.col("quantity"))
    out = out.withColumn("stop", sizing.stop_trigger(price, sized, loss, F.col("side")))
    if max_orders is not None:
        out = out.orderBy(rank_by if isinstance(rank_by, str) else list(rank_by)).limit(max_orders)
    return out
