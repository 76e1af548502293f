"""The public entry points: instruments and expiries, pulls, straddles, spreads, momentum, scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strikelake.functions import prices
from strikelake.operators import bars as B
from strikelake.operators import chain as C
from strikelake.operators import indicators as ind
from strikelake.operators import momentum as M
from strikelake.operators import positions as P
from strikelake.operators import signals as S
from strikelake.operators import spreads as X
from strikelake.operators.segments import DAYS_PER_SEGMENT, cut
from strikelake.schemas import CANDLES, LEG, SERIES
from strikelake.sources import tables
from strikelake.sources.sinks import upsert, write_snapshot


def refresh_instruments(instruments: DataFrame, snapshot_path: str, expiries_path: str) -> None:
    """Snapshot of the tradable instruments and the expiry calendar made from it."""
    chosen = C.tradable(instruments)
    write_snapshot(chosen, snapshot_path)
    calendar = C.expiry_calendar(chosen)
    calendar.write.mode("overwrite").parquet(expiries_path)


def selected_chain(
    contracts: DataFrame, spot: DataFrame, num_strikes: int, next_expiry: bool = False, **atm,
) -> DataFrame:
    """Contracts around the money in the current, and optionally the next, weekly expiry."""
    wanted = C.chosen_expiries(C.expiry_calendar(contracts), next_expiry)
    return C.chain_slice(contracts, C.atm_strikes(spot, **atm), num_strikes, wanted)


def pull(
    landed: DataFrame, contracts: DataFrame, spot: DataFrame, candles_path: str, batch_id: str,
    num_strikes: int, next_expiry: bool = False, version: str | None = None, **atm,
) -> None:
    """One pull for all chosen contracts: select them, restrict the landed candles, upsert."""
    chain = selected_chain(contracts, spot, num_strikes, next_expiry, **atm)
    upsert(C.bars_of(landed, chain), candles_path, batch_id, version=version)


def take_in(
    spark: SparkSession, landing: str, candles_path: str, rejects_path: str, batch_id: str, fmt: str = "json",
    version: str | None = None,
) -> dict[str, int]:
    """Landed candles into the table, and what does not parse, or lacks a key or a close, beside it with the reasons.

    Both counts are observed while the rejected rows are written, in one pass over the landing folder; the rows of a batch
    taken in again replace those it left before.
    """
    rows = tables.read_judged(spark, landing, CANDLES, fmt, tables.REQUIRED["candles"])
    seen = Observation("landed")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(tables.REASONS) > 0).alias("rejected"))
    (tables.rejected(counted).withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects_path))
    good = tables.accepted(rows, CANDLES).withColumn("day", F.to_date("date"))
    upsert(good, candles_path, batch_id, version=version)
    return seen.get


def straddle_signals(
    legs: DataFrame, num_days: int | None = 2, days_back: int = 0, frame: str = S.LATEST,
    keys: Sequence[str] = SERIES, days: int = DAYS_PER_SEGMENT, calendar: DataFrame | None = None,
) -> DataFrame:
    """Straddle analytics of every underlying, expiry and strike.

    ``calendar``, rows of (series, day) such as the table kept beside the candles, tells the last days without reading
    bars; on a table partitioned by day only these are then read.
    """
    bars = B.straddle_bars(legs, keys, num_days, days_back, both_legs=False, numbered=False, calendar=calendar)
    return S.straddle_signals(bars, keys, frame, days)


def leg_signals(
    legs: DataFrame, num_days: int | None = 2, days_back: int = 0, frame: str = S.LATEST,
    keys: Sequence[str] = LEG, days: int = DAYS_PER_SEGMENT, calendar: DataFrame | None = None,
) -> DataFrame:
    """Analytics of every single contract; ``calendar`` as for ``straddle_signals``, by contract."""
    rows = B.traded(legs)
    if num_days is not None or days_back:
        rows = B.last_days(rows, keys, num_days, days_back, calendar)
    rows = rows.withColumn("ohlc4", prices.ohlc4())
    return S.leg_signals(rows, keys, frame, days)


def calendar_signals(
    candles: DataFrame, contracts: DataFrame, legs: DataFrame, inverted: bool = False,
    num_days: int | None = None, days_back: int = 0, latest_only: bool = False,
) -> DataFrame:
    """Calendar or butterfly analytics of every spread in ``legs``."""
    resolved = X.resolve_legs(legs, contracts, inverted)
    pairs = X.pair_bars(candles, resolved, num_days, days_back)
    return X.spread_signals(X.spread_bars(pairs), latest_only)


@dataclass(frozen=True)
class Comparison:
    """What a symbol is compared with: bars of the other with the symbol's keys, or None for the symbol itself.

    ``known_at`` names the column with the time from which a bar of a coarser time frame is known; its
    comparison is then read as of each chart bar.
    """

    other: DataFrame | None = None
    symbol: DataFrame | None = None
    known_at: str | None = None


CHART = -1


def _compared(symbols: DataFrame, chosen: Sequence[Comparison], keys: Sequence[str]) -> DataFrame:
    """The smoothed closes of all comparisons in one frame: ``_which`` tells which, ``_known`` from when on each is known.

    Comparisons on one time frame join its bars of the symbol once, with all their other bars under one tag.
    """
    by_frame: dict[int, list[int]] = {}
    for n, c in enumerate(chosen):
        by_frame.setdefault(id(symbols if c.symbol is None else c.symbol), []).append(n)
    parts = []
    for members in by_frame.values():
        bars = chosen[members[0]].symbol
        bars = symbols if bars is None else bars
        known = {n: chosen[n].known_at or "date" for n in members}
        for at in sorted(set(known.values())):
            own = bars.select(*keys, "day", "date", F.col(at).alias("_known"), *M.OHLC)
            tagged = [chosen[n].other.select(*keys, "date", F.lit(n).alias("_which"), *[F.col(c).alias(f"_b_{c}") for c in M.OHLC])
                      for n in members if known[n] == at and chosen[n].other is not None]
            if tagged:
                joined = own.join(reduce(DataFrame.unionByName, tagged), [*keys, "date"])
                ratios = [prices.ratio(c, f"_b_{c}").alias(c) for c in M.OHLC]
                parts.append(joined.select(*keys, "_which", "day", "date", "_known", *ratios))
            alone = [n for n in members if known[n] == at and chosen[n].other is None]
            if alone:
                parts.append(own.withColumn("_which", F.explode(F.array(*map(F.lit, alone)))).select(*keys, "_which", "day", "date", "_known", *M.OHLC))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(*keys, "_which", "day", "date", "_known", M.smoothed_close().alias("ha_close"))


def momentum(
    symbols: DataFrame, comparisons: Sequence[DataFrame | Comparison], keys: Sequence[str],
    length: int = ind.ROC_LENGTH, range_length: int = M.RANGE_LENGTH, days: int = DAYS_PER_SEGMENT,
) -> DataFrame:
    """Momentum comparison of every symbol with up to four others; with itself if none is given.

    Each comparison is a frame of bars carrying the same keys as the symbol it is compared with, or a
    ``Comparison`` on another time frame, whose ``symbol`` are the symbol's bars on that frame. All bars of the chart
    stay; where a comparison has no value, the base average is NULL, whatever their order.

    However many comparisons there are, their bars are one tagged frame with one rate of change, which meets the chart
    in one aggregation by time; values of coarser frames are then carried forward together.
    """
    keys = list(keys)
    chosen = [c if isinstance(c, Comparison) else Comparison(c) for c in comparisons] or [Comparison()]
    rates = M.roc_mean(_compared(symbols, chosen, keys), "ha_close", [*keys, "_which"], length, days, shared=True)
    events = rates.select(*keys, F.col("_known").alias("date"), F.lit(None).cast("date").alias("day"), "_which", "roc_mean")
    chart = symbols.select(*keys, "date", "day", F.lit(CHART).alias("_which"), F.lit(None).cast("double").alias("roc_mean"))
    rows = events.unionByName(chart).groupBy(*keys, "date").agg(
        F.max("day").alias("day"), F.max(F.col("_which") == CHART).alias("_chart"),
        *[F.max(F.when(F.col("_which") == n, F.col("roc_mean"))).alias(f"roc_mean_{n}") for n in range(len(chosen))])
    coarse = [f"roc_mean_{n}" for n, c in enumerate(chosen) if c.known_at]
    if coarse:
        seg = cut(rows.withColumn("_day", F.to_date("date")), keys, day="_day", days=days, shared=True,
                  carry={c: ("last", F.col(c)) for c in coarse})
        rows = seg.finish(seg.df.withColumns({c: seg.running(c) for c in coarse})).drop("_day")
    base = M.base_average([F.col(f"roc_mean_{n}") for n in range(len(chosen))])
    base = rows.where("_chart").select(*keys, "day", "date", base.alias("base_avg"))
    return M.mmi(base, keys, length=range_length, days=days, shared=True)


def scan_and_size(
    bars: DataFrame, keys: Sequence[str], capital: float, loss: float, margin_rate: float,
    max_orders: int | None = None, low: float = M.RSI_LOW,
) -> DataFrame:
    """RSI scan of every symbol and the order each signal would place; the order limit takes the lowest readings."""
    signals = M.rsi_scan(M.rsi(bars, keys), low).where("buy_signal").withColumn(
        "margin", F.col("last_close") * margin_rate)
    return P.order_intents(signals, capital, loss, max_orders=max_orders, rank_by=["rsi", *keys])


def positions_profit(orders: DataFrame) -> DataFrame:
    return P.profit_by_symbol(P.open_positions(orders), P.latest_quotes(orders))
