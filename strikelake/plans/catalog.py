"""Every checked query: ``(spark, sf_dir) -> DataFrame`` over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from strikelake.functions import labels, prices, strikes
from strikelake.operators import bars as B
from strikelake.operators import chain as C
from strikelake.operators import indicators as ind
from strikelake.operators import momentum as M
from strikelake.operators import positions as P
from strikelake.operators import signals as S
from strikelake.operators import spreads as X
from strikelake.plans import pipelines
from strikelake.schemas import CANDLES, LEG, SERIES
from strikelake.session import fresh_dir
from strikelake.sources import fixtures as fx
from strikelake.sources import sinks, tables
from strikelake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters of the checked queries.
NUM_STRIKES = 8
CAPITAL, LOSS, MARGIN_RATE = 10_000.0, 100.0, 0.2
MAX_ORDERS, MILD_LOW = 5, 55
SESSION_END = (15, 30)
# Overlapping pulls: the second begins before the first ends and revises what they share.
FIRST_PULL_END, SECOND_PULL_START = "2024-01-20", "2024-01-10"
WATERMARK = "12 hours"


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return steady(fn(spark, sf_dir))
    QUERIES[fn.__name__] = run
    return run


def steady(df: DataFrame) -> DataFrame:
    """The form results are compared in: decimals as doubles, and doubles at 6 decimals, so that the
    last bits left by the order of additions do not show. Ten decimals are taken first, which keeps
    a value half way between two where it is."""
    shown = {
        "double": "double(round(cast({0} as decimal(38,10)), 6)) as {0}",
        "decimal(18,4)": "double({0}) as {0}",
    }
    return df.selectExpr(*[shown.get(kind, "{0}").format(f"`{name}`") for name, kind in df.dtypes])


def _straddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.straddle_bars(fx.bars(spark, sf_dir), numbered=False)


# --- instruments and chain -----------------------------------------------------------------------

def _landed(df: DataFrame, label: str) -> str:
    path = fresh_dir(df.sparkSession, label)
    text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    text.write.json(path)
    return path


@query
def instr_load(spark, sf_dir):
    path = _landed(fx.instruments(spark, sf_dir), "landing-instruments")
    return tables.load_instruments(spark, path)


@query
def instr_segments(spark, sf_dir):
    return C.tradable(fx.instruments(spark, sf_dir)).select(
        "name", "segment", "instrument_token", "expiry", "strike", "instrument_type")


@query
def instr_counts(spark, sf_dir):
    return (C.tradable(fx.instruments(spark, sf_dir)).groupBy("name", "segment")
            .agg(F.count(F.lit(1)).alias("contracts")))


@query
def snapshot_roundtrip(spark, sf_dir):
    path = fresh_dir(spark, "snapshot")
    sinks.write_snapshot(C.tradable(fx.instruments(spark, sf_dir)), path)
    return tables.read_instruments(spark, path)


@query
def expiry_list(spark, sf_dir):
    return C.expiries(C.tradable(fx.instruments(spark, sf_dir)))


@query
def expiry_calendar(spark, sf_dir):
    return C.expiry_calendar(C.tradable(fx.instruments(spark, sf_dir)))


@query
def round_step(spark, sf_dir):
    price = F.col("o_totalprice")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        strikes.round_to_step(price, 100).alias("near_100"),
        strikes.round_to_step(price, 50).alias("near_50"),
        strikes.round_to_step(-price, 100).alias("below_zero_100"))


@query
def atm_strike(spark, sf_dir):
    return C.atm_strikes(fx.spot(spark, sf_dir))


def _full_chain(spark, sf_dir):
    return C.chain_slice(fx.contracts(spark, sf_dir), C.atm_strikes(fx.spot(spark, sf_dir)), NUM_STRIKES)


@query
def chain_slice(spark, sf_dir):
    return _full_chain(spark, sf_dir)


@query
def strike_token(spark, sf_dir):
    return C.strike_tokens(_full_chain(spark, sf_dir))


@query
def chain_bars(spark, sf_dir):
    return C.chain_bars(fx.bars(spark, sf_dir), _full_chain(spark, sf_dir))


# --- bars ----------------------------------------------------------------------------------------

@query
def ohlc_bars(spark, sf_dir):
    return fx.bars(spark, sf_dir)


@query
def candles_load(spark, sf_dir):
    path = _landed(fx.bars(spark, sf_dir), "landing-candles")
    return tables.load_candles(spark, path)


def spoiled(bars: DataFrame) -> DataFrame:
    """The candles as text, some of it no value: closes, times and tokens by the bar's volume and open interest."""
    volume, oi = F.col("volume"), F.col("oi")
    broken = {"close": F.when(volume % 5 == 0, "n/a").when(volume % 7 == 0, F.lit(None)).otherwise(F.col("close").cast("string")),
              "date": F.when(oi % 3 == 0, "yesterday").otherwise(F.col("date").cast("string")),
              "instrument_token": F.when(oi % 11 == 0, F.lit(None)).otherwise(F.col("instrument_token").cast("string"))}
    return bars.select([broken[c].alias(c) if c in broken else F.col(c).cast("string").alias(c) for c in bars.columns])


@query
def candles_rejected(spark, sf_dir):
    """What a pull can't take in, with the columns at fault."""
    path = fresh_dir(spark, "landing-spoiled")
    spoiled(fx.bars(spark, sf_dir)).write.option("ignoreNullFields", "false").json(path)
    rows = tables.read_judged(spark, path, CANDLES, required=tables.REQUIRED["candles"])
    return tables.rejected(rows).select("instrument_token", "expiry", "volume", "oi", F.concat_ws(",", tables.REASONS).alias("reasons"))


def _delivered_twice(spark, sf_dir):
    """Bars delivered by two pulls; the second revises the close."""
    bars = fx.bars(spark, sf_dir)
    again = bars.withColumn("close", F.col("close") + 0.5)
    return bars.withColumn("pull", F.lit(1)).unionByName(again.withColumn("pull", F.lit(2)))


@query
def bars_clean(spark, sf_dir):
    return B.clean_bars(_delivered_twice(spark, sf_dir), version="pull").drop("pull")


@query
def leg_bars(spark, sf_dir):
    return B.leg_bars(fx.bars(spark, sf_dir), num_days=5, days_back=1)


@query
def session_filter(spark, sf_dir):
    return B.session_bars(fx.bars(spark, sf_dir), *SESSION_END)


@query
def straddle_bars(spark, sf_dir):
    return B.straddle_bars(fx.bars(spark, sf_dir))


@query
def last_n_days(spark, sf_dir):
    return B.straddle_bars(fx.bars(spark, sf_dir), num_days=3, days_back=1, both_legs=False)


@query
def latest_day_flag(spark, sf_dir):
    flagged = B.latest_day_flag(_straddles(spark, sf_dir))
    return flagged.select(*SERIES, "day", "date", "close", "IS_LATEST_DAY")


@query
def first_n_bars(spark, sf_dir):
    return B.first_bars(_straddles(spark, sf_dir), 24).select(*SERIES, "date", "close")


GRID_COLUMNS = ["close", "CE_close", "PE_close", "oi"]


@query
def gap_fill(spark, sf_dir):
    return B.fill_gaps(_straddles(spark, sf_dir), 6 * 3600, SERIES, GRID_COLUMNS)


@query
def synthetic_time(spark, sf_dir):
    rows = ind.numbered(_straddles(spark, sf_dir))
    return rows.select(*SERIES, "date", "rownum",
                       labels.synthetic_time("rownum").alias("made_time"),
                       labels.axis_label(labels.synthetic_time("rownum"), with_day=False).alias("made_label"))


@query
def lookback_days(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("as_of"),
        labels.lookback_days(F.to_date("o_orderdate"), 5).alias("days_history"))


# --- indicators ----------------------------------------------------------------------------------

ROC_COLUMNS = [*SERIES, "date", "ROC_AVG_close", "ROC_AVG_CE_close", "ROC_AVG_PE_close", "ROC_AVG_CEPE_AVG"]


@query
def roc_avg(spark, sf_dir):
    out = ind.roc_average(_straddles(spark, sf_dir))
    return out.select(*ROC_COLUMNS)


# The names of the result columns, which charts read.
RUNNING = ["cumulative_sum_close", "cumulative_min_close", "cumulative_count", "cumulative_sum_oi", "incremental_min_close",
           "incremental_close_avg", "incremental_oi_avg", "MAX_incremental_close_avg", "trailing_sl"]
RUNNING_LEGS = ["cumulative_sum_CE_close", "cumulative_sum_PE_close", "incremental_CE_close_avg", "incremental_PE_close_avg", "running_min_ce", "running_min_pe"]


@query
def running_stats(spark, sf_dir):
    out = ind.running_stats(_straddles(spark, sf_dir))
    return out.select(*SERIES, "date", *RUNNING, *RUNNING_LEGS)


@query
def bollinger(spark, sf_dir):
    out = ind.bollinger_bands(_straddles(spark, sf_dir))
    return out.select(*SERIES, "date", "close", "bb_mid", "bb_upper", "bb_lower")


@query
def vwap_oiwap(spark, sf_dir):
    out = ind.weighted_prices(_straddles(spark, sf_dir))
    return out.select(*SERIES, "date", "vwap", "oiwap")


@query
def leg_ratios(spark, sf_dir):
    return ind.leg_ratios(_straddles(spark, sf_dir)).select(*SERIES, "date", "ce_pe_ratio", "oi_pcr")


@query
def oi_diff(spark, sf_dir):
    out = ind.oi_difference(_straddles(spark, sf_dir))
    return out.select(*SERIES, "date", "oi_diff", "oi_diff_avg")


@query
def roc_expanding(spark, sf_dir):
    out = ind.roc_expanding(_straddles(spark, sf_dir))
    return out.select(*SERIES, "date", "ROC_AVG_close", "roc_mean")


@query
def premium_decay(spark, sf_dir):
    out = ind.premium_decay(_straddles(spark, sf_dir))
    return out.select(*SERIES, "date", "close", "premium_decay_pct")


@query
def day_boundaries(spark, sf_dir):
    return ind.day_boundaries(_straddles(spark, sf_dir)).select(*SERIES, "date", "x_label", "time_label")


@query
def latest_values(spark, sf_dir):
    return ind.latest_values(_straddles(spark, sf_dir), ["close", "CE_close", "PE_close", "oi"])


@query
def candle_summary(spark, sf_dir):
    return ind.candle_summary(_straddles(spark, sf_dir))


@query
def series_range(spark, sf_dir):
    return ind.series_range(_straddles(spark, sf_dir), "CE_close", "PE_close")


@query
def extra_indicators(spark, sf_dir):
    out = ind.extra_indicators(_straddles(spark, sf_dir))
    return out.select(*SERIES, "date", "close", "bb_mid", "bb_upper", "bb_lower", "ce_pe_ratio",
                             "oi_pcr", "oi_diff", "oi_diff_avg", "vwap", "oiwap", "premium_decay_pct")


# --- signals -------------------------------------------------------------------------------------

# The names of the result columns, which charts read.
SIGNALS = [*SERIES, "day", "day_num", "date", "open", "high", "low", "close", "volume", "oi",
           "CE_close", "PE_close", "CE_oi", "PE_oi", "ohlc4", "rownum", "IS_LATEST_DAY", "MidPoint",
           "ROC_AVG_close", "ROC_AVG_CE_close", "ROC_AVG_PE_close", "ROC_AVG_CEPE_AVG",
           *RUNNING, *RUNNING_LEGS, "StopLoss", "CE_close_On_Open", "PE_close_On_Open",
           "Open_Max_Close", "EntryAllowed"]


def straddle_query(spark, sf_dir, frame, width=fx.BAR_WIDTH, num_days=None):
    legs = fx.bars(spark, sf_dir, width)
    return pipelines.straddle_signals(legs, num_days=num_days, frame=frame)


@query
def straddle_signals(spark, sf_dir):
    return straddle_query(spark, sf_dir, S.WHOLE).select(*SIGNALS)


@query
def straddle_signals_latest(spark, sf_dir):
    """The chart default: the latest of the last days, running statistics of that day."""
    return straddle_query(spark, sf_dir, S.LATEST, num_days=10).select(*SIGNALS)


@query
def stop_loss(spark, sf_dir):
    return straddle_query(spark, sf_dir, S.DAY).select(*SERIES, "day", "date", "close", "StopLoss")


@query
def entry_allowed(spark, sf_dir):
    return straddle_query(spark, sf_dir, S.DAY).select(
        *SERIES, "day", "date", "Open_Max_Close", "EntryAllowed")


@query
def leg_signals(spark, sf_dir):
    out = pipelines.leg_signals(fx.bars(spark, sf_dir), num_days=None, frame=S.WHOLE)
    return out.select(*LEG, "day", "day_num", "date", "close", "oi", "ohlc4", "rownum",
                             "IS_LATEST_DAY", "MidPoint", "ROC_AVG_close", *RUNNING)


# --- spreads -------------------------------------------------------------------------------------

def _spread_legs(spark, sf_dir):
    return X.spread_legs(fx.contracts(spark, sf_dir), fx.SHORT_EXPIRY, fx.LONG_EXPIRY)


def _pairs(spark, sf_dir, inverted=False):
    resolved = X.resolve_legs(_spread_legs(spark, sf_dir), fx.contracts(spark, sf_dir), inverted)
    return X.pair_bars(fx.bars(spark, sf_dir), resolved)


@query
def legs_resolve(spark, sf_dir):
    """Four legs per strike, the long pair 100 points out, roles swapped."""
    legs = X.spread_legs(fx.contracts(spark, sf_dir), fx.SHORT_EXPIRY, fx.LONG_EXPIRY, 100, 100)
    return X.resolve_legs(legs, fx.contracts(spark, sf_dir), inverted=True)


@query
def calendar_legs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query
def calendar_bars(spark, sf_dir):
    return X.spread_bars(_pairs(spark, sf_dir))


@query
def calendar_signals(spark, sf_dir):
    return pipelines.calendar_signals(
        fx.bars(spark, sf_dir), fx.contracts(spark, sf_dir), _spread_legs(spark, sf_dir))


# --- momentum and RSI ----------------------------------------------------------------------------

PAIR_KEYS = SERIES


def _calls_and_puts(spark, sf_dir):
    """The call of a strike is the symbol, the put of the same strike the one it is compared with."""
    legs = fx.bars(spark, sf_dir)
    return (legs.where(F.col("instrument_type") == "CE"), legs.where(F.col("instrument_type") == "PE"))


@query
def ratio_bars(spark, sf_dir):
    calls, puts = _calls_and_puts(spark, sf_dir)
    return M.ratio_bars(calls, puts, PAIR_KEYS)


SMOOTHED = [*LEG, "date", "ha_open", "ha_high", "ha_low", "ha_close"]


@query
def heikin_ashi(spark, sf_dir):
    return M.heikin_ashi(fx.bars(spark, sf_dir), LEG).select(*SMOOTHED)


@query
def roc_mean_pct(spark, sf_dir):
    out = M.roc_mean(fx.bars(spark, sf_dir), "close", LEG)
    return out.select(*LEG, "date", "close", "roc_mean")


def daily_bars(spark, sf_dir):
    """Day bars of every contract, known from the close of the day on."""
    return fx.bars(spark, sf_dir, "1 day").withColumn("known_at", F.col("date") + F.make_dt_interval(days=F.lit(1)))


@query
def mtf_asof(spark, sf_dir):
    chart = fx.bars(spark, sf_dir).select(*LEG, "day", "date", "close")
    coarse = daily_bars(spark, sf_dir).select(*LEG, "known_at", F.col("close").alias("day_close"))
    return M.as_of(chart, coarse, "day_close", "known_at", LEG)


def _momentum(spark, sf_dir):
    calls, puts = _calls_and_puts(spark, sf_dir)
    return pipelines.momentum(calls, [puts], PAIR_KEYS)


@query
def mmi(spark, sf_dir):
    return _momentum(spark, sf_dir).drop("rownum")


def _daily_calls_and_puts(spark, sf_dir):
    legs = daily_bars(spark, sf_dir)
    return (legs.where(F.col("instrument_type") == "CE"), legs.where(F.col("instrument_type") == "PE"))


@query
def mmi_multi(spark, sf_dir):
    """Three comparisons: on the chart's bars, on day bars as far as known, and with the symbol itself."""
    calls, puts = _calls_and_puts(spark, sf_dir)
    day_calls, day_puts = _daily_calls_and_puts(spark, sf_dir)
    chosen = [puts, pipelines.Comparison(day_puts, day_calls, "known_at"), pipelines.Comparison()]
    return pipelines.momentum(calls, chosen, PAIR_KEYS).drop("rownum")


@query
def mmi_latest(spark, sf_dir):
    return M.latest_reading(_momentum(spark, sf_dir), PAIR_KEYS)


@query
def rsi(spark, sf_dir):
    return M.rsi(fx.bars(spark, sf_dir), LEG)


@query
def rsi_scan(spark, sf_dir):
    return M.rsi_scan(M.rsi(fx.bars(spark, sf_dir), LEG))


@query
def order_intents(spark, sf_dir):
    readings = M.rsi_scan(M.rsi(fx.bars(spark, sf_dir), LEG)).withColumn(
        "margin", F.col("last_close") * MARGIN_RATE)
    out = P.order_intents(readings, CAPITAL, LOSS)
    return out.select(*LEG, "last_close", "buy_signal", "side", "quantity", "stop")


@query
def scan_and_size(spark, sf_dir):
    """Scan to orders in one pipeline, with a mild threshold and the order limit of a session."""
    out = pipelines.scan_and_size(fx.bars(spark, sf_dir), LEG, CAPITAL, LOSS, MARGIN_RATE, max_orders=MAX_ORDERS, low=MILD_LOW)
    return out.select(*LEG, "rsi", "last_close", "side", "quantity", "stop")


# --- series cut into several segments ------------------------------------------------------------

def cut_again(name: str, days: int, run: Callable[..., DataFrame]) -> None:
    """Register a query again with segments of few days; its counterpart stays the same."""
    def again(spark, sf_dir):
        return run(spark, sf_dir, days)
    again.__name__ = f"{name}_cut"
    CUT[f"{name}_cut"] = name
    query(again)


CUT: dict[str, str] = {}
FEW, MORE = 5, 21  # days: running aggregates need no look-back, rates of change one of 20 bars
_RUN = {
    "roc_avg": (MORE, lambda spark, d, n: ind.roc_average(_straddles(spark, d), days=n).select(*ROC_COLUMNS)),
    "running_stats": (FEW, lambda spark, d, n: ind.running_stats(_straddles(spark, d), days=n).select(*SERIES, "date", *RUNNING, *RUNNING_LEGS)),
    "straddle_signals": (MORE, lambda spark, d, n: pipelines.straddle_signals(
        fx.bars(spark, d), num_days=None, frame=S.WHOLE, days=n).select(*SIGNALS)),
    "mmi": (MORE, lambda spark, d, n: pipelines.momentum(
        (c := _calls_and_puts(spark, d))[0], [c[1]], PAIR_KEYS, days=n).drop("rownum")),
    "mtf_asof": (FEW, lambda spark, d, n: M.as_of(
        fx.bars(spark, d).select(*LEG, "day", "date", "close"),
        daily_bars(spark, d).select(*LEG, "known_at", F.col("close").alias("day_close")), "day_close", "known_at", LEG, days=n)),
    "rsi": (FEW, lambda spark, d, n: M.rsi(fx.bars(spark, d), LEG, days=n)),
    "heikin_ashi": (FEW, lambda spark, d, n: M.heikin_ashi(fx.bars(spark, d), LEG, days=n).select(*SMOOTHED)),
    "gap_fill": (FEW, lambda spark, d, n: B.fill_gaps(_straddles(spark, d), 6 * 3600, SERIES, GRID_COLUMNS, days=n)),
}
for _name, (_days, _fn) in _RUN.items():
    cut_again(_name, _days, _fn)


# --- positions -----------------------------------------------------------------------------------

@query
def open_positions(spark, sf_dir):
    return P.open_positions(fx.orders(spark, sf_dir))


@query
def positions_pnl(spark, sf_dir):
    return pipelines.positions_profit(fx.orders(spark, sf_dir)).withColumn("pnl", prices.round2("pnl"))


@query
def positions_marked(spark, sf_dir):
    """Profit at the prices of the last order day; symbols without an order on it have no quote."""
    orders = fx.orders(spark, sf_dir)
    last = orders.agg(F.max("o_orderdate").alias("o_orderdate"))
    quotes = P.latest_quotes(orders.join(last, "o_orderdate", "left_semi"))
    return P.profit_by_symbol(P.open_positions(orders), quotes).withColumn("pnl", prices.round2("pnl"))


# --- sinks and streams ---------------------------------------------------------------------------

def _first_pull(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("date") < F.lit(FIRST_PULL_END).cast("timestamp_ntz"))


def _second_pull(bars: DataFrame) -> DataFrame:
    overlap = F.col("date") < F.lit(FIRST_PULL_END).cast("timestamp_ntz")
    later = bars.where(F.col("date") >= F.lit(SECOND_PULL_START).cast("timestamp_ntz"))
    return later.withColumn("close", F.when(overlap, F.col("close") + 1).otherwise(F.col("close")))


def _job(path: str) -> str:
    return path.rsplit("/", 1)[1]


def _candle_columns() -> list[str]:
    return [f.name for f in CANDLES]


@query
def candles_upsert(spark, sf_dir):
    bars = fx.bars(spark, sf_dir).select(*_candle_columns())
    path = fresh_dir(spark, "candles")
    sinks.upsert(_first_pull(bars), path, f"{_job(path)}/1")
    sinks.upsert(_second_pull(bars), path, f"{_job(path)}/2")
    return tables.read_candles(spark, path)


@query
def upsert_out_of_order(spark, sf_dir):
    """The newer pull lands first; versions decide, not the order of landing."""
    path = fresh_dir(spark, "late")
    first, second = _pulls(spark, sf_dir)
    sinks.upsert(second, path, f"{_job(path)}/1", version="pull")
    sinks.upsert(first, path, f"{_job(path)}/2", version="pull")
    return tables.read_candles(spark, path)


@query
def upsert_replayed(spark, sf_dir):
    """The older batch runs again after the newer one."""
    path = fresh_dir(spark, "again")
    first, second = (p.drop("pull") for p in _pulls(spark, sf_dir))
    for batch, n in ((first, 1), (second, 2), (first, 1)):
        sinks.upsert(batch, path, f"{_job(path)}/{n}")
    return tables.read_candles(spark, path)


@query
def pull_next_expiry(spark, sf_dir):
    """Both expiries around a strike of one's own, with strikes 50 apart."""
    path = fresh_dir(spark, "pulled")
    pipelines.pull(fx.bars(spark, sf_dir).select(*_candle_columns()), fx.contracts(spark, sf_dir), fx.spot(spark, sf_dir),
                   path, _job(path), num_strikes=3, next_expiry=True, steps={"IDX": 50}, custom={"IDX": 54300})
    return tables.read_candles(spark, path)


@query
def pull_selected(spark, sf_dir):
    path = fresh_dir(spark, "pulled")
    pipelines.pull(fx.bars(spark, sf_dir).select(*_candle_columns()), fx.contracts(spark, sf_dir),
                   fx.spot(spark, sf_dir), path, _job(path), num_strikes=3)
    return tables.read_candles(spark, path)


def _pulls(spark, sf_dir) -> list[DataFrame]:
    """Two overlapping pulls; ``pull`` tells which is newer."""
    bars = fx.bars(spark, sf_dir).select(*_candle_columns())
    return [part.withColumn("pull", F.lit(n))
            for n, part in enumerate((_first_pull(bars), _second_pull(bars)), start=1)]


def _land_and_run(pulls: list[DataFrame], landing: str, checkpoint: str,
                  job: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Every pull lands and is then taken in by the stream, which goes on from its checkpoint."""
    schema = T.StructType([*CANDLES.fields, T.StructField("pull", T.IntegerType())])
    for pull in pulls:
        pull.write.mode("append").parquet(landing)
        landed = pull.sparkSession.readStream.schema(schema).parquet(landing)
        jobs.run(job(landed), checkpoint)


@query
def stream_bars(spark, sf_dir):
    out = fresh_dir(spark, "stream-bars")
    closed = jobs.stream_bars(fx.tick_stream(spark, sf_dir), fx.BAR_WIDTH, WATERMARK)
    jobs.run(jobs.append_to(closed, f"{out}/data"), f"{out}/checkpoint")
    return spark.read.schema(closed.schema).parquet(f"{out}/data")


LATE_BEFORE, SECOND_HALF = "2024-01-10", "2024-01-20"


def late_deliveries(ticks: DataFrame) -> list[DataFrame]:
    """Three deliveries; a tenth of the early ticks comes with the last one, far behind the watermark."""
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit(LATE_BEFORE).cast("timestamp_ntz"))
    second = F.col("ts") >= F.lit(SECOND_HALF).cast("timestamp_ntz")
    return [ticks.where(~late & ~second), ticks.where(~late & second), ticks.where(late)]


@query
def stream_late(spark, sf_dir):
    out = fresh_dir(spark, "stream-late")
    for ticks in late_deliveries(fx.ticks(spark, sf_dir)):
        ticks.write.mode("append").parquet(f"{out}/landing")
        landed = spark.readStream.schema(ticks.schema).parquet(f"{out}/landing")
        jobs.refresh_bars(landed, f"{out}/ticks", f"{out}/candles", _job(out), fx.BAR_WIDTH, WATERMARK)
    return tables.read_candles(spark, f"{out}/candles")


@query
def stream_dedup(spark, sf_dir):
    out = fresh_dir(spark, "stream-dedup")
    bars = fx.bars(spark, sf_dir).select(*_candle_columns())
    _land_and_run(
        [bars.withColumn("pull", F.lit(n)) for n in (1, 2)], f"{out}/landing", f"{out}/checkpoint",
        lambda landed: jobs.append_to(jobs.stream_dedup(landed.drop("pull"), "60 days"), f"{out}/data"))
    return spark.read.schema(CANDLES).parquet(f"{out}/data")


@query
def stream_upsert(spark, sf_dir):
    out = fresh_dir(spark, "stream-upsert")
    _land_and_run(
        _pulls(spark, sf_dir), f"{out}/landing", f"{out}/checkpoint",
        lambda landed: jobs.upsert_to(landed, f"{out}/candles", _job(out), version="pull"))
    return tables.read_candles(spark, f"{out}/candles")


@query
def stream_rsi(spark, sf_dir):
    out = fresh_dir(spark, "stream-rsi")
    _land_and_run(
        _pulls(spark, sf_dir), f"{out}/landing", f"{out}/checkpoint",
        lambda landed: jobs.rsi_to(landed, f"{out}/candles", f"{out}/rsi", _job(out), version="pull"))
    return spark.read.parquet(f"{out}/rsi").select(*LEG, "bars", "rsi", "last_close", "previous_close")


@query
def stream_signals(spark, sf_dir):
    out = fresh_dir(spark, "stream-signals")
    _land_and_run(
        _pulls(spark, sf_dir), f"{out}/landing", f"{out}/checkpoint",
        lambda landed: jobs.signals_to(landed, f"{out}/candles", f"{out}/signals", _job(out),
                                       version="pull"))
    return spark.read.parquet(f"{out}/signals").select(
        *SERIES, "day", "date", "close", "rownum", "ROC_AVG_close", "incremental_close_avg",
        "StopLoss", "EntryAllowed")


SERIES_SIGNALS = [*SERIES, "day", "date", "close", "rownum", "ROC_AVG_close", *RUNNING, *RUNNING_LEGS, "StopLoss", "EntryAllowed"]
FRAME_DAYS = 7


@query
def stream_signals_series(spark, sf_dir):
    """Statistics that run through the whole series; the second pull revises days in its middle."""
    out = fresh_dir(spark, "stream-series")
    _land_and_run(
        _pulls(spark, sf_dir), f"{out}/landing", f"{out}/checkpoint",
        lambda landed: jobs.series_signals_to(landed, f"{out}/candles", f"{out}/signals", _job(out), version="pull"))
    return spark.read.parquet(f"{out}/signals").select(*SERIES_SIGNALS)


@query
def stream_signals_frame(spark, sf_dir):
    """The chart's own frame of the last days, which moves on with the second pull."""
    out = fresh_dir(spark, "stream-frame")
    _land_and_run(
        _pulls(spark, sf_dir), f"{out}/landing", f"{out}/checkpoint",
        lambda landed: jobs.frame_signals_to(landed, f"{out}/candles", f"{out}/signals", _job(out), FRAME_DAYS, version="pull"))
    return spark.read.parquet(f"{out}/signals").select(*SERIES_SIGNALS)


def flagship(spark: SparkSession, sf_dir: str, width: str) -> DataFrame:
    return steady(straddle_query(spark, sf_dir, S.WHOLE, width).select(*SIGNALS))
