"""One DuckDB statement per checked query. Shared steps are common table expressions.

The statements use plain windows over whole series and recursive expressions, where the Spark side
uses segments, carried totals and closed forms.
"""

from __future__ import annotations

import re

SERIES = "name, expiry, strike"
LEG = "name, expiry, strike, instrument_type, instrument_token"


def r6(x: str) -> str:
    """Six decimals. Ten are taken first, so that a value half way between two is still half way
    after the last bits of a floating-point sum have gone one way or the other."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE)"


def r2(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,6)), 2) AS DOUBLE)"


def roc(x: str, w: str, length: int = 20, divisor: float = 2, scale: float = 1) -> str:
    terms = " + ".join(
        f"({x} - lag({x}, {i}) OVER {w}) / nullif(lag({x}, {i}) OVER {w}, 0) * {scale}"
        for i in range(1, length + 1))
    return f"(({terms}) / {divisor})"


W = f"(PARTITION BY {SERIES} ORDER BY date)"
WL = f"(PARTITION BY {LEG} ORDER BY date)"
CUM = f"(PARTITION BY {SERIES} ORDER BY date ROWS UNBOUNDED PRECEDING)"
CUM_L = f"(PARTITION BY {LEG} ORDER BY date ROWS UNBOUNDED PRECEDING)"
DAYW = f"(PARTITION BY {SERIES}, day ORDER BY date ROWS UNBOUNDED PRECEDING)"


def bars_cte(width: str) -> str:
    return f"""
SELECT instrument_token, name, expiry, strike, instrument_type, time_bucket(INTERVAL '{width}', ts) AS date,
  min_by(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  max_by(price, (ts, event_id)) AS close, count(*) AS volume, CAST(sum(k) AS BIGINT) AS oi,
  CAST(time_bucket(INTERVAL '{width}', ts) AS DATE) AS day
FROM ticks GROUP BY ALL"""


CTES: dict[str, str] = {
    "ticks": """
SELECT ts, event_id, 'IDX' AS name, CAST(54100 + 100*(user_id % 5) AS DOUBLE) AS strike,
  CASE WHEN event_type IN ('click','purchase') THEN 'CE' ELSE 'PE' END AS instrument_type,
  CASE WHEN event_type IN ('click','view') THEN DATE '2024-02-01' ELSE DATE '2024-02-08' END AS expiry,
  CAST(100 + 4*(user_id % 5) + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1
       WHEN 'purchase' THEN 2 ELSE 3 END AS BIGINT) AS instrument_token,
  value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events WHERE event_type <> 'error'""",
    "spot": """
SELECT ts, event_id, 'IDX' AS name, 54300 + value AS price FROM events WHERE event_type = 'error'""",
    "bars": bars_cte("6 hours"),
    "day_bars": bars_cte("1 day"),
    "instr": """
SELECT p_partkey AS instrument_token, CAST(p_partkey AS VARCHAR) AS exchange_token,
  concat(p_name, '-', CAST(p_partkey AS VARCHAR)) AS tradingsymbol, p_brand AS name,
  p_retailprice AS last_price,
  CAST(DATE '2024-02-01' + CAST(7*(p_partkey % 4) AS INTEGER) AS DATE) AS expiry,
  CAST(100*p_size AS DOUBLE) AS strike, CAST(0.05 AS DOUBLE) AS tick_size, 15 AS lot_size,
  CASE WHEN p_type = 'STANDARD' THEN 'FUT' WHEN p_partkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS instrument_type,
  CASE WHEN p_type = 'STANDARD' THEN 'NFO-FUT' ELSE 'NFO-OPT' END AS segment, 'NFO' AS exchange
FROM part""",
    "ord": """
SELECT o_orderkey AS order_id, CAST(floor(o_orderkey / 2) AS BIGINT) AS parent_order_id,
  concat('S', CAST(o_custkey % 100 AS VARCHAR)) AS tradingsymbol,
  CASE o_orderstatus WHEN 'P' THEN 'TRIGGER PENDING' ELSE 'COMPLETE' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS transaction_type,
  1 + o_orderkey % 50 AS quantity, o_totalprice AS average_price, o_orderdate
FROM orders""",
    "quotes": """
SELECT tradingsymbol, max_by(average_price, (o_orderdate, order_id)) AS last_price
FROM ord GROUP BY tradingsymbol""",
    "contracts": """
SELECT DISTINCT instrument_token, name, expiry, strike, instrument_type, 15 AS lot_size,
  'NFO-OPT' AS segment FROM ticks""",
    "atm": """
SELECT name, last_price, CAST(100 AS DOUBLE) AS step,
  CAST(CASE WHEN last_price % 100 >= 50 THEN last_price + (100 - last_price % 100)
       ELSE last_price - last_price % 100 END AS BIGINT) AS atm_strike
FROM (SELECT name, max_by(price, (ts, event_id)) AS last_price FROM spot GROUP BY name)""",
    "chain": """
SELECT name, instrument_token, expiry,
  CASE WHEN lvl = 0 THEN 'ATM' WHEN lvl > 0 THEN 'ATM+' || CAST(CAST(lvl AS BIGINT) AS VARCHAR)
       ELSE 'ATM' || CAST(CAST(lvl AS BIGINT) AS VARCHAR) END AS Strike_level_Name,
  strike, CASE WHEN lvl < 0 THEN 'ITM' WHEN lvl > 0 THEN 'OTM' ELSE 'ATM' END AS Strike_level_type,
  lot_size, instrument_type, segment, lvl AS Strike_level,
  CASE WHEN lvl = 0 THEN 'ATM' WHEN (lvl < 0) = (instrument_type = 'CE') THEN 'ITM' ELSE 'OTM' END AS moneyness
FROM (SELECT c.*, (strike - atm_strike) / 100 AS lvl FROM contracts c JOIN atm USING (name)
      WHERE abs(strike - atm_strike) <= 8 * 100)""",
    "straddle_all": f"""
SELECT {SERIES}, day, date,
  {r2('sum(open)')} AS open, {r2('sum(high)')} AS high, {r2('sum(low)')} AS low, {r2('sum(close)')} AS close,
  CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(oi) AS BIGINT) AS oi,
  {r2("sum(close) FILTER (instrument_type = 'CE')")} AS CE_close,
  {r2("sum(close) FILTER (instrument_type = 'PE')")} AS PE_close,
  CAST(sum(oi) FILTER (instrument_type = 'CE') AS BIGINT) AS CE_oi,
  CAST(sum(oi) FILTER (instrument_type = 'PE') AS BIGINT) AS PE_oi,
  dense_rank() OVER (PARTITION BY {SERIES} ORDER BY day DESC) AS day_num
FROM bars WHERE volume > 0 GROUP BY {SERIES}, day, date""",
    "straddle": f"""
SELECT *, {r2('(open + high + low + close) / 4')} AS ohlc4 FROM straddle_all
WHERE CE_close IS NOT NULL AND PE_close IS NOT NULL""",
    "roc_rows": f"""
SELECT *, {roc('close', W)} AS ROC_AVG_close, {roc('CE_close', W)} AS ROC_AVG_CE_close,
  {roc('PE_close', W)} AS ROC_AVG_PE_close,
  day_num = min(day_num) OVER (PARTITION BY {SERIES}) AS IS_LATEST_DAY
FROM straddle""",
}


def running(source: str, cum: str, legs: bool = True) -> str:
    """Running statistics over one frame, in two steps because one of them reads another."""
    leg_cols = f""",
  sum(CE_close) OVER {cum} / count(close) OVER {cum} AS incremental_CE_close_avg,
  sum(PE_close) OVER {cum} / count(close) OVER {cum} AS incremental_PE_close_avg,
  sum(CE_close) OVER {cum} AS cumulative_sum_CE_close, sum(PE_close) OVER {cum} AS cumulative_sum_PE_close,
  min(CE_close) OVER {cum} AS running_min_ce, min(PE_close) OVER {cum} AS running_min_pe""" if legs else ""
    return f"""
SELECT *, max(incremental_close_avg) OVER {cum} AS MAX_incremental_close_avg,
  (incremental_min_close + incremental_close_avg) / 2 AS trailing_sl
FROM (SELECT *, sum(close) OVER {cum} AS cumulative_sum_close, count(close) OVER {cum} AS cumulative_count,
  CAST(sum(oi) OVER {cum} AS BIGINT) AS cumulative_sum_oi, min(close) OVER {cum} AS incremental_min_close,
  min(close) OVER {cum} AS cumulative_min_close,
  sum(close) OVER {cum} / count(close) OVER {cum} AS incremental_close_avg,
  sum(oi) OVER {cum} / count(close) OVER {cum} AS incremental_oi_avg,
  count(*) OVER {cum} AS rownum{leg_cols}
  FROM {source})"""


def signal_ctes(source: str, cum: str) -> dict[str, str]:
    """The five steps of the stop and the entry rule, one after the other."""
    return {
        "run": running(source, cum),
        "sl1": """
SELECT *, (ROC_AVG_CE_close + ROC_AVG_PE_close) / 2 AS ROC_AVG_CEPE_AVG,
  CASE WHEN CE_close > incremental_CE_close_avg AND CE_close > incremental_PE_close_avg AND ROC_AVG_close > 0 THEN high
       WHEN PE_close > incremental_CE_close_avg AND PE_close > incremental_PE_close_avg AND ROC_AVG_close > 0 THEN high
       ELSE MAX_incremental_close_avg END AS s1 FROM run""",
        "sl2": """
SELECT *, CASE WHEN CE_close = running_min_ce AND CE_close > PE_close AND CE_oi < PE_oi THEN high
       WHEN PE_close = running_min_pe AND PE_close > CE_close AND CE_oi > PE_oi THEN high ELSE s1 END AS s2 FROM sl1""",
        "sl3": """
SELECT *, CASE WHEN s2 > MAX_incremental_close_avg THEN MAX_incremental_close_avg ELSE s2 END AS s3 FROM sl2""",
        "sl4": """
SELECT *, CASE WHEN s3 < (incremental_min_close + incremental_close_avg) / 2
       THEN (incremental_min_close + incremental_close_avg + s3) / 3 ELSE s3 END AS s4 FROM sl3""",
        "sl5": f"""
SELECT *, min(s4) OVER {DAYW} AS StopLoss, first(CE_close) OVER {DAYW} AS CE_close_On_Open,
  first(PE_close) OVER {DAYW} AS PE_close_On_Open FROM sl4""",
        "sig": """
SELECT *, 0 AS MidPoint, CASE WHEN (CE_close > o OR PE_close > o) AND close > (incremental_min_close + incremental_close_avg) / 2
       THEN NULL ELSE close END AS EntryAllowed, o AS Open_Max_Close
FROM (SELECT *, greatest(CE_close_On_Open, PE_close_On_Open) AS o FROM sl5)""",
    }


SIGNAL_PLAIN = ["name", "expiry", "strike", "day", "day_num", "date", "volume", "oi", "CE_oi", "PE_oi",
                "rownum", "IS_LATEST_DAY", "MidPoint", "cumulative_count", "cumulative_sum_oi"]
SIGNAL_DOUBLE = ["open", "high", "low", "close", "CE_close", "PE_close", "ohlc4", "ROC_AVG_close",
                 "ROC_AVG_CE_close", "ROC_AVG_PE_close", "ROC_AVG_CEPE_AVG", "cumulative_sum_close",
                 "cumulative_min_close", "cumulative_sum_CE_close", "cumulative_sum_PE_close",
                 "incremental_min_close", "incremental_close_avg", "incremental_oi_avg",
                 "MAX_incremental_close_avg", "trailing_sl", "incremental_CE_close_avg",
                 "incremental_PE_close_avg", "running_min_ce", "running_min_pe", "StopLoss",
                 "CE_close_On_Open", "PE_close_On_Open", "Open_Max_Close", "EntryAllowed"]


def cols(plain, doubles) -> str:
    return ", ".join([*plain, *(f"{r6(c)} AS {c}" for c in doubles)])


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the expressions that ``body`` reads, directly or through others, in order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if word in known and word not in seen:
                seen.add(word)
                visit(known[word])
                needed.append(word)

    visit(body)
    if not needed:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({known[n]}\n)" for n in needed) + "\n" + body.strip()


BAR_PLAIN = ["instrument_token", "name", "expiry", "strike", "instrument_type", "date", "volume", "oi", "day"]
BAR_DOUBLE = ["open", "high", "low", "close"]
KEYS = ["name", "expiry", "strike"]
LEG_KEYS = ["name", "expiry", "strike", "instrument_type", "instrument_token"]
RUN_PLAIN = ["cumulative_count", "cumulative_sum_oi"]
RUN_DOUBLE = ["cumulative_sum_close", "cumulative_min_close", "incremental_min_close", "incremental_close_avg",
              "incremental_oi_avg", "MAX_incremental_close_avg", "trailing_sl"]
RUN_LEGS = ["cumulative_sum_CE_close", "cumulative_sum_PE_close", "incremental_CE_close_avg", "incremental_PE_close_avg", "running_min_ce", "running_min_pe"]
INSTR = ["instrument_token", "exchange_token", "tradingsymbol", "name", "expiry", "lot_size",
         "instrument_type", "segment", "exchange"]
UPSERTED = """
SELECT * REPLACE (CASE WHEN date >= TIMESTAMP '2024-01-10' AND date < TIMESTAMP '2024-01-20'
                  THEN close + 1 ELSE close END AS close) FROM bars"""


def _instruments() -> dict[str, str]:
    return {
        "instr_load": f"SELECT {cols(INSTR, ['last_price', 'strike', 'tick_size'])} FROM instr",
        "instr_segments": """SELECT name, segment, instrument_token, expiry, strike, instrument_type FROM instr
WHERE exchange = 'NFO' AND segment IN ('NFO-OPT', 'NFO-FUT')""",
        "instr_counts": "SELECT name, segment, count(*) AS contracts FROM instr GROUP BY ALL",
        "snapshot_roundtrip": f"SELECT {cols(INSTR, ['last_price', 'strike', 'tick_size'])} FROM instr",
        "expiry_list": "SELECT DISTINCT name, segment, expiry FROM instr",
        "expiry_calendar": """
SELECT n.name, n.cw AS current_week_expiry, n.cm AS current_month_expiry,
  min(i.expiry) FILTER (i.segment = 'NFO-OPT' AND i.expiry > n.cw) AS next_week_expiry,
  min(i.expiry) FILTER (i.segment = 'NFO-FUT' AND i.expiry > n.cm) AS next_month_expiry
FROM (SELECT name, min(expiry) FILTER (segment = 'NFO-OPT') AS cw,
        min(expiry) FILTER (segment = 'NFO-FUT') AS cm FROM instr GROUP BY name) n
JOIN instr i ON i.name = n.name GROUP BY n.name, n.cw, n.cm""",
        "round_step": """
SELECT o_orderkey,
  CAST(p - p % 100 + CASE WHEN p % 100 >= 50 THEN 100 ELSE 0 END AS BIGINT) AS near_100,
  CAST(p - p % 50 + CASE WHEN p % 50 >= 25 THEN 50 ELSE 0 END AS BIGINT) AS near_50,
  CAST(-(p - p % 100 + CASE WHEN p % 100 > 50 THEN 100 ELSE 0 END) AS BIGINT) AS below_zero_100
FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)""",
        "atm_strike": f"SELECT name, {r6('last_price')} AS last_price, step, atm_strike FROM atm",
        "chain_slice": "SELECT * FROM chain",
        "strike_token": """
SELECT c.name, c.expiry, c.Strike_level_Name, c.strike,
  max(ce.instrument_token) AS ce_token, max(pe.instrument_token) AS pe_token
FROM (SELECT DISTINCT name, expiry, Strike_level_Name, strike FROM chain) c
LEFT JOIN chain ce ON ce.name = c.name AND ce.expiry = c.expiry AND ce.strike = c.strike AND ce.instrument_type = 'CE'
LEFT JOIN chain pe ON pe.name = c.name AND pe.expiry = c.expiry AND pe.strike = c.strike AND pe.instrument_type = 'PE'
GROUP BY ALL""",
        "chain_bars": """
SELECT b.*, c.Strike_level, c.Strike_level_Name, c.Strike_level_type, c.lot_size
FROM bars b JOIN chain c ON b.instrument_token = c.instrument_token AND b.expiry = c.expiry""",
        "lookback_days": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS as_of,
  CAST(CASE dayofweek(o_orderdate) WHEN 6 THEN 6 WHEN 0 THEN 7 ELSE 5 END AS INTEGER) AS days_history
FROM orders""",
    }


def _bars() -> dict[str, str]:
    bars = f"SELECT {cols(BAR_PLAIN, BAR_DOUBLE)} FROM bars"
    leg_days = f"""
SELECT *, dense_rank() OVER (PARTITION BY {LEG} ORDER BY day DESC) - 1 AS day_num,
  {r2('(open + high + low + close) / 4')} AS ohlc4 FROM bars WHERE volume > 0"""
    straddle = [*KEYS, "day", "date", "volume", "oi", "CE_oi", "PE_oi", "day_num"]
    straddle_d = [*BAR_DOUBLE, "CE_close", "PE_close"]
    return {
        "ohlc_bars": bars,
        "candles_load": bars,
        "candles_rejected": """
SELECT CASE WHEN oi % 11 <> 0 THEN CAST(instrument_token AS VARCHAR) END AS instrument_token, CAST(expiry AS VARCHAR) AS expiry,
  CAST(volume AS VARCHAR) AS volume, CAST(oi AS VARCHAR) AS oi,
  concat_ws(',', CASE WHEN oi % 11 = 0 THEN 'instrument_token' END, CASE WHEN oi % 3 = 0 THEN 'date' END,
            CASE WHEN volume % 5 = 0 OR volume % 7 = 0 THEN 'close' END) AS reasons
FROM bars WHERE oi % 11 = 0 OR oi % 3 = 0 OR volume % 5 = 0 OR volume % 7 = 0""",
        "bars_clean": f"SELECT * REPLACE ({r6('close + 0.5')} AS close) FROM bars WHERE volume > 0",
        "leg_bars": f"""SELECT {cols([*BAR_PLAIN, 'day_num'], [*BAR_DOUBLE, 'ohlc4'])} FROM ({leg_days})
WHERE close > 0 AND day_num BETWEEN 1 AND 5""",
        "session_filter": f"{bars} WHERE (hour(date), minute(date)) < (15, 30)",
        "straddle_bars": f"SELECT {cols(straddle, [*straddle_d, 'ohlc4'])} FROM straddle",
        "last_n_days": f"""SELECT {cols([c for c in straddle if c != 'day_num'], straddle_d)},
  {r2('(open + high + low + close) / 4')} AS ohlc4, day_num - 1 AS day_num
FROM straddle_all WHERE day_num - 1 BETWEEN 1 AND 3""",
        "latest_day_flag": f"""SELECT {SERIES}, day, date, close,
  day_num = min(day_num) OVER (PARTITION BY {SERIES}) AS IS_LATEST_DAY FROM straddle""",
        "first_n_bars": f"""SELECT {SERIES}, date, close FROM straddle
QUALIFY row_number() OVER {W} <= 24""",
        "gap_fill": f"""
SELECT {SERIES}, CAST(date AS DATE) AS day, date,
  last_value(close IGNORE NULLS) OVER {CUM} AS close, last_value(CE_close IGNORE NULLS) OVER {CUM} AS CE_close,
  last_value(PE_close IGNORE NULLS) OVER {CUM} AS PE_close, last_value(oi IGNORE NULLS) OVER {CUM} AS oi
FROM (SELECT {SERIES}, unnest(generate_series(min(date), max(date), INTERVAL '6 hours')) AS date
      FROM straddle GROUP BY {SERIES})
LEFT JOIN (SELECT {SERIES}, date, close, CE_close, PE_close, oi FROM straddle) USING ({SERIES}, date)""",
        "synthetic_time": f"""
SELECT {SERIES}, date, rownum, TIMESTAMP '2026-01-01 09:15:00' + rownum * INTERVAL '3 minutes' AS made_time,
  strftime(TIMESTAMP '2026-01-01 09:15:00' + rownum * INTERVAL '3 minutes', '%H:%M') AS made_label
FROM (SELECT *, row_number() OVER {W} AS rownum FROM straddle)""",
    }


def _indicators() -> dict[str, str]:
    last20 = f"(PARTITION BY {SERIES} ORDER BY date ROWS 19 PRECEDING)"
    last21 = f"(PARTITION BY {SERIES} ORDER BY date ROWS 20 PRECEDING)"
    key_date = [*KEYS, "date"]
    bands = f"""avg(close) OVER {last20} AS bb_mid,
  avg(close) OVER {last20} + 2 * coalesce(stddev_samp(close) OVER {last20}, 0) AS bb_upper,
  avg(close) OVER {last20} - 2 * coalesce(stddev_samp(close) OVER {last20}, 0) AS bb_lower"""
    weighted = f"""sum(close * volume) OVER {CUM} / nullif(sum(volume) OVER {CUM}, 0) AS vwap,
  sum(close * oi) OVER {CUM} / nullif(sum(oi) OVER {CUM}, 0) AS oiwap"""
    ratios = "CE_close / nullif(PE_close, 0) AS ce_pe_ratio, PE_oi / nullif(CE_oi, 0) AS oi_pcr"
    decay = (f"(close - first(close) OVER {CUM}) / nullif(first(close) OVER {CUM}, 0) * 100"
             " AS premium_decay_pct")
    diff = f"avg(PE_oi - CE_oi) OVER {last21} AS oi_diff_avg"

    def latest(c: str) -> str:
        label = (f"CASE WHEN abs({c}) >= 1e6 THEN format('{{:,.0f}}', CAST({c} AS DOUBLE)) "
                 f"ELSE format('{{:,.2f}}', CAST({c} AS DOUBLE)) END")
        return f"{c}, {label} AS {c}_label"

    return {
        "roc_avg": f"""SELECT {cols(key_date, ['ROC_AVG_close', 'ROC_AVG_CE_close', 'ROC_AVG_PE_close'])},
  {r6('(ROC_AVG_CE_close + ROC_AVG_PE_close) / 2')} AS ROC_AVG_CEPE_AVG FROM roc_rows""",
        "running_stats": f"""SELECT {cols([*key_date, *RUN_PLAIN], [*RUN_DOUBLE, *RUN_LEGS])}
FROM ({running('straddle', CUM)})""",
        "bollinger": f"""SELECT {cols(key_date, ['close', 'bb_mid', 'bb_upper', 'bb_lower'])}
FROM (SELECT *, {bands} FROM straddle)""",
        "vwap_oiwap": f"SELECT {cols(key_date, ['vwap', 'oiwap'])} FROM (SELECT *, {weighted} FROM straddle)",
        "leg_ratios": f"""SELECT {cols(key_date, ['ce_pe_ratio', 'oi_pcr'])}
FROM (SELECT *, {ratios} FROM straddle)""",
        "oi_diff": f"""SELECT {cols([*key_date, 'oi_diff'], ['oi_diff_avg'])}
FROM (SELECT *, PE_oi - CE_oi AS oi_diff, {diff} FROM straddle)""",
        "roc_expanding": f"""SELECT {cols(key_date, ['ROC_AVG_close', 'roc_mean'])}
FROM (SELECT *, avg(ROC_AVG_close) OVER {CUM} AS roc_mean FROM roc_rows)""",
        "premium_decay": f"""SELECT {cols(key_date, ['close', 'premium_decay_pct'])}
FROM (SELECT *, {decay} FROM straddle)""",
        "day_boundaries": f"""SELECT {SERIES}, date, strftime(date, '%d-%b %H:%M') AS x_label,
  strftime(date, '%H:%M') AS time_label FROM straddle
QUALIFY CAST(date AS DATE) <> lag(CAST(date AS DATE)) OVER {W}""",
        "latest_values": f"""SELECT {SERIES}, date, {latest('close')}, {latest('CE_close')},
  {latest('PE_close')}, {latest('oi')} FROM straddle QUALIFY row_number() OVER
  (PARTITION BY {SERIES} ORDER BY date DESC) = 1""",
        "candle_summary": f"""SELECT {SERIES}, count(*) AS total, count(*) FILTER (close >= open) AS green,
  count(*) FILTER (close < open) AS red FROM straddle GROUP BY {SERIES}""",
        "series_range": f"""
SELECT {SERIES}, {r6('lo - pad')} AS axis_min, {r6('hi + pad')} AS axis_max
FROM (SELECT *, CASE WHEN hi <> lo THEN (hi - lo) * 0.05 ELSE 1 END AS pad
      FROM (SELECT {SERIES}, min(v) AS lo, max(v) AS hi
            FROM (SELECT {SERIES}, unnest([CE_close, PE_close]) AS v FROM straddle) GROUP BY {SERIES}))""",
        "extra_indicators": f"""
SELECT {cols([*key_date, 'oi_diff'], ['close', 'bb_mid', 'bb_upper', 'bb_lower', 'ce_pe_ratio', 'oi_pcr',
              'oi_diff_avg', 'vwap', 'oiwap', 'premium_decay_pct'])}
FROM (SELECT *, {bands}, {ratios}, PE_oi - CE_oi AS oi_diff, {diff}, {weighted}, {decay} FROM straddle)""",
    }


def _signals() -> dict[str, str]:
    out = {}
    whole = signal_ctes("roc_rows", CUM)
    daily = signal_ctes("roc_rows", DAYW)
    everything = f"SELECT {cols(SIGNAL_PLAIN, SIGNAL_DOUBLE)} FROM sig"
    out["straddle_signals"] = with_ctes(everything, whole)
    # Ten days of legs, then rate of change, then the latest day, then running statistics.
    recent = {**signal_ctes("latest", DAYW),
              "bars_recent": f"""SELECT * FROM bars WHERE volume > 0
QUALIFY dense_rank() OVER (PARTITION BY {SERIES} ORDER BY day DESC) <= 10""",
              "straddle_all": CTES["straddle_all"].replace("FROM bars WHERE volume > 0", "FROM bars_recent"),
              "latest": "SELECT * FROM roc_rows WHERE IS_LATEST_DAY"}
    out["straddle_signals_latest"] = with_ctes(everything, recent)
    out["stop_loss"] = with_ctes(
        f"SELECT {cols([*KEYS, 'day', 'date'], ['close', 'StopLoss'])} FROM sig", daily)
    out["entry_allowed"] = with_ctes(
        f"SELECT {cols([*KEYS, 'day', 'date'], ['Open_Max_Close', 'EntryAllowed'])} FROM sig", daily)
    legs = {"leg_rows": f"""
SELECT *, {r2('(open + high + low + close) / 4')} AS ohlc4, {roc('close', WL)} AS ROC_AVG_close,
  dense_rank() OVER (PARTITION BY {LEG} ORDER BY day DESC) AS day_num,
  day = max(day) OVER (PARTITION BY {LEG}) AS IS_LATEST_DAY
FROM bars WHERE volume > 0"""}
    out["leg_signals"] = with_ctes(
        f"""SELECT {cols([*LEG_KEYS, 'day', 'day_num', 'date', 'oi', 'rownum', 'IS_LATEST_DAY', *RUN_PLAIN],
                        ['close', 'ohlc4', 'ROC_AVG_close', *RUN_DOUBLE])}, 0 AS MidPoint FROM ({running('leg_rows', CUM_L, legs=False)})""",
        legs)
    return out


def _spreads() -> dict[str, str]:
    def pair(role: str, expiry: str) -> str:
        return f"""
SELECT name || '-' || CAST(CAST(strike AS BIGINT) AS VARCHAR) AS spread_id, name, DATE '2024-02-01' AS near_expiry,
  '{role}' AS role, day, date, {r2('sum(open)')} AS open, {r2('sum(high)')} AS high, {r2('sum(low)')} AS low,
  {r2('sum(close)')} AS close, {r2("sum(close) FILTER (instrument_type = 'CE')")} AS CE_close,
  {r2("sum(close) FILTER (instrument_type = 'PE')")} AS PE_close, CAST(sum(oi) AS BIGINT) AS oi,
  CAST(sum(oi) FILTER (instrument_type = 'CE') AS BIGINT) AS CE_oi,
  CAST(sum(oi) FILTER (instrument_type = 'PE') AS BIGINT) AS PE_oi,
  {r2("sum(leg4) FILTER (instrument_type = 'CE')")} AS CE_ohlc4,
  {r2("sum(leg4) FILTER (instrument_type = 'PE')")} AS PE_ohlc4,
  max(strike) FILTER (instrument_type = 'CE') AS CE_strike, max(strike) FILTER (instrument_type = 'PE') AS PE_strike,
  max(instrument_token) FILTER (instrument_type = 'CE') AS ce_token,
  max(instrument_token) FILTER (instrument_type = 'PE') AS pe_token,
  dense_rank() OVER (PARTITION BY name, strike ORDER BY day DESC) AS day_num
FROM (SELECT *, {r2('(open + high + low + close) / 4')} AS leg4 FROM bars WHERE volume > 0 AND close > 0)
WHERE expiry = DATE '{expiry}' GROUP BY name, strike, day, date"""

    ctes = {
        "short_pair": pair("Short", "2024-02-01"), "long_pair": pair("Long", "2024-02-08"),
        "pairs": f"""
SELECT * EXCLUDE (ce_token, pe_token), {r2('(open + high + low + close) / 4')} AS ohlc4,
  CAST(ce_token AS VARCHAR) || ', ' || CAST(pe_token AS VARCHAR) AS instrument_token
FROM (SELECT * FROM short_pair UNION ALL SELECT * FROM long_pair) WHERE CE_close > 0 AND PE_close > 0""",
        # Sides that agree in time and day number meet; the others stay alone.
        "spreads": f"""
SELECT spread_id, name, near_expiry, day, date, day_num,
  concat_ws(', ', s.instrument_token, l.instrument_token) AS instrument_token,
  s.close AS Short_close, l.close AS Long_close, {r2('s.close - l.close')} AS Close_Diff1,
  {r2('s.close + l.close')} AS Close_Diff2, s.oi AS Short_oi, l.oi AS Long_oi,
  s.ohlc4 AS Short_ohlc4, l.ohlc4 AS Long_ohlc4
FROM (SELECT * FROM pairs WHERE role = 'Short') s
FULL JOIN (SELECT * FROM pairs WHERE role = 'Long') l USING (spread_id, name, near_expiry, day, date, day_num)""",
    }
    w = "(PARTITION BY spread_id, name, near_expiry ORDER BY date, day_num)"
    rocs = ["Short_close", "Long_close", "Close_Diff1", "Close_Diff2"]
    return {
        "legs_resolve": """
SELECT s.name || '-' || CAST(CAST(s.strike AS BIGINT) AS VARCHAR) AS spread_id, s.name, DATE '2024-02-01' AS near_expiry,
  l.role, l.expiry, l.strike, l.instrument_type, c.instrument_token
FROM (SELECT DISTINCT name, strike FROM contracts WHERE expiry = DATE '2024-02-01') s,
LATERAL (VALUES ('Long', DATE '2024-02-01', 'CE', s.strike), ('Long', DATE '2024-02-01', 'PE', s.strike),
  ('Short', DATE '2024-02-08', 'CE', s.strike + 100), ('Short', DATE '2024-02-08', 'PE', s.strike - 100))
  l(role, expiry, instrument_type, strike)
JOIN contracts c ON c.name = s.name AND c.expiry = l.expiry AND c.instrument_type = l.instrument_type
  AND c.strike = l.strike""",
        "calendar_legs": with_ctes("SELECT * FROM pairs", ctes),
        "calendar_bars": with_ctes("SELECT * FROM spreads", ctes),
        "calendar_signals": with_ctes(
            "SELECT *, " + ", ".join(f"{r6(roc(c, w))} AS ROC_AVG_{c}" for c in rocs)
            + ", day_num = min(day_num) OVER (PARTITION BY spread_id, name, near_expiry) AS IS_LATEST_DAY FROM spreads",
            ctes),
    }


def _momentum() -> dict[str, str]:
    w21 = f"(PARTITION BY {SERIES} ORDER BY date ROWS 20 PRECEDING)"
    ctes = {
        "ratio": f"""
SELECT c.name, c.expiry, c.strike, c.day, c.date, c.open / nullif(p.open, 0) AS open,
  c.high / nullif(p.high, 0) AS high, c.low / nullif(p.low, 0) AS low, c.close / nullif(p.close, 0) AS close
FROM bars c JOIN bars p USING ({SERIES}, date) WHERE c.instrument_type = 'CE' AND p.instrument_type = 'PE'""",
        "compared": f"""
SELECT {SERIES}, date, {roc('hc', W, divisor=20, scale=100)} AS m
FROM (SELECT *, (open + high + low + close) / 4 AS hc FROM ratio)""",
        "own": f"""
SELECT {SERIES}, date, {roc('hc', W, divisor=20, scale=100)} AS m
FROM (SELECT *, (open + high + low + close) / 4 AS hc FROM bars WHERE instrument_type = 'CE')""",
        "compared_days": f"""
SELECT {SERIES}, date + INTERVAL '1 day' AS known_at, {roc('hc', W, divisor=20, scale=100)} AS m
FROM (SELECT c.name, c.expiry, c.strike, c.date, (c.open / nullif(p.open, 0) + c.high / nullif(p.high, 0)
        + c.low / nullif(p.low, 0) + c.close / nullif(p.close, 0)) / 4 AS hc
      FROM day_bars c JOIN day_bars p USING ({SERIES}, date) WHERE c.instrument_type = 'CE' AND p.instrument_type = 'PE')""",
        "base": f"""
SELECT {SERIES}, c.day, c.date, m.m AS base_avg, row_number() OVER {W} AS rn
FROM (SELECT * FROM bars WHERE instrument_type = 'CE') c LEFT JOIN compared m USING ({SERIES}, date)""",
        "lines": f"""
SELECT *, CASE WHEN rn >= 21 THEN greatest(max(base_avg) OVER {w21}, 0) END - base_avg AS neg_mmi,
  base_avg - CASE WHEN rn >= 21 THEN least(min(base_avg) OVER {w21}, 0) END AS pos_mmi FROM base""",
        "crossing": f"""
SELECT *, coalesce((pos_mmi > neg_mmi AND lag(pos_mmi) OVER {W} <= lag(neg_mmi) OVER {W})
  OR (pos_mmi < neg_mmi AND lag(pos_mmi) OVER {W} >= lag(neg_mmi) OVER {W}), false) AS crossed FROM lines""",
        "swapped": """
SELECT *, CASE WHEN pos_mmi < neg_mmi AND base_avg >= 0 THEN neg_mmi ELSE pos_mmi END AS p2,
  CASE WHEN pos_mmi < neg_mmi AND base_avg >= 0 THEN pos_mmi ELSE neg_mmi END AS n2 FROM crossing""",
        "momentum": f"""
SELECT {SERIES}, day, date, base_avg, neg_mmi, pos_mmi, crossed,
  last_value(CASE WHEN crossed THEN (pos_mmi + neg_mmi) / 2 END IGNORE NULLS) OVER {CUM} AS crosspoint,
  coalesce(p2 >= n2 OR base_avg >= 0, false) AS signal_up FROM swapped""",
        "ha_rows": f"""
SELECT *, (open + high + low + close) / 4 AS hc, row_number() OVER {WL} AS rn FROM bars""",
        "ha": f"""
SELECT {LEG}, date, high, low, hc, rn, (open + close) / 2 AS ho FROM ha_rows WHERE rn = 1
UNION ALL
SELECT n.name, n.expiry, n.strike, n.instrument_type, n.instrument_token, n.date, n.high, n.low, n.hc, n.rn,
  (p.ho + p.hc) / 2 FROM ha p JOIN ha_rows n ON n.instrument_token = p.instrument_token AND n.rn = p.rn + 1""",
        "changes": f"""
SELECT *, CASE WHEN close > prev THEN (close - prev) / prev * 100 ELSE 0 END AS g,
  CASE WHEN close > prev THEN 0 ELSE (prev - close) / close * 100 END AS l
FROM (SELECT *, lag(close) OVER {WL} AS prev, row_number() OVER {WL} - 1 AS i,
      count(*) OVER (PARTITION BY {LEG}) AS n FROM bars)""",
        "wilder": f"""
SELECT instrument_token, CAST(14 AS BIGINT) AS i, sum(g) / 14 AS ag, sum(l) / 14 AS al FROM changes
WHERE i BETWEEN 1 AND 14 AND n > 14 GROUP BY instrument_token
UNION ALL
SELECT c.instrument_token, c.i, (w.ag * 13 + c.g) / 14, (w.al * 13 + c.l) / 14
FROM wilder w JOIN changes c ON c.instrument_token = w.instrument_token AND c.i = w.i + 1""",
        "readings": f"""
SELECT c.name, c.expiry, c.strike, c.instrument_type, c.instrument_token, c.n AS bars,
  {r2('CASE WHEN w.al = 0 THEN 100 ELSE 100 - 100 / (1 + w.ag / w.al) END')} AS rsi,
  c.close AS last_close, c.prev AS previous_close
FROM changes c LEFT JOIN wilder w ON w.instrument_token = c.instrument_token AND w.i = c.i WHERE c.i = c.n - 1""",
        "scan": """
SELECT *, coalesce(rsi < 30 AND last_close > previous_close, false) AS buy_signal,
  CASE WHEN rsi > 70 THEN 'high' WHEN rsi < 30 THEN 'low' WHEN rsi IS NOT NULL THEN 'neutral' END AS band
FROM readings""",
    }

    def made(body: str) -> str:
        text = with_ctes(body, ctes)
        return text.replace("WITH ", "WITH RECURSIVE ", 1) if re.search(r"\b(ha|wilder) AS \(", text) else text

    key_date = [*KEYS, "date"]
    several = {**ctes, "base": f"""
SELECT name, expiry, strike, day, date, (m0 + m1 + m2) / 3 AS base_avg, row_number() OVER {W} AS rn
FROM (SELECT c.*, d.m AS m1 FROM (
        SELECT c.name, c.expiry, c.strike, c.day, c.date, m.m AS m0, o.m AS m2
        FROM (SELECT * FROM bars WHERE instrument_type = 'CE') c LEFT JOIN compared m USING ({SERIES}, date)
        LEFT JOIN own o USING ({SERIES}, date)) c
      ASOF LEFT JOIN (SELECT * FROM compared_days WHERE m IS NOT NULL) d
      ON c.name = d.name AND c.expiry = d.expiry AND c.strike = d.strike AND c.date >= d.known_at)"""}
    late = {"revised": UPSERTED, **ctes, "changes": ctes["changes"].replace("FROM bars", "FROM revised")}
    return {
        "mmi_multi": with_ctes(f"""SELECT {cols([*key_date, 'day', 'crossed', 'signal_up'],
                    ['base_avg', 'neg_mmi', 'pos_mmi', 'crosspoint'])} FROM momentum""", several),
        "stream_rsi": with_ctes(f"SELECT {LEG}, bars, rsi, last_close, previous_close FROM readings", late).replace(
            "WITH ", "WITH RECURSIVE ", 1),
        "scan_and_size": made(f"""
SELECT {LEG}, rsi, last_close, 'BUY' AS side, quantity,
  CASE WHEN quantity > 0 THEN (cents - ((cents % 5) + 5) % 5) / 100 END AS stop
FROM (SELECT *, CAST(round(CAST({r2('last_close - 100 / nullif(quantity, 0)')} AS DECIMAL(18,6)) * 100, 0) AS BIGINT) AS cents
      FROM (SELECT *, CAST(floor(10000 / nullif(last_close * 0.2, 0)) AS BIGINT) AS quantity FROM readings
            WHERE rsi < 55 AND last_close > previous_close)) ORDER BY rsi, {LEG} LIMIT 5"""),
        "ratio_bars": made(f"SELECT {cols([*key_date, 'day'], BAR_DOUBLE)} FROM ratio"),
        "heikin_ashi": made(f"""SELECT {LEG}, date, {r6('ho')} AS ha_open, {r6('greatest(high, ho, hc)')} AS ha_high,
  {r6('least(low, ho, hc)')} AS ha_low, {r6('hc')} AS ha_close FROM ha"""),
        "roc_mean_pct": made(f"""SELECT {LEG}, date, close,
  {r6(roc('close', WL, divisor=20, scale=100))} AS roc_mean FROM bars"""),
        "mtf_asof": made(f"""
SELECT b.name, b.expiry, b.strike, b.instrument_type, b.instrument_token, b.day, b.date, b.close,
  d.close AS day_close_asof
FROM bars b ASOF LEFT JOIN (SELECT *, date + INTERVAL '1 day' AS known_at FROM day_bars) d
ON b.instrument_token = d.instrument_token AND b.date >= d.known_at"""),
        "mmi": made(f"""SELECT {cols([*key_date, 'day', 'crossed', 'signal_up'],
                    ['base_avg', 'neg_mmi', 'pos_mmi', 'crosspoint'])} FROM momentum"""),
        "mmi_latest": made(f"""SELECT {SERIES}, date, {r2('base_avg')} AS reading, signal_up FROM momentum
QUALIFY row_number() OVER (PARTITION BY {SERIES} ORDER BY date DESC) = 1"""),
        "rsi": made(f"SELECT {LEG}, bars, rsi, last_close, previous_close FROM readings"),
        "rsi_scan": made("SELECT * FROM scan"),
        "order_intents": made(f"""
SELECT {LEG}, last_close, buy_signal, 'BUY' AS side, quantity,
  CASE WHEN quantity > 0 THEN (cents - ((cents % 5) + 5) % 5) / 100 END AS stop
FROM (SELECT *, CAST(round(CAST({r2('last_close - 100 / nullif(quantity, 0)')} AS DECIMAL(18,6)) * 100, 0) AS BIGINT) AS cents
      FROM (SELECT *, CAST(floor(10000 / nullif(last_close * 0.2, 0)) AS BIGINT) AS quantity FROM scan))"""),
    }


def _positions() -> dict[str, str]:
    ctes = {"positions": """
SELECT s.order_id, s.parent_order_id, s.tradingsymbol,
  CASE s.transaction_type WHEN 'BUY' THEN -s.quantity ELSE s.quantity END AS quantity, p.average_price
FROM ord s LEFT JOIN ord p ON p.order_id = s.parent_order_id WHERE s.status = 'TRIGGER PENDING'"""}
    return {
        "open_positions": with_ctes(
            f"SELECT order_id, parent_order_id, tradingsymbol, quantity, {r6('average_price')} AS average_price FROM positions", ctes),
        "positions_pnl": with_ctes(f"""
SELECT tradingsymbol, count(*) AS positions, {r2('sum((last_price - average_price) * quantity)')} AS pnl
FROM positions JOIN quotes USING (tradingsymbol) GROUP BY ROLLUP (tradingsymbol)""", ctes).replace(
            "count(*) AS positions", "count(*) AS positions, count(*) FILTER (last_price IS NULL) AS unquoted").replace(
            "positions JOIN quotes", "positions LEFT JOIN quotes"),
        "positions_marked": with_ctes(f"""
SELECT tradingsymbol, count(*) AS positions, count(*) FILTER (last_price IS NULL) AS unquoted,
  {r2('sum((last_price - average_price) * quantity)')} AS pnl
FROM positions LEFT JOIN (SELECT tradingsymbol, max_by(average_price, order_id) AS last_price FROM ord
  WHERE o_orderdate = (SELECT max(o_orderdate) FROM ord) GROUP BY tradingsymbol) USING (tradingsymbol)
GROUP BY ROLLUP (tradingsymbol)""", ctes),
    }


def _sinks() -> dict[str, str]:
    upserted = with_ctes(f"SELECT {cols(BAR_PLAIN, BAR_DOUBLE)} FROM ({UPSERTED})")
    bars = f"SELECT {cols(BAR_PLAIN, BAR_DOUBLE)} FROM bars"
    revised = {**signal_ctes("roc_rows", DAYW), "revised": UPSERTED,
               "straddle_all": CTES["straddle_all"].replace("FROM bars", "FROM revised")}
    closed = with_ctes(f"{bars} WHERE date + INTERVAL '6 hours' <= (SELECT max(ts) FROM ticks) - INTERVAL '12 hours'")
    return {
        "candles_upsert": upserted,
        "upsert_out_of_order": upserted,
        "upsert_replayed": upserted,
        "pull_next_expiry": with_ctes(f"""
SELECT {cols([f'b.{c} AS {c}' for c in BAR_PLAIN], [])}, b.open, b.high, b.low, b.close
FROM bars b SEMI JOIN (SELECT * FROM contracts WHERE abs(strike - 54300) <= 3 * 50) c USING (instrument_token, expiry)"""),
        "stream_upsert": upserted,
        "stream_dedup": with_ctes(bars),
        # Bars whose end the watermark has passed: twelve hours behind the newest tick.
        "stream_bars": closed,
        "stream_late": closed,
        "pull_selected": with_ctes(f"""
SELECT {cols([f'b.{c} AS {c}' for c in BAR_PLAIN], [])}, b.open, b.high, b.low, b.close
FROM bars b SEMI JOIN (SELECT * FROM chain WHERE abs(Strike_level) <= 3
  AND expiry = (SELECT min(expiry) FROM contracts)) c USING (instrument_token, expiry)"""),
        "stream_signals_series": with_ctes(
            f"""SELECT {cols([*KEYS, 'day', 'date', 'rownum', *RUN_PLAIN], ['close', 'ROC_AVG_close', *RUN_DOUBLE, *RUN_LEGS,
                'StopLoss', 'EntryAllowed'])} FROM sig""", revised | signal_ctes("roc_rows", CUM)),
        "stream_signals_frame": with_ctes(
            f"""SELECT {cols([*KEYS, 'day', 'date', 'rownum', *RUN_PLAIN], ['close', 'ROC_AVG_close', *RUN_DOUBLE, *RUN_LEGS,
                'StopLoss', 'EntryAllowed'])} FROM sig""", revised | signal_ctes("roc_rows", CUM) | {
                "straddle": CTES["straddle"] + " AND day_num <= 7"}),
        "stream_signals": with_ctes(
            f"""SELECT {cols([*KEYS, 'day', 'date', 'rownum'],
                ['close', 'ROC_AVG_close', 'incremental_close_avg', 'StopLoss', 'EntryAllowed'])} FROM sig""",
            revised),
    }


def oracles() -> dict[str, str]:
    plain = {**_instruments(), **_bars(), **_indicators()}
    done = {**{k: with_ctes(v) for k, v in plain.items()}, **_signals(), **_spreads_done(), **_momentum(),
            **_positions(), **_sinks()}
    # Segments of few days change the plan, not the result.
    again = ("roc_avg", "running_stats", "straddle_signals", "mmi", "mtf_asof", "rsi", "heikin_ashi", "gap_fill")
    return {**done, **{f"{k}_cut": done[k] for k in again}}


def _spreads_done() -> dict[str, str]:
    return {k: v if v.startswith("WITH") else with_ctes(v) for k, v in _spreads().items()}
