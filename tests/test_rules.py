"""Hand-checked tables for the rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strikelake.functions import labels, prices, sizing, strikes
from strikelake.operators import bars as B
from strikelake.operators import chain as C
from strikelake.operators import indicators as ind
from strikelake.operators import momentum as M
from strikelake.operators import positions as P
from strikelake.operators import signals as S
from strikelake.operators import spreads as X
from strikelake.plans import pipelines

D = dt.date


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("v")).first().v


@pytest.mark.parametrize("price,step,want", [
    (-50.0, 100, 0), (-51.0, 100, -100), (-1.0, 100, 0), (0.0, 100, 0), (49.99, 100, 0), (50.0, 100, 100),
    (149.5, 100, 100), (22976.0, 100, 23000), (22976.0, 50, 23000), (22974.99, 50, 22950), (25.0, 50, 50)])
def test_round_to_step(spark, price, step, want):
    assert one(spark, strikes.round_to_step("x", step), x=price) == want


@pytest.mark.parametrize("level,name,kind", [
    (-2.0, "ATM-2", "ITM"), (-1.05, "ATM-1.05", "ITM"), (-0.5, "ATM-0.5", "ITM"), (0.0, "ATM", "ATM"),
    (0.5, "ATM+0.5", "OTM"), (3.0, "ATM+3", "OTM"), (10.0, "ATM+10", "OTM")])
def test_level_names(spark, level, name, kind):
    assert one(spark, strikes.level_name("x"), x=level) == name
    assert one(spark, strikes.level_type("x"), x=level) == kind


def test_moneyness_follows_the_side(spark):
    for level, side, want in ((-1.0, "CE", "ITM"), (-1.0, "PE", "OTM"), (1.0, "PE", "ITM"), (0.0, "PE", "ATM")):
        assert one(spark, strikes.moneyness("x", "s"), x=level, s=side) == want


def test_rounding_goes_half_up(spark):
    assert one(spark, prices.round2("x"), x=1.005) == 1.01
    assert one(spark, prices.round2("x"), x=-2.345) == -2.35


def test_ratio_with_zero(spark):
    assert one(spark, prices.ratio("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, prices.ratio("a", "b"), a=0.0, b=0.0) is None


def test_labels(spark):
    at = dt.datetime(2024, 3, 11, 9, 15)
    assert one(spark, labels.axis_label("t"), t=at) == "11-Mar 09:15"
    assert one(spark, labels.axis_label("t", False), t=at) == "09:15"
    assert one(spark, labels.value_label("x"), x=1234.5) == "1,234.50"
    assert one(spark, labels.value_label("x"), x=-1234567.8) == "-1,234,568"
    assert one(spark, labels.synthetic_time("n"), n=5) == dt.datetime(2026, 1, 1, 9, 30)
    for day, want in ((D(2024, 3, 15), 5), (D(2024, 3, 16), 6), (D(2024, 3, 17), 7), (D(2024, 3, 18), 5)):
        assert one(spark, labels.lookback_days("d", 5), d=day) == want


@pytest.mark.parametrize("side,price,qty,want", [
    ("BUY", 101.03, 50, 99.0), ("SELL", 101.03, 50, 103.0), ("BUY", 1.15, 1000, 1.05), ("BUY", 10.0, None, None)])
def test_stop_trigger(spark, side, price, qty, want):
    row = spark.createDataFrame([(price, qty, side)], "p double, q bigint, s string")
    assert row.select(sizing.stop_trigger("p", "q", 100, "s").alias("v")).first().v == want


def test_order_quantity(spark):
    assert one(spark, sizing.order_quantity(1000, "m"), m=300.0) == 3
    assert one(spark, sizing.order_quantity(1000, "m"), m=3000.0) == 0
    assert one(spark, sizing.order_quantity(1000, "m"), m=0.0) is None


def bars(spark, rows):
    """rows: (day, slot, close, high, CE, PE, CE_oi, PE_oi)"""
    data = [("X", D(2024, 1, d), dt.datetime(2024, 1, d, 9 + s), float(c), float(h), float(ce), float(pe),
             ceo, peo, ceo + peo)
            for d, s, c, h, ce, pe, ceo, peo in rows]
    return spark.createDataFrame(data, "name string, day date, date timestamp_ntz, close double, high double, "
                                 "CE_close double, PE_close double, CE_oi bigint, PE_oi bigint, oi bigint")


def stops(spark, rows, frame=S.WHOLE):
    out = S.straddle_signals(bars(spark, rows), ["name"], frame).orderBy("date").collect()
    return [r.StopLoss for r in out], out


def test_stop_rests_on_the_ceiling_and_never_rises_within_a_day(spark):
    got, rows = stops(spark, [(1, 0, 100, 110, 60, 40, 5, 5), (1, 1, 80, 90, 45, 35, 5, 5),
                              (1, 2, 120, 130, 70, 50, 5, 5)])
    # Averages 100, 90, 100; ceilings 100; no event, so the stop is the ceiling throughout.
    assert [r.MAX_incremental_close_avg for r in rows] == [100, 100, 100]
    assert got == [100, 100, 100]


def test_call_at_its_low_takes_the_high_cut_by_the_ceiling(spark):
    # First bar: the call is at its minimum, above the put, with less interest: high 95 is below
    # the ceiling 100, and below the trailing line 100, so (2 * 100 + 95) / 3.
    got, _ = stops(spark, [(1, 0, 100, 95, 60, 40, 1, 5)])
    assert got == [pytest.approx((200 + 95) / 3)]
    # The same with a high above the ceiling.
    got, _ = stops(spark, [(1, 0, 100, 150, 60, 40, 1, 5)])
    assert got == [100]


def test_put_at_its_low_needs_more_call_interest(spark):
    got, _ = stops(spark, [(1, 0, 100, 95, 40, 60, 5, 1)])
    assert got == [pytest.approx((200 + 95) / 3)]
    got, _ = stops(spark, [(1, 0, 100, 95, 40, 60, 1, 5)])
    assert got == [100]


def test_breakout_needs_a_positive_rate_of_change(spark):
    rows = [(1, 0, 100, 100, 50, 50, 5, 5)]
    rows = [(d, s, 100, 100, 50, 50, 5, 5) for d in range(1, 6) for s in range(4)]
    # The 21st bar rises: ROC = 20 * 0.2 / 2, the call is above both averages, the high is 99.
    rows.append((6, 0, 120, 99, 70, 50, 5, 5))
    _, out = stops(spark, rows)
    last = out[-1]
    assert last.ROC_AVG_close == pytest.approx(2.0)
    avg = 2120 / 21
    floor = (100 + avg) / 2
    assert last.StopLoss == pytest.approx((2 * floor + 99) / 3)
    assert out[-2].ROC_AVG_close is None


def test_flat_prices_have_no_rate_of_change(spark):
    rows = [(d, s, 100.1, 101, 50.05, 50.05, 5, 5) for d in range(1, 8) for s in range(4)]
    out = ind.roc_average(bars(spark, rows), keys=["name"]).orderBy("date").collect()
    assert [r.ROC_AVG_close for r in out] == [None] * 20 + [0.0] * 8


def test_rate_of_change_with_a_zero(spark):
    rows = [(d, s, 0.0 if (d, s) == (1, 0) else 10.0, 1, 1, 1, 1, 1) for d in range(1, 7) for s in range(4)]
    out = ind.roc_average(bars(spark, rows), ["close"], ["name"]).orderBy("date").collect()
    assert [r.ROC_AVG_close for r in out] == [None] * 21 + [0.0] * 3


def test_entry_is_blocked_above_the_open(spark):
    _, rows = stops(spark, [(1, 0, 100, 100, 60, 40, 1, 1), (1, 1, 110, 110, 65, 45, 1, 1),
                            (1, 2, 90, 90, 50, 40, 1, 1), (2, 0, 95, 95, 55, 40, 1, 1)])
    assert [r.Open_Max_Close for r in rows] == [60, 60, 60, 55]
    assert [r.EntryAllowed for r in rows] == [100, None, 90, 95]


def test_latest_day_is_cut_after_the_rate_of_change(spark):
    rows = [(d, s, 100.0 + d + s, 120, 50, 50, 1, 1) for d in range(1, 8) for s in range(4)]
    _, whole = stops(spark, rows)
    _, latest = stops(spark, rows, S.LATEST)
    assert [r.rownum for r in latest] == [1, 2, 3, 4]
    assert [r.ROC_AVG_close for r in latest] == [r.ROC_AVG_close for r in whole[-4:]]
    assert latest[0].incremental_close_avg == latest[0].close


def test_signal_properties(spark):
    import random
    rng = random.Random(3)
    rows = [(d, s, rng.uniform(50, 150), rng.uniform(100, 200), rng.uniform(20, 80), rng.uniform(20, 80),
             rng.randint(1, 9), rng.randint(1, 9)) for d in range(1, 20) for s in range(6)]
    _, out = stops(spark, rows)
    for a, b in zip(out, out[1:]):
        if a.day == b.day:
            assert b.StopLoss <= a.StopLoss
        assert b.StopLoss <= b.MAX_incremental_close_avg + 1e-9


def legs(spark, rows):
    data = [("X", D(2024, 2, 1), 100.0, kind, tok, D(2024, 1, d), dt.datetime(2024, 1, d, 9 + s), c, c, c, c, v, 1)
            for d, s, kind, tok, c, v in rows]
    return spark.createDataFrame(data, "name string, expiry date, strike double, instrument_type string, "
                                 "instrument_token bigint, day date, date timestamp_ntz, open double, high double, "
                                 "low double, close double, volume bigint, oi bigint")


def test_missing_leg_keeps_its_day_number(spark):
    rows = [(1, 0, "CE", 1, 10.0, 1), (1, 0, "PE", 2, 20.0, 1), (2, 0, "CE", 1, 11.0, 1),
            (3, 0, "CE", 1, 12.0, 1), (3, 0, "PE", 2, 22.0, 1), (3, 1, "PE", 2, 22.0, 0)]
    both = {r.day.day: r for r in B.straddle_bars(legs(spark, rows)).collect()}
    assert {d: r.day_num for d, r in both.items()} == {1: 3, 3: 1}
    assert both[3].close == 34.0
    loose = {r.day.day: r for r in B.straddle_bars(legs(spark, rows), both_legs=False).collect()}
    assert loose[2].PE_close is None and loose[2].day_num == 2
    signals = {r.day.day: r.day_num for r in S.straddle_signals(
        B.straddle_bars(legs(spark, rows), both_legs=False, numbered=False), frame=S.WHOLE).collect()}
    assert signals == {1: 3, 3: 1}


def test_last_days(spark):
    rows = [(d, 0, "CE", 1, 10.0, 1) for d in (1, 2, 5, 9)]
    got = {r.day.day: r.day_num for r in B.last_days(legs(spark, rows), num_days=2, days_back=1).collect()}
    assert got == {5: 1, 2: 2}


def test_latest_delivery_wins(spark):
    rows = legs(spark, [(1, 0, "CE", 1, 10.0, 1)]).withColumn("pull", F.lit(1))
    again = rows.withColumn("close", F.lit(11.0)).withColumn("pull", F.lit(2))
    assert [r.close for r in B.clean_bars(again.unionByName(rows), "pull").collect()] == [11.0]
    assert B.clean_bars(rows.unionByName(rows)).count() == 1


def test_gap_fill(spark):
    rows = legs(spark, [(1, 0, "CE", 1, 10.0, 1), (1, 3, "CE", 1, 13.0, 1)])
    got = B.fill_gaps(rows, 3600, ["name"], ["close"]).orderBy("date").collect()
    assert [(r.date.hour, r.close) for r in got] == [(9, 10.0), (10, 10.0), (11, 10.0), (12, 13.0)]
    with pytest.raises(ValueError):
        B.fill_gaps(rows, 7 * 3600, ["name"], ["close"])


def test_expiry_calendar_without_a_second_expiry(spark):
    rows = [("A", "NFO-OPT", D(2024, 2, 1)), ("A", "NFO-OPT", D(2024, 2, 8)), ("A", "NFO-OPT", D(2024, 2, 1)),
            ("A", "NFO-FUT", D(2024, 2, 29)), ("B", "NFO-OPT", D(2024, 2, 1))]
    df = spark.createDataFrame(rows, "name string, segment string, expiry date")
    got = {r.name: tuple(r)[1:] for r in C.expiry_calendar(df).collect()}
    assert got["A"] == (D(2024, 2, 1), D(2024, 2, 29), D(2024, 2, 8), None)
    assert got["B"] == (D(2024, 2, 1), None, None, None)
    assert C.chosen_expiries(C.expiry_calendar(df), True).count() == 3


def test_atm_steps_and_custom_strike(spark):
    ticks = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1, 9), 1, 149.0), ("A", dt.datetime(2024, 1, 1, 10), 2, 174.0),
         ("B", dt.datetime(2024, 1, 1, 9), 3, 174.0)],
        "name string, ts timestamp_ntz, event_id bigint, price double")
    got = {r.name: r.atm_strike for r in C.atm_strikes(ticks, {"A": 50}).collect()}
    assert got == {"A": 150, "B": 200}
    got = {r.name: r.atm_strike for r in C.atm_strikes(ticks, custom={"B": 500}).collect()}
    assert got == {"A": 200, "B": 500}


def test_strike_lookup(spark):
    chain = spark.createDataFrame(
        [("A", D(2024, 2, 1), "ATM", 100.0, "CE", 1), ("A", D(2024, 2, 1), "ATM", 100.0, "PE", 2)],
        "name string, expiry date, Strike_level_Name string, strike double, instrument_type string, instrument_token bigint")
    assert [r.instrument_token for r in C.strike_token(chain, "A", D(2024, 2, 1), "ATM", "PE").collect()] == [2]
    assert C.strike_token(chain, "A", D(2024, 2, 1), "ATM+1", "PE").count() == 0
    assert tuple(C.strike_tokens(chain).first())[-2:] == (1, 2)


def test_spread_sides_meet_only_on_the_same_day_number(spark):
    rows = [("S", "X", D(2024, 2, 1), role, D(2024, 1, d), dt.datetime(2024, 1, d, 9), num, close, 1, close, tok)
            for role, d, num, close, tok in (("Short", 1, 2, 10.0, "1, 2"), ("Long", 1, 2, 4.0, "3, 4"),
                                             ("Short", 2, 1, 11.0, "1, 2"), ("Long", 2, 3, 5.0, "3, 4"))]
    pairs = spark.createDataFrame(rows, "spread_id string, name string, near_expiry date, role string, day date, "
                                  "date timestamp_ntz, day_num bigint, close double, oi bigint, ohlc4 double, "
                                  "instrument_token string")
    got = sorted((r.day.day, r.day_num, r.Close_Diff1, r.Close_Diff2, r.instrument_token)
                 for r in X.spread_bars(pairs).collect())
    assert got[0] == (1, 2, 6.0, 14.0, "1, 2, 3, 4")
    assert [g[2] for g in got[1:]] == [None, None]
    latest = X.spread_signals(X.spread_bars(pairs), latest_only=True).collect()
    assert {r.day_num for r in latest} == {1}


def test_as_of_sees_no_future(spark):
    chart = spark.createDataFrame([("A", dt.datetime(2024, 1, d, h)) for d in (1, 2, 3) for h in (0, 12)],
                                  "name string, date timestamp_ntz")
    coarse = spark.createDataFrame([("A", dt.datetime(2024, 1, d + 1), float(d)) for d in (1, 2)],
                                   "name string, known timestamp_ntz, v double")
    got = [r.v_asof for r in M.as_of(chart, coarse, "v", "known", ["name"], days=1).orderBy("date").collect()]
    assert got == [None, None, 1.0, 1.0, 2.0, 2.0]


def test_positions(spark):
    orders = spark.createDataFrame(
        [(1, None, "A", "COMPLETE", "BUY", 5, 100.0, 1), (1, None, "A", "COMPLETE", "BUY", 5, 999.0, 2),
         (2, 1, "A", "TRIGGER PENDING", "SELL", 5, 0.0, 3), (3, 77, "A", "TRIGGER PENDING", "BUY", 4, 0.0, 4)],
        "order_id bigint, parent_order_id bigint, tradingsymbol string, status string, transaction_type string, "
        "quantity bigint, average_price double, o_orderdate bigint")
    got = {r.order_id: (r.quantity, r.average_price) for r in P.open_positions(orders).collect()}
    assert got == {2: (5, 100.0), 3: (-4, None)}
    quotes = spark.createDataFrame([("A", 110.0)], "tradingsymbol string, last_price double")
    pnl = {r.tradingsymbol: r.pnl for r in P.profit_by_symbol(P.open_positions(orders), quotes).collect()}
    assert pnl == {"A": 50.0, None: 50.0}


def test_order_limit(spark):
    df = spark.createDataFrame([("B", 10.0, 2.0), ("A", 10.0, 2.0)], "name string, last_close double, margin double")
    got = P.order_intents(df, 100, 10, max_orders=1, rank_by="name").collect()
    assert [(r.name, r.quantity, r.stop) for r in got] == [("A", 50, 9.8)]


def test_base_average_is_null_with_any_gap(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None)], "a double, b double")
    assert [r.v for r in df.select(M.base_average([F.col("a"), F.col("b")]).alias("v")).collect()] == [2.0, None]


def test_range_of_equal_values(spark):
    df = spark.createDataFrame([("A", 2.0, 2.0)], "name string, a double, b double")
    r = ind.series_range(df, "a", "b", ["name"]).first()
    assert (r.axis_min, r.axis_max) == (1.0, 3.0)


def test_momentum_keeps_all_chart_bars_in_any_order(spark):
    days = [(f"2024-01-{1 + i // 3:02d}", i) for i in range(60)]
    df = spark.createDataFrame(days, "d string, i int").selectExpr(
        "'N' as name", "cast(d as date) as day", "timestampadd(HOUR, i % 3, cast(d as timestamp_ntz)) as date",
        "100D + i % 7 as open", "104D + i % 5 as high", "96D + i % 3 as low", "100D + i % 4 as close", "i")
    gapped = df.where("i % 3 <> 1")
    a = pipelines.momentum(df, [df, gapped], ["name"]).collect()
    b = pipelines.momentum(df, [gapped, df], ["name"]).collect()
    assert len(a) == len(b) == 60
    assert sorted((str(r.date), r.base_avg) for r in a) == sorted((str(r.date), r.base_avg) for r in b)


def test_the_grid_of_a_gap_fill_is_made_in_several_tasks(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-20", 2.0)], "d string, close double").selectExpr(
        "'N' as name", "cast(d as timestamp_ntz) as date", "close")
    plan = B.fill_gaps(df, 3600, ["name"], ["close"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") > 0
    assert B.fill_gaps(df, 3600, ["name"], ["close"]).count() == 19 * 24 + 1
