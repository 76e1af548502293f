"""Segmented windows must equal plain windows over the whole series, whatever the segment size."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strikelake.operators import indicators as ind
from strikelake.operators import momentum as M
from strikelake.operators import segments
from strikelake.operators import signals as S
from strikelake.operators.segments import cut
from strikelake.plans import catalog
from strikelake.schemas import SERIES

KEYS = ["name"]


def series(spark, seed, series_days=(("A", 70), ("B", 23), ("C", 1), ("D", 40))):
    """Bars with uneven days, gaps, repeated prices, NULL legs and a zero."""
    rng = random.Random(seed)
    rows = []
    for name, days in series_days:
        day = dt.date(2024, 1, 1)
        for _ in range(days):
            day += dt.timedelta(days=rng.choice([1, 1, 1, 3]))
            for slot in sorted(rng.sample(range(8), rng.randint(1, 5))):
                at = dt.datetime.combine(day, dt.time(9 + slot))
                px = [round(rng.choice([10.0, 10.05, rng.uniform(1, 200)]), 2) for _ in range(4)]
                ce, pe = round(rng.uniform(1, 50), 2), round(rng.uniform(1, 50), 2)
                if rng.random() < 0.05:
                    ce = None
                if rng.random() < 0.01:
                    px[3] = 0.0
                rows.append((name, day, at, px[0], max(px), min(px), px[3], rng.randint(1, 9),
                             rng.randint(0, 5), ce, pe, rng.randint(0, 9), rng.randint(0, 9)))
    return spark.createDataFrame(rows, "name string, day date, date timestamp_ntz, open double, high double, "
                                 "low double, close double, volume bigint, oi bigint, CE_close double, "
                                 "PE_close double, CE_oi bigint, PE_oi bigint").cache()


def same(a, b, columns):
    def rows(df):
        out = {}
        for r in df.select("name", "date", *columns).collect():
            out[(r["name"], r["date"])] = r
        return out
    left, right = rows(a), rows(b)
    assert left.keys() == right.keys()
    for key, row in left.items():
        for c in columns:
            x, y = row[c], right[key][c]
            assert (x is None) == (y is None), (key, c, x, y)
            if isinstance(x, float):
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9), (key, c)
            else:
                assert x == y, (key, c)


@pytest.mark.parametrize("seed", [1, 2])
def test_running_aggregates_and_numbers(spark, seed):
    df = series(spark, seed)
    w = Window.partitionBy("name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns({
        "s": F.sum("CE_close").over(w), "n": F.count("CE_close").over(w), "lo": F.min("CE_close").over(w),
        "hi": F.max("close").over(w), "f": F.first("CE_close", ignorenulls=True).over(w),
        "l": F.last("CE_close", ignorenulls=True).over(w), "rn": F.count(F.lit(1)).over(w)})
    seg = cut(df, KEYS, days=3, carry={
        "s": ("sum", F.col("CE_close")), "n": ("count", F.col("CE_close")), "lo": ("min", F.col("CE_close")),
        "hi": ("max", F.col("close")), "f": ("first", F.col("CE_close")), "l": ("last", F.col("CE_close"))})
    ours = seg.finish(seg.df.withColumns({
        **{c: seg.running(c) for c in ("s", "n", "lo", "hi", "f", "l")}, "rn": seg.rownum()}))
    same(plain, ours, ["s", "n", "lo", "hi", "f", "l", "rn"])


@pytest.mark.parametrize("days", [21, 25, 1000])
def test_rolling_windows_cross_segments(spark, days):
    df = series(spark, 3)
    w = Window.partitionBy("name").orderBy("date")
    lags = sum((F.try_divide(F.col("close") - F.lag("close", i).over(w), F.lag("close", i).over(w))
                for i in range(2, 21)),
               F.try_divide(F.col("close") - F.lag("close", 1).over(w), F.lag("close", 1).over(w)))
    plain = df.withColumns({
        "ROC_AVG_close": lags / 2,
        "bb_mid": F.avg("close").over(w.rowsBetween(-19, 0)),
        "diff_avg": F.avg(F.col("PE_oi") - F.col("CE_oi")).over(w.rowsBetween(-20, 0))})
    same(plain, ind.roc_average(df, ["close"], KEYS, days=days), ["ROC_AVG_close"])
    same(plain, ind.bollinger_bands(df, KEYS, days=days), ["bb_mid"])
    same(plain, ind.oi_difference(df, KEYS, days=days).withColumnRenamed("oi_diff_avg", "diff_avg"), ["diff_avg"])


def test_rows_are_neither_lost_nor_doubled(spark):
    df = series(spark, 4)
    for days in (20, 33):
        assert ind.roc_average(df, ["close"], KEYS, days=days).count() == df.count()


@pytest.mark.parametrize("frame", [S.WHOLE, S.DAY, S.LATEST])
def test_signals_do_not_depend_on_the_segment_size(spark, frame):
    df = series(spark, 5)
    columns = ["rownum", "day_num", "IS_LATEST_DAY", "ROC_AVG_close", "ROC_AVG_CEPE_AVG", *[
        "incremental_close_avg", "incremental_oi_avg", "MAX_incremental_close_avg", "running_min_ce",
        "incremental_PE_close_avg", "StopLoss", "EntryAllowed", "Open_Max_Close"]]
    same(S.straddle_signals(df, KEYS, frame, days=1000), S.straddle_signals(df, KEYS, frame, days=20), columns)


def test_momentum_does_not_depend_on_the_segment_size(spark):
    df = series(spark, 6, (("A", 80), ("B", 30))).withColumn("base_avg", F.col("close") - 60)
    columns = ["neg_mmi", "pos_mmi", "crossed", "crosspoint", "signal_up"]
    same(M.mmi(df, KEYS, days=1000), M.mmi(df, KEYS, days=22), columns)


def smoothed(rows):
    """The recursion bar by bar; a bar that lacks a price is passed over."""
    want, before = {}, None
    for r in rows:
        if None in (r.open, r.high, r.low, r.close):
            want[r.name, r.date] = None
            continue
        open_ = (r.open + r.close) / 2 if before is None else sum(before) / 2
        before = open_, (r.open + r.high + r.low + r.close) / 4
        want[r.name, r.date] = open_
    return want


@pytest.mark.parametrize("block", [3, 500])
@pytest.mark.parametrize("days", [1, 5, 1000])
def test_smoothed_bars_equal_the_recursion(spark, monkeypatch, days, block):
    """With bars that lack prices, one series that begins with some, and blocks within and beyond a segment."""
    monkeypatch.setattr(segments, "DECAY_BLOCK", block)
    df = series(spark, 7, (("A", 90), ("B", 2), ("C", 12)))
    gap = ((F.hash("date") % 11) == 0) | ((F.col("name") == "C") & (F.col("day") < F.lit("2024-01-05")))
    df = df.withColumn("low", F.when(~gap, F.col("low"))).withColumn("close", F.when((F.hash("date") % 17) != 1, F.col("close")))
    want = {}
    for name in "ABC":
        want |= smoothed(df.where(F.col("name") == name).orderBy("date").collect())
    assert None in want.values()
    got = {(r.name, r.date): r for r in M.heikin_ashi(df, KEYS, days=days).collect()}
    assert got.keys() == want.keys()
    for k, open_ in want.items():
        r = got[k]
        if open_ is None:
            assert (r.ha_open, r.ha_high, r.ha_low, r.ha_close) == (None,) * 4
        else:
            assert r.ha_open == pytest.approx(open_, rel=1e-13)
            assert r.ha_high == max(r.high, r.ha_open, r.ha_close) and r.ha_low == min(r.low, r.ha_open, r.ha_close)


def test_decays_restart_with_the_frame(spark):
    df = series(spark, 12, (("A", 20),))
    seg = cut(df, KEYS, days=3, carry={"x": ("decay", F.col("close") * 0.25, 0.75)})
    out = seg.add_decayed(seg.restart(seg.df), "x", "x", F.lit(10.0))
    x, day = 10.0, None
    for r in seg.finish(out).orderBy("date").collect():
        x, day = (10.0 if r.day != day else x) * 0.75 + r.close * 0.25, r.day
        assert r.x == pytest.approx(x, rel=1e-12)


def test_lookback_must_fit(spark):
    df = series(spark, 8, (("A", 3),))
    with pytest.raises(ValueError):
        cut(df, KEYS, lookback=5).rolling(20)


def test_rsi_equals_a_loop(spark):
    df = series(spark, 9, (("A", 60), ("B", 20), ("C", 2))).where("close > 0")
    by_name = {}
    for r in df.orderBy("date").collect():
        by_name.setdefault(r.name, []).append(r.close)
    for r in M.rsi(df, KEYS, days=5).collect():
        x = by_name[r["name"]]
        if len(x) < 15:
            assert r.rsi is None
            continue
        gains = [max(b - a, 0) / a * 100 for a, b in zip(x, x[1:])]
        losses = [max(a - b, 0) / b * 100 for a, b in zip(x, x[1:])]
        g, l = sum(gains[:14]) / 14, sum(losses[:14]) / 14
        for up, down in zip(gains[14:], losses[14:]):
            g, l = (13 * g + up) / 14, (13 * l + down) / 14
        assert r.rsi == pytest.approx(100 - 100 / (1 + g / l), abs=0.006)
        assert (r.last_close, r.previous_close, r.bars) == (x[-1], x[-2], len(x))


def _jobs(spark):
    return spark.sparkContext.statusTracker().getJobIdsForGroup("plans")


@pytest.mark.parametrize("build", [
    lambda bars: ind.running_stats(bars, SERIES, legs=False, days=2),
    lambda bars: M.mmi(bars.withColumn("base_avg", F.col("close")), SERIES, days=2),
])
def test_building_a_plan_starts_no_job(spark, tmp_path, build):
    days = [(f"2024-01-{d:02d}", "N", k, 100.0 + d * k, 5) for d in range(1, 11) for k in (1, 2)]
    path = str(tmp_path / "bars")
    (spark.createDataFrame(days, "d string, name string, k int, close double, oi long")
     .selectExpr("name", "date'2024-02-01' as expiry", "cast(k as decimal(18,4)) as strike", "cast(d as date) as day",
                 "cast(d as timestamp_ntz) as date", "close", "oi").write.parquet(path))
    bars = spark.read.parquet(path)
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        out = build(bars)
        assert list(_jobs(spark)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    one = out.where("strike = 1").select("date", "strike")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        scans = [x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    # Spark infers filters over joins once, so the totals within the second level of totals stay unfiltered.
    assert scans and sum(bool(re.search(r"PushedFilters: \[.*EqualTo\(strike", x)) for x in scans) >= max(1, len(scans) - 1)
    assert one.count() == 10


def evaluations(df):
    """How often the files are read in the plan that was run, after Spark's reuse of exchanges."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.mark.parametrize("name,most", [
    ("straddle_bars", 1), ("running_stats", 1), ("straddle_signals", 1), ("roc_expanding", 1), ("stop_loss", 1), ("extra_indicators", 1),
    ("calendar_signals", 3), ("mmi", 3), ("mmi_multi", 6)])
def test_the_bars_are_evaluated_once(spark, name, most):
    """Spreads read the bars and, twice, the contracts; the momentum of calls over puts reads each side and the chart."""
    assert evaluations(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) <= most


def test_shared_and_separate_evaluation_agree(spark):
    df = series(spark, 11).repartition(4, "name", "day")
    for days in (3, 1000):
        same(ind.running_stats(df, KEYS, days=days, shared=True), ind.running_stats(df, KEYS, days=days, shared=False),
             ["MAX_incremental_close_avg", "running_min_ce", "trailing_sl"])
    for frame in (S.WHOLE, S.LATEST, S.DAY):
        same(S.straddle_signals(df, KEYS, frame, days=20, shared=True), S.straddle_signals(df, KEYS, frame, days=20, shared=False),
             ["rownum", "day_num", "StopLoss", "EntryAllowed", "ROC_AVG_CEPE_AVG"])


def test_changes_that_cancel_out_are_not_rounded_away(spark):
    closes = [50000.0] * 18 + [50000.05, 49999.95, 50000.0]
    df = spark.createDataFrame([(i, "2024-01-01", c) for i, c in enumerate(closes)], "i int, d string, close double").selectExpr(
        "'N' as name", "cast(d as date) as day", "timestampadd(MINUTE, i, cast(d as timestamp_ntz)) as date", "close")
    got = ind.roc_average(df, ["close"], ["name"]).orderBy("date").collect()[-1]["ROC_AVG_close"]
    want = sum((closes[-1] - e) / e for e in reversed(closes[:-1])) / 2
    assert got == want != 0.0
    flat = df.withColumn("close", F.lit(50000.0))
    assert ind.roc_average(flat, ["close"], ["name"]).orderBy("date").collect()[-1]["ROC_AVG_close"] == 0.0


def test_checked_queries_cut_series_into_several_segments(spark):
    for days in (catalog.FEW, catalog.MORE):
        seg = cut(catalog._straddles(spark, "/root/testdata/sf0.01"), SERIES, days=days, lookback=20 if days == catalog.MORE else 0)
        assert seg.df.select("_segment").distinct().count() > 1


def test_a_long_look_back_widens_the_segments(spark):
    df = spark.range(400).selectExpr("'N' as name", "date_add(date'2024-01-01', cast(id as int)) as day",
                                     "cast(date_add(date'2024-01-01', cast(id as int)) as timestamp_ntz) as date", "100D + id as close")
    out = ind.roc_average(df, ["close"], ["name"], length=200).where("ROC_AVG_close IS NOT NULL")
    assert out.count() == 200
