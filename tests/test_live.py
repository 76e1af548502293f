"""Jobs that keep state between batches: any order of batches gives the result of all bars at once."""

import datetime as dt
import decimal
import random
import re

import pytest
from pyspark.sql import functions as F

from strikelake.operators import momentum as M
from strikelake.operators import signals as S
from strikelake.plans import catalog, pipelines
from strikelake.schemas import CANDLES, LEG, SERIES
from strikelake.session import fresh_dir
from strikelake.sources import fixtures as fx
from strikelake.sources import tables
from strikelake.streaming import jobs

SF_DIR = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def bars(spark):
    return fx.bars(spark, SF_DIR).select(*[f.name for f in CANDLES]).cache()


def days_of(bars, *days):
    return bars.where(F.col("day").isin([F.lit(f"2024-01-{d:02d}").cast("date") for d in days]))


def scans(df, path, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return [x for x in plan.split("\n") if "PartitionFilters" in x and f"{path}]" in x]


# --- RSI -----------------------------------------------------------------------------------------

READING = [*LEG, "bars", "rsi", "last_close", "previous_close"]


def test_rsi_advances_with_batches_in_any_order(spark, bars):
    """Days in order, a day again with other closes, a day from the middle late, and one contract that begins late."""
    out = fresh_dir(spark, "t")
    late = F.col("instrument_token") == 103
    first, then = bars.where((F.dayofmonth("day") <= 20) & (F.dayofmonth("day") != 11) & ~late), bars.where((F.dayofmonth("day") > 20) & ~late)
    revised = days_of(bars, 25).where(~late).withColumn("close", F.col("close") + 2)
    batches = [first, then, revised, days_of(bars, 11).where(~late), bars.where(late & (F.dayofmonth("day") > 9)), bars.where(late & (F.dayofmonth("day") <= 9)),
               bars.limit(0)]
    for n, batch in enumerate(batches):
        jobs.refresh_rsi(spark, batch, f"{out}/candles", f"{out}/rsi", f"{out[-8:]}/{n}")
    candles = tables.read_candles(spark, f"{out}/candles", refresh=True)
    assert candles.count() == bars.count()
    got = catalog.steady(spark.read.parquet(f"{out}/rsi").select(*READING))
    assert rows(got) == rows(catalog.steady(M.rsi(candles, LEG)))


def test_a_live_batch_reads_no_day_before_it(spark, bars):
    out = fresh_dir(spark, "t")
    jobs.refresh_rsi(spark, bars.where("dayofmonth(day) < 28"), f"{out}/candles", f"{out}/rsi", f"{out[-8:]}/1")
    batch = days_of(bars, 28)
    jobs.upsert(batch, f"{out}/candles", f"{out[-8:]}/2/candles")
    states = jobs.advanced_states(spark, batch, f"{out}/candles", f"{out}/rsi", jobs._bounds(batch, ["expiry", "day"]))
    for path in (f"{out}/candles", f"{out}/rsi_states"):
        found = scans(states, path, spark)
        assert found and all(re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-28", x) for x in found), path
    want = M.rsi(bars.where("dayofmonth(day) <= 28"), LEG)
    assert rows(catalog.steady(M.rsi_readings(states, LEG).select(*READING))) == rows(catalog.steady(want))


def test_states_equal_a_loop(spark):
    """Few bars, flat prices, a missing close, and states taken up in the warm-up and after it."""
    rng = random.Random(6)
    data = []
    for name, days in (("A", 30), ("B", 3), ("C", 8)):
        for d in range(days):
            for k in range(rng.randint(1, 4)):
                close = rng.choice([50.0, round(rng.uniform(40, 60), 2)])
                data.append((name, dt.date(2024, 1, 1) + dt.timedelta(d), dt.datetime(2024, 1, 1, 9 + k) + dt.timedelta(d), close))
    shape = "name string, day date, date timestamp_ntz, close double"
    df = spark.createDataFrame(data, shape)
    nothing = spark.createDataFrame([], "name string, bars long, avg_gain double, avg_loss double, last_close double, previous_close double")
    whole = {(r.name, r.day): r for r in M.rsi_states(df, nothing, ["name"]).collect()}
    for name in "ABC":
        closes, state, gain, loss = [], 0, 0.0, 0.0
        for day in sorted({d for n, d, _, _ in data if n == name}):
            for n, d, _, close in data:
                if (n, d) == (name, day):
                    if closes:
                        before, state = closes[-1], state + 1
                        up, down = (max(close - before, 0) / before * 100, max(before - close, 0) / close * 100)
                        gain, loss = ((gain + up / 14, loss + down / 14) if state <= 14 else ((13 * gain + up) / 14, (13 * loss + down) / 14))
                    closes.append(close)
            got = whole[name, day]
            assert (got.bars, got.last_close) == (len(closes), closes[-1])
            assert got.avg_gain == pytest.approx(gain, rel=1e-12) and got.avg_loss == pytest.approx(loss, rel=1e-12)
            assert got.previous_close == (closes[-2] if len(closes) > 1 else None)
    for day in (2, 4, 9):
        cut = dt.date(2024, 1, day)
        prior = spark.createDataFrame([(r.name, *[r[c] for c in M.RSI_STATE]) for (_, d), r in whole.items()
                                       if d == max(x for n, x in whole if n == r.name and x < cut)], nothing.schema)
        for r in M.rsi_states(df.where(F.col("day") >= F.lit(cut)), prior, ["name"]).collect():
            want = whole[r.name, r.day]
            assert [r[c] for c in ("bars", "last_close", "previous_close")] == [want[c] for c in ("bars", "last_close", "previous_close")]
            assert r.avg_gain == pytest.approx(want.avg_gain, rel=1e-12)
            assert r.start.bars == want.start.bars


# --- late ticks ----------------------------------------------------------------------------------

def landed(spark, parts, out, job, width="6 hours", delay="12 hours"):
    for part in parts:
        part.write.mode("append").parquet(f"{out}/landing")
        ticks = spark.readStream.schema(part.schema).parquet(f"{out}/landing")
        jobs.refresh_bars(ticks, f"{out}/ticks", f"{out}/candles", job, width, delay)
    return tables.read_candles(spark, f"{out}/candles", refresh=True)


def test_late_ticks_are_kept_apart_and_mended(spark):
    out, ticks = fresh_dir(spark, "t"), fx.ticks(spark, SF_DIR).cache()
    parts = catalog.late_deliveries(ticks)
    got = landed(spark, parts[:2], out, "a")
    assert not spark.read.schema(jobs._routed(ticks.schema)).parquet(jobs.late_path(f"{out}/ticks")).count()
    before = {(r.instrument_token, r.date): r for r in got.collect()}
    after = {(r.instrument_token, r.date): r for r in landed(spark, parts[2:], out, "a").collect()}
    late = spark.read.parquet(jobs.late_path(f"{out}/ticks"))
    assert rows(late.select(*ticks.columns)) == rows(parts[2])
    touched = {(r.instrument_token, r.date) for r in parts[2].select("instrument_token", F.window("ts", "6 hours").start.alias("date")).distinct().collect()}
    assert {k for k in after if after[k] != before.get(k)} == touched
    assert sum(r.volume for r in after.values()) - sum(r.volume for r in before.values()) == parts[2].count()


def test_a_tick_is_late_once_its_bar_has_ended_behind_the_watermark(spark):
    shape = fx.ticks(spark, SF_DIR).schema
    fixed = {"name": "N", "strike": decimal.Decimal(1), "instrument_type": "CE", "expiry": dt.date(2024, 2, 1), "instrument_token": 7, "k": 1}

    def tick(n, at):
        return fixed | {"ts": dt.datetime.fromisoformat(at), "event_id": n, "price": float(n)}

    def batch(*ticks):
        return spark.createDataFrame([tuple(t[c] for c in shape.names) for t in ticks], shape)

    out = fresh_dir(spark, "t")

    def sides():
        return [sorted(r.event_id for r in spark.read.schema(jobs._routed(shape)).parquet(p(out)).collect()) for p in (jobs.on_time_path, jobs.late_path)]

    one = batch(tick(1, "2024-01-01 10:00:00"), tick(2, "2024-01-01 00:30:00"))
    two = batch(tick(3, "2024-01-01 08:59:59"), tick(4, "2024-01-01 07:59:59"), tick(5, "2024-01-01 12:00:00"))
    for n, b in ((0, one), (1, two), (1, two), (1, two)):
        jobs.split_late(b, out, "job", n, "1 hour", "1 hour")
    # The watermark of the second batch is 09:00: the bar of 08:00 has ended by then, and a repeat changes nothing.
    assert sides() == [[1, 2, 5], [3, 4]]
    jobs.split_late(batch(tick(6, "2024-01-01 11:00:00"), tick(7, "2024-01-01 10:30:00")), out, "job", 2, "1 hour", "1 hour")
    assert sides() == [[1, 2, 5, 6], [3, 4, 7]]
    jobs.split_late(batch(), out, "job", 3, "1 hour", "1 hour")
    assert sides() == [[1, 2, 5, 6], [3, 4, 7]]


def test_a_backfill_reads_only_the_days_of_late_ticks(spark):
    out, ticks = fresh_dir(spark, "t"), fx.ticks(spark, SF_DIR)
    for n, part in enumerate(catalog.late_deliveries(ticks)):
        jobs.split_late(part, out, "job", n, "6 hours", "12 hours")
    fresh = spark.read.schema(jobs._routed(ticks.schema)).parquet(jobs.late_path(out)).where("day = '2024-01-05'")
    rebuilt = jobs.late_bars(spark, out, ticks.schema, "6 hours", fresh)
    found = scans(rebuilt, jobs.on_time_path(out), spark)
    assert found and all(re.search(r"day#\d+ >= 2024-01-05.*day#\d+ <= 2024-01-05", x) for x in found)
    want = fx.bars(spark, SF_DIR).where("day = '2024-01-05'").join(rebuilt, ["instrument_token", "date"], "left_semi")
    assert rebuilt.count() > 0 and rows(rebuilt) == rows(want.select(*rebuilt.columns))


# --- the end of a session ------------------------------------------------------------------------

@pytest.fixture
def rate(spark):
    """A landing folder, and the stream that takes it into another."""
    out = fresh_dir(spark, "t")

    def land(n):
        spark.range(n, n + 10).coalesce(1).write.mode("append").parquet(f"{out}/landing")

    def writer():
        return jobs.append_to(spark.readStream.schema("id long").parquet(f"{out}/landing"), f"{out}/data")

    def taken():
        return sorted(r.id for r in spark.read.schema("id long").parquet(f"{out}/data").collect())

    land(0)
    return land, writer, taken, f"{out}/checkpoint"


def test_past_the_cutoff_a_stream_runs_once(rate):
    land, writer, taken, checkpoint = rate
    cutoff = jobs.session_end(dt.date(2024, 1, 2), 15, 30)
    jobs.run(writer(), checkpoint, "1 hour", until=cutoff, clock=lambda: cutoff)
    assert taken() == list(range(10))
    land(10)
    jobs.run(writer(), checkpoint, "1 hour", until=cutoff, clock=lambda: cutoff + dt.timedelta(hours=2))
    assert taken() == list(range(20))


def test_a_session_ends_by_itself_when_all_landed_is_taken_in(rate, monkeypatch):
    """The interval is far longer than the session, so what lands after its first batch is left to the last run."""
    land, writer, taken, checkpoint = rate
    monkeypatch.setattr(jobs, "POLL_SECONDS", 0.5)
    start, seen = dt.datetime.now(), []
    until = start + dt.timedelta(seconds=12)

    def clock():
        if not seen and dt.datetime.now() > start + dt.timedelta(seconds=9):
            seen.append(land(10))
        return dt.datetime.now()

    jobs.run(writer(), checkpoint, "1 hour", until=until, clock=clock)
    assert dt.datetime.now() >= until and seen and taken() == list(range(20))


def test_an_error_ends_the_session(spark, rate):
    land, writer, taken, checkpoint = rate

    def fail(batch, n):
        raise ValueError("no room")

    stream = writer().foreachBatch(fail)
    with pytest.raises(Exception, match="no room"):
        jobs.run(stream, checkpoint + "-2", "1 second", until=dt.datetime.now() + dt.timedelta(minutes=10))


# --- signals of longer frames --------------------------------------------------------------------

SHOWN = catalog.SERIES_SIGNALS


def test_series_signals_in_any_order_equal_the_batch(spark, bars):
    """The later half first, then the earlier one, a day of the middle revised, and the last day once more."""
    out = fresh_dir(spark, "t")
    revised = days_of(bars, 12).withColumn("close", F.col("close") + 3)
    batches = [bars.where("dayofmonth(day) >= 15"), bars.where("dayofmonth(day) < 15"), revised, days_of(bars, 30), bars.limit(0)]
    for n, batch in enumerate(batches):
        jobs.refresh_series_signals(spark, batch, f"{out}/candles", f"{out}/signals", f"{out[-8:]}/{n}")
    want = pipelines.straddle_signals(tables.read_candles(spark, f"{out}/candles", refresh=True), num_days=None, frame=S.WHOLE)
    got = spark.read.parquet(f"{out}/signals")
    assert rows(catalog.steady(got.select(*SHOWN))) == rows(catalog.steady(want.select(*SHOWN)))


def test_totals_before_a_batch_are_found_without_older_days(spark, bars):
    out = fresh_dir(spark, "t")
    jobs.refresh_series_signals(spark, bars.where("dayofmonth(day) < 28"), f"{out}/candles", f"{out}/signals", f"{out[-8:]}/1")
    batch, totals = days_of(bars, 28), jobs.totals_path(f"{out}/signals")
    where = jobs._bounds(batch, ["expiry", "day"])
    prior = jobs.states_before(spark, batch, totals, jobs.latest_path(totals), jobs._state_shape(SERIES, batch.schema, jobs._TOTALS), where, SERIES)
    found = scans(prior, totals, spark)
    assert found and all(re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-28", x) for x in found)
    last = pipelines.straddle_signals(bars.where("dayofmonth(day) < 28"), num_days=None, frame=S.WHOLE)
    want = {(r.expiry, r.strike): r for r in last.where("IS_LATEST_DAY").groupBy(*SERIES).agg(
        F.max_by(F.struct("rownum", "cumulative_sum_close", "MAX_incremental_close_avg"), "date").alias("r")).select(*SERIES, "r.*").collect()}
    got = {(r.expiry, r.strike): r for r in prior.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.rows == want[k].rownum and r.close_sum == pytest.approx(want[k].cumulative_sum_close)
        assert r.MAX_incremental_close_avg == pytest.approx(want[k].MAX_incremental_close_avg)
    # With the day merged, the signals need the look-back only.
    jobs.upsert(batch, f"{out}/candles", f"{out[-8:]}/2/candles")
    history = jobs.touched_history(spark, batch, f"{out}/candles", f"{out[-8:]}/2", 20, to_end=True)
    assert history.agg(F.min("day")).first()[0] >= dt.date(2024, 1, 21)


def test_a_frame_of_days_moves_on(spark, bars):
    out = fresh_dir(spark, "t")
    batches = [bars.where("dayofmonth(day) <= 20"), days_of(bars, 21).where("strike < 54400"), days_of(bars, 18).withColumn("close", F.col("close") + 1)]
    for n, batch in enumerate(batches):
        jobs.refresh_frame_signals(spark, batch, f"{out}/candles", f"{out}/signals", f"{out[-8:]}/{n}", 5)
        want = pipelines.straddle_signals(tables.read_candles(spark, f"{out}/candles", refresh=True), num_days=5, frame=S.WHOLE)
        assert rows(catalog.steady(spark.read.parquet(f"{out}/signals").select(*SHOWN))) == rows(catalog.steady(want.select(*SHOWN)))
