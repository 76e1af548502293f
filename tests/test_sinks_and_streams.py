import datetime as dt
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strikelake.operators import bars as B
from strikelake.operators import signals as S
from strikelake.plans import catalog, pipelines
from strikelake.session import fresh_dir, shared_dir
from strikelake.sources import fixtures as fx
from strikelake.sources import sinks, tables
from strikelake.schemas import CANDLES, INSTRUMENTS, SERIES
from strikelake.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def candles(spark):
    return fx.bars(spark, SMALL, "1 day").select(*[f.name for f in CANDLES])


def test_upsert_twice_is_upsert_once(spark):
    path = fresh_dir(spark, "t")
    new = candles(spark)
    sinks.upsert(new, path, path[-8:] + "/1")
    once = rows(tables.read_candles(spark, path))
    sinks.upsert(new, path, path[-8:] + "/1")
    assert rows(tables.read_candles(spark, path)) == once
    sinks.upsert(new, path, path[-8:] + "/2")
    assert rows(tables.read_candles(spark, path)) == once == rows(new)


def test_upsert_keeps_rows_of_a_day_it_touches(spark):
    """A pull that starts in the middle of a day must not lose the morning."""
    path = fresh_dir(spark, "t")
    bars = fx.bars(spark, SMALL, "6 hours").select(*[f.name for f in CANDLES])
    sinks.upsert(bars, path, path[-8:] + "/1")
    late = bars.where(F.hour("date") >= 12).withColumn("close", F.lit(1.0))
    sinks.upsert(late, path, path[-8:] + "/2")
    want = bars.withColumn("close", F.when(F.hour("date") >= 12, 1.0).otherwise(F.col("close")))
    assert rows(tables.read_candles(spark, path)) == rows(want)


def test_a_crashed_batch_is_finished(spark):
    """A batch that stopped half way left part of its rows and no record; it runs again."""
    path = fresh_dir(spark, "t")
    new = candles(spark)
    (new.limit(3).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("expiry", "day").parquet(path))
    sinks.upsert(new, path, path[-8:] + "/1")
    assert rows(tables.read_candles(spark, path)) == rows(new)


def test_replaying_an_old_batch_undoes_nothing(spark):
    path = fresh_dir(spark, "t")
    new = candles(spark)
    revised = new.withColumn("close", F.col("close") + 1)
    for batch, n in ((new, 1), (revised, 2), (new, 1)):
        sinks.upsert(batch, path, f"job/{n}")
    assert rows(tables.read_candles(spark, path)) == rows(revised)


def test_other_rows_under_a_used_id_are_taken_in(spark):
    path = fresh_dir(spark, "t")
    new = candles(spark)
    early = F.col("day") < F.lit("2024-01-15")
    sinks.upsert(new.where(early), path, "job/1")
    sinks.upsert(new.where(~early), path, "job/1")
    assert rows(tables.read_candles(spark, path)) == rows(new)


def test_the_newest_version_wins_whenever_it_lands(spark):
    path = fresh_dir(spark, "t")
    new = candles(spark)
    pulls = {n: new.withColumn("close", F.col("close") + n).withColumn("pull", F.lit(n)) for n in (1, 2, 3)}
    for k, n in enumerate((2, 1, 3, 2)):
        sinks.upsert(pulls[n], path, f"job/{k}", version="pull")
    assert rows(tables.read_candles(spark, path)) == rows(pulls[3].drop("pull"))


def test_equal_rows_of_a_batch_are_chosen_alike(spark):
    new = candles(spark)
    double = new.unionByName(new.withColumn("close", F.col("close") + 1))
    for order in (double, double.orderBy(F.rand(1))):
        path = fresh_dir(spark, "t")
        sinks.upsert(order, path, "job/1")
        assert rows(tables.read_candles(spark, path)) == rows(new.withColumn("close", F.col("close") + 1))


def test_landed_text_is_cast_and_bad_values_become_null(spark):
    path = fresh_dir(spark, "t")
    text = [f"{f.name}" for f in INSTRUMENTS]
    good = ["1", "1", "S", "N", "1.5", "2024-02-01", "100.0", "0.05", "15", "CE", "NFO-OPT", "NFO"]
    bad = ["2", "1", "S", "N", "oops", "2024-02-01", "100.0", "0.05", "x", "CE", "NFO-OPT", "NFO"]
    for fmt in ("json", "csv"):
        spark.createDataFrame([good, bad], text).write.option("header", True).format(fmt).save(f"{path}/{fmt}")
        got = {r.instrument_token: (r.last_price, r.lot_size, r.expiry)
               for r in tables.load_instruments(spark, f"{path}/{fmt}", fmt).collect()}
        assert got == {1: (1.5, 15, dt.date(2024, 2, 1)), 2: (None, None, dt.date(2024, 2, 1))}


def test_snapshot_reads_prune(spark):
    path = fresh_dir(spark, "t")
    pipelines.refresh_instruments(fx.instruments(spark, SMALL), path, path + "-expiries")
    df = tables.read_instruments(spark, path, segment="NFO-FUT")
    assert {r.segment for r in df.collect()} == {"NFO-FUT"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*segment.*NFO-FUT", plan)
    names = tables.read_instruments(spark, path).select("name").distinct().count()
    assert spark.read.parquet(path + "-expiries").count() == names


def test_any_split_of_the_stream_gives_the_batch_bars(spark):
    ticks = fx.ticks(spark, SMALL)
    at = [r[0] for r in ticks.selectExpr("percentile(cast(unix_micros(cast(ts as timestamp)) as double), array(0.3, 0.6))").collect()][0]
    out = fresh_dir(spark, "t")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = [ticks.where(micros <= at[0]), ticks.where((micros > at[0]) & (micros <= at[1])), ticks.where(micros > at[1])]
    for part in parts:
        part.write.mode("append").parquet(f"{out}/landing")
        stream = spark.readStream.schema(ticks.schema).parquet(f"{out}/landing")
        jobs.run(jobs.append_to(jobs.stream_bars(stream, "1 day", "1 hour"), f"{out}/data"), f"{out}/checkpoint")
    batch = B.ohlc_bars(ticks, "1 day")
    closed = ticks.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    want = batch.where(F.col("date") + F.make_dt_interval(days=F.lit(1)) <= F.lit(closed))
    got = spark.read.schema(batch.schema).parquet(f"{out}/data")
    assert want.count() > 0
    assert rows(got) == rows(want)


def test_wall_clock_windows_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        df = spark.sql("select timestamp_ntz'2024-01-01 07:30:00' as ts")
        w = df.select(jobs.as_wall_clock(F.window(jobs.as_instant("ts"), "6 hours").start).alias("t")).first().t
        assert w == dt.datetime(2024, 1, 1, 6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_signals_refreshed_out_of_order_equal_the_batch(spark):
    """The later half arrives first; the bars before it then change its rate of change."""
    bars = fx.bars(spark, "/root/testdata/sf0.01").select(*[f.name for f in CANDLES]).cache()
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    out = fresh_dir(spark, "t")
    for n, part in enumerate((bars.where(F.col("date") >= cut), bars.where(F.col("date") < cut))):
        jobs.refresh_signals(spark, part, f"{out}/candles", f"{out}/signals", f"{out[-8:]}/{n}")
    columns = [*SERIES, "date", "rownum", "ROC_AVG_close", "StopLoss", "EntryAllowed"]
    got = catalog.steady(spark.read.parquet(f"{out}/signals").select(*columns))
    want = catalog.steady(S.straddle_signals(B.straddle_bars(bars), frame=S.DAY).select(*columns))
    assert rows(got) == rows(want)


class FakeSession:
    """The few parts of a session that decide on the shared folder."""

    def __init__(self, conf, master, checkpoint=None):
        self.conf = self.sparkContext = self
        self.settings, self.master, self.checkpoint = conf, master, checkpoint

    def get(self, key, default):
        return self.settings.get(key, default)

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


def test_the_shared_folder_is_the_one_the_session_names():
    named = {"spark.checkpoint.dir": "hdfs://shared/run/"}
    assert fresh_dir(FakeSession(named, "yarn"), "x").startswith("hdfs://shared/run/x-")
    assert shared_dir(FakeSession({}, "yarn", "hdfs://other")) == "hdfs://other"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession({}, "yarn"))
    local = FakeSession({}, "local[2]")
    assert shared_dir(local) == shared_dir(local) == local.checkpoint


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", [
    "straddle_signals_latest", "stop_loss", "roc_avg", "bollinger", "extra_indicators", "calendar_bars",
    "mtf_asof", "rsi", "chain_slice", "gap_fill", "heikin_ashi", "positions_pnl"])
def test_no_single_partition_and_no_python(spark, name):
    plan = final_plan(catalog.QUERIES[name](spark, SMALL))
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = B.traded(tables.read_candles(spark, _table(spark))).where(F.col("day") == dt.date(2024, 1, 5)).select(
        "date", "close")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThan\(volume,0\)", plan)
    assert re.search(r"PartitionFilters: \[.*day#\d+ = 2024-01-05", plan)
    assert re.search(r"ReadSchema: struct<date:timestamp_ntz,close:double,volume:bigint>", plan)


def _table(spark):
    path = fresh_dir(spark, "t")
    sinks.upsert(candles(spark), path, path[-8:] + "/1")
    return path


def test_refresh_reads_only_the_days_it_needs(spark):
    """A batch of one day in the middle: the days before it that hold the look-back, itself, and those after it."""
    out = fresh_dir(spark, "t")
    bars = fx.bars(spark, "/root/testdata/sf0.01", "6 hours").select(*[f.name for f in CANDLES])
    jobs.refresh_signals(spark, bars, f"{out}/candles", f"{out}/signals", "job/1")
    day = bars.where(F.col("day") == F.lit("2024-01-16").cast("date")).withColumn("close", F.col("close") + 3)
    sinks.upsert(day, f"{out}/candles", "job/2/candles")
    history = jobs.touched_history(spark, day, f"{out}/candles", "job/2", 20)
    span = history.agg(F.min("day"), F.max("day"), F.min("from_day"), F.max("to_day")).first()
    assert span[0] >= dt.date(2024, 1, 9) and span[1] <= dt.date(2024, 1, 23)
    assert span[2] == dt.date(2024, 1, 16) and span[1] == span[3]
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = history._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    candle_scan = next(x for x in plan.split("\n") if "PartitionFilters" in x and "/candles]" in x)
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01", candle_scan), candle_scan
    # The result is that of all bars at once.
    jobs.refresh_signals(spark, day, f"{out}/candles", f"{out}/signals", "job/2")
    changed = bars.where(F.col("day") != F.lit("2024-01-16").cast("date")).unionByName(day)
    want = pipelines.straddle_signals(changed, num_days=None, frame=S.DAY).drop("day_num", "IS_LATEST_DAY")
    assert rows(spark.read.parquet(f"{out}/signals").select(*want.columns)) == rows(want)


def test_the_record_of_batches_stays_in_few_files(spark, monkeypatch):
    monkeypatch.setattr(sinks, "COMMIT_SLOTS", 2)
    path, day = fresh_dir(spark, "t"), candles(spark).where(F.col("day") == F.lit("2024-01-05"))
    for n in range(6):
        sinks.upsert(day.withColumn("close", F.col("close") + n), path, f"job/{n}")
    files = spark.read.parquet(sinks.commits_path(path)).inputFiles()
    assert len(files) == 2 and spark.read.parquet(sinks.commits_path(path)).count() == 6
    before = rows(tables.read_candles(spark, path, refresh=True))
    sinks.upsert(day, path, "job/0")
    assert rows(tables.read_candles(spark, path, refresh=True)) == before == rows(day.withColumn("close", F.col("close") + 5))


def test_equal_versions_are_chosen_alike(spark):
    new = candles(spark).withColumn("pull", F.lit(1))
    double = new.unionByName(new.withColumn("close", F.col("close") + 1))
    for order in (double, double.orderBy(F.rand(3))):
        got = B.clean_bars(order, version="pull").select(*new.columns)
        assert rows(got) == rows(new.withColumn("close", F.col("close") + 1))


@pytest.mark.parametrize("n", [1, 7, 2000])
def test_first_bars_by_counts_of_days(spark, n):
    bars = B.straddle_bars(fx.bars(spark, "/root/testdata/sf0.01"), numbered=False).select(*SERIES, "day", "date", "close")
    nth = F.row_number().over(Window.partitionBy(*SERIES).orderBy("date"))
    want = bars.withColumn("n", nth).where(F.col("n") <= n).drop("n")
    days = bars.groupBy(*SERIES, "day").agg(F.count(F.lit(1)).alias("bars"))
    for calendar in (None, days):
        first = B.first_bars(bars, n, calendar=calendar)
        assert rows(first) == rows(want)
    # Bars are ranked within a day only; a series meets in one task as days.
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    ranked = [x for x in plan.split("\n") if "Window [row_number" in x]
    assert ranked and all(re.search(r"\], \[name#\d+, expiry#\d+, strike#\d+, day#\d+\], \[date", x) for x in ranked)


def test_last_days_of_a_calendar_read_only_those(spark):
    path = _table(spark)
    bars = tables.read_candles(spark, path)
    days = bars.select(*SERIES, "day").distinct()
    calendar = spark.createDataFrame(days.collect(), days.schema)
    got = pipelines.straddle_signals(bars, num_days=2, calendar=calendar)
    assert rows(got) == rows(pipelines.straddle_signals(bars, num_days=2))


def test_rejected_rows_are_kept_with_their_reasons(spark):
    path = fresh_dir(spark, "t")
    good = '{"instrument_token":"1","name":"N","expiry":"2024-02-01","strike":"100","instrument_type":"CE","date":"2024-01-05 10:00:00","close":"1.5","volume":"3","day":"2024-01-05"}'
    lines = [good, good.replace('"1.5"', '"oops"'), good.replace("2024-01-05 10", "2024-13-05 10"), "{broken", good.replace('"3"', '"many"').replace('"1.5"', "null")]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/landing")
    for _ in range(2):  # taken in again, nothing is doubled
        seen = pipelines.take_in(spark, f"{path}/landing", f"{path}/candles", f"{path}/rejects", "job/1")
        assert seen == {"rows": 5, "rejected": 4}
        reasons = sorted(",".join(r.reasons) for r in spark.read.parquet(f"{path}/rejects").collect())
        assert reasons == ["close", "close,volume", "date", "record"]
        taken = tables.read_candles(spark, f"{path}/candles", refresh=True).collect()
        assert [(r.instrument_token, r.close, r.volume, r.day) for r in taken] == [(1, 1.5, 3, dt.date(2024, 1, 5))]
    broken = spark.read.parquet(f"{path}/rejects").where("_corrupt IS NOT NULL").first()
    assert broken._corrupt == "{broken" and broken.batch == "job/1"


def test_a_bucketed_table_is_not_shuffled_by_series_and_day(spark):
    name, bars = "bucketed_candles", candles(spark)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        sinks.write_bucketed(bars, name, 4)
        out = B.straddle_bars(spark.table(name), numbered=False, dealt=True)
        plan = final_plan(out)
        assert "Exchange" not in plan and re.search(r"SelectedBucketsCount: 4 out of 4", plan)
        assert rows(out) == rows(B.straddle_bars(bars, numbered=False))
        days = final_plan(B.straddle_bars(spark.table(name), dealt=True))
        assert len(re.findall(r"Exchange hashpartitioning\(name#\d+, expiry#\d+, strike#\d+, \d+\)", days)) <= 1 and "day#" not in "".join(
            re.findall(r"Exchange hashpartitioning\([^)]*\)", days))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
