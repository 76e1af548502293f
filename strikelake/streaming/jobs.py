"""Bars, de-duplication, upsert and signals on Structured Streaming.

A job is a DataFrame transformation plus a sink. ``run`` starts it with the trigger asked for: an
interval for a live session, which may end at a given time, or ``availableNow`` to take in all that has landed and stop.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from strikelake.operators import bars as B
from strikelake.operators import indicators as ind
from strikelake.operators import momentum as M
from strikelake.operators import signals as S
from strikelake.schemas import LEG, SERIES
from strikelake.sources.sinks import read_table, replace_series, upsert
from strikelake.sources.tables import read_candles


# How often a stream that is to stop at a given time is looked at.
POLL_SECONDS = 5.0


def as_instant(ts: Column | str) -> Column:
    """A wall-clock time as the same reading in UTC: watermarks need an instant, and windows aligned
    in UTC fall where those of the wall-clock time do."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts) if isinstance(ts, str) else ts)
    return local.cast("timestamp")


def as_wall_clock(ts: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def session_end(day: dt.date, end_hour: int, end_minute: int) -> dt.datetime:
    """The cutoff of a trading day as wall-clock time."""
    return dt.datetime.combine(day, dt.time(end_hour, end_minute))


def run(
    writer: DataStreamWriter, checkpoint: str, interval: str | None = None, until: dt.datetime | None = None,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
) -> None:
    """Start and wait. Without an interval the stream stops when everything landed is processed.

    With an interval and ``until`` it goes on to that time, lets the batch in work end, and then takes in what has
    landed since once, which ends by itself. Past ``until`` already, only that last run is made. An error of the stream is
    raised, whichever run meets it.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    if interval and (until is None or clock() < until):
        query = writer.trigger(processingTime=interval).start()
        if until is None:
            query.awaitTermination()
            return
        while (left := (until - clock()).total_seconds()) > 0:
            if query.awaitTermination(min(left, POLL_SECONDS)):
                return
        while query.isActive and query.status["isTriggerActive"]:
            if query.awaitTermination(POLL_SECONDS / 10):
                return
        query.stop()
        query.awaitTermination()
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_bars(ticks: DataFrame, width: str, delay: str, keys: Sequence[str] = LEG) -> DataFrame:
    """Tumbling OHLC bars. A bar is emitted once, when the watermark has passed its end; for ticks later
    than ``delay`` see ``route_late``."""
    at = F.struct("event_time", "event_id")
    return (
        ticks.withColumn("event_time", as_instant("ts")).withWatermark("event_time", delay)
        .groupBy(*keys, F.window("event_time", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).alias("volume"), F.sum("k").alias("oi"),
        )
        .withColumn("date", as_wall_clock(F.col("w.start"))).drop("w")
        .withColumn("day", F.to_date("date"))
    )


def stream_dedup(candles: DataFrame, delay: str) -> DataFrame:
    """Drop bars delivered again by overlapping pulls. State is kept for ``delay`` only."""
    return (candles.withColumn("event_time", as_instant("date"))
            .withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["instrument_token", "expiry", "date"])
            .drop("event_time"))


def append_to(df: DataFrame, path: str) -> DataStreamWriter:
    return df.writeStream.format("parquet").outputMode("append").option("path", path)


def upsert_to(candles: DataFrame, path: str, job: str, version: str | None = None) -> DataStreamWriter:
    """Every micro-batch merged into the candle table.

    ``job`` and the batch id name the batch, which makes a repeated one harmless. A new checkpoint starts its ids
    again; its batches hold other rows and are taken in under the used ids.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, f"{job}/{batch_id}", version=version)
    return candles.writeStream.outputMode("append").foreachBatch(write)


# --- late ticks ----------------------------------------------------------------------------------

def late_path(path: str) -> str:
    return f"{path.rstrip('/')}/late"


def on_time_path(path: str) -> str:
    return f"{path.rstrip('/')}/on_time"


_SEEN = T.StructType([T.StructField("batch", T.LongType()), T.StructField("newest", T.TimestampNTZType()), T.StructField("job", T.StringType())])
_FILLED = T.StructType([T.StructField("upto", T.LongType()), T.StructField("job", T.StringType())])


def _routed(ticks: T.StructType) -> T.StructType:
    return T.StructType([*ticks.fields, T.StructField("day", T.DateType()), T.StructField("job", T.StringType()), T.StructField("batch", T.LongType())])


def _replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def split_late(batch: DataFrame, path: str, job: str, batch_id: int, width: str, delay: str) -> None:
    """One batch of ticks dealt to the two sides of the watermark, which is the newest tick of the batches before it less
    ``delay``: a tick is late if its bar ended by then, as Spark would judge it.

    Both sides are tables by day and batch that a repeated batch replaces, not adds to. The newest tick so far is kept
    for the last two batches of the job, so a repeated one sees what it saw.
    """
    spark, folder = batch.sparkSession, f"{path.rstrip('/')}/seen"
    seen = read_table(spark, folder, _SEEN)
    before = None if seen is None else seen.where((F.col("job") == job) & (F.col("batch") < batch_id)).agg(F.max("newest")).first()[0]
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mark = F.lit(before).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.window("ts", width)["end"] <= mark, F.lit(False))
        rows = batch.withColumn("_late", late).withColumns(
            {"day": F.to_date("ts"), "job": F.lit(job), "batch": F.lit(batch_id).cast("bigint")})
        for side, folder_of_side in ((~F.col("_late"), on_time_path(path)), (F.col("_late"), late_path(path))):
            _replace(rows.where(side).drop("_late").hint("rebalance", "day"), folder_of_side, "day", "job", "batch")
        newest = batch.agg(F.max("ts")).first()[0]
        kept = [(batch_id - 1, before, job), (batch_id, max(filter(None, (before, newest)), default=None), job)]
        _replace(spark.createDataFrame([k for k in kept if k[1] is not None], _SEEN).coalesce(1), folder, "job")
    finally:
        batch.unpersist()


def route_late(ticks: DataFrame, path: str, job: str, width: str, delay: str) -> DataStreamWriter:
    """Ticks in time to one table below ``path`` and those behind the watermark to another, so that none is dropped unseen.

    ``stream_bars`` over ``on_time_ticks`` then meets no late tick, and ``backfill_late`` mends the bars of the others.
    ``job`` names the checkpoint: a new one, whose batch ids start again, needs a new name.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        split_late(batch, path, job, batch_id, width, delay)
    return ticks.writeStream.outputMode("append").foreachBatch(write)


def on_time_ticks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ticks in time as a stream, in the columns of the first one. A batch of ``route_late`` must have ended before the
    stream lists its files, else part of it may pass the watermark of the rest."""
    return spark.readStream.schema(_routed(schema)).parquet(on_time_path(path)).select(*schema.names)


def late_bars(spark: SparkSession, path: str, schema: T.StructType, width: str, fresh: DataFrame,
              keys: Sequence[str] = LEG) -> DataFrame | None:
    """The bars that the late ticks ``fresh`` belong to, built anew from all ticks; None without any.

    The late ticks tell the bars and the days to read: of both sides only these days are listed, and only the ticks of
    touched bars are aggregated. A bar's width divides the day, so a bar has the ticks of one day.
    """
    days = _bounds(fresh, ["day"])
    if days["min_day"] is None:
        return None
    start = F.window("ts", width)["start"]
    touched = fresh.select(*keys, start.alias("_start")).distinct()
    sides = [read_table(spark, p, _routed(schema)) for p in (late_path(path), on_time_path(path))]
    ticks = [_within(t, days, ["day"]).select(*schema.names, start.alias("_start")) for t in sides if t is not None]
    whole = ticks[0] if len(ticks) == 1 else ticks[0].unionByName(ticks[1])
    return B.ohlc_bars(whole.join(touched, [*keys, "_start"], "left_semi").drop("_start"), width, keys)


def backfill_late(spark: SparkSession, path: str, bars_path: str, job: str, schema: T.StructType, width: str,
                  keys: Sequence[str] = LEG) -> None:
    """Build the bars of late ticks anew and merge them.

    Beside the late ticks stands the number of the last batch taken in, so each is taken in once, and again if the job
    failed before. A bar of more ticks is the newer version, in whatever order the stream and the backfill write it.
    """
    late, record = read_table(spark, late_path(path), _routed(schema)), f"{path.rstrip('/')}/filled"
    if late is None:
        return
    filled = read_table(spark, record, _FILLED)
    upto = None if filled is None else filled.where(F.col("job") == job).agg(F.max("upto")).first()[0]
    fresh = late.where((F.col("job") == job) & (F.col("batch") > F.lit(-1 if upto is None else upto)))
    newest = fresh.agg(F.max("batch")).first()[0]
    if newest is None:
        return
    rebuilt = late_bars(spark, path, schema, width, fresh, keys)
    upsert(rebuilt, bars_path, f"{job}/late/{newest}", version="volume")
    _replace(spark.createDataFrame([(newest, job)], _FILLED).coalesce(1), record, "job")


def refresh_bars(
    ticks: DataFrame, path: str, bars_path: str, job: str, width: str, delay: str, keys: Sequence[str] = LEG,
) -> None:
    """Take in the ticks that have landed: route them, emit the bars that are complete, mend those that late ticks touch."""
    spark, schema = ticks.sparkSession, ticks.schema
    run(route_late(ticks, path, job, width, delay), f"{path}/route")
    closed = stream_bars(on_time_ticks(spark, path, schema), width, delay, keys)
    run(upsert_to(closed, bars_path, job, version="volume"), f"{path}/bars")
    backfill_late(spark, path, bars_path, job, schema, width, keys)


# --- refreshed results ---------------------------------------------------------------------------

def days_path(candles_path: str) -> str:
    """The table of (series, day, bars) that is kept beside the candles."""
    return f"{candles_path.rstrip('/')}_days"


def _within(table: DataFrame, low_high: Row | dict, columns: Sequence[str]) -> DataFrame:
    """Literal bounds, which prune the partitions that are listed."""
    for c in columns:
        table = table.where(F.col(c).between(low_high[f"min_{c}"], low_high[f"max_{c}"]))
    return table


def _bounds(df: DataFrame, columns: Sequence[str]) -> Row:
    return df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()


def affected_spans(days: DataFrame, touched: DataFrame, lookback: int, keys: Sequence[str] = SERIES,
                   to_end: bool = False) -> DataFrame:
    """Per touched series the days whose signals change, ``from_day`` to ``to_day``, and ``start``, from which on bars
    are needed for them.

    A changed bar alters its own day and, through the rate of change, the next ``lookback`` bars; with ``to_end``, as where
    statistics run through the series, all days after it. ``touched`` has the series' first and last touched day;
    ``days`` has (series, day, bars), so no bar is read here.
    """
    keys = list(keys)
    rows = days.join(touched, keys)
    newest, oldest = Window.partitionBy(*keys).orderBy(F.col("day").desc()), Window.partitionBy(*keys).orderBy("day")

    def nearer(w: WindowSpec, side: Column) -> Column:
        """Bars on this side of the touched days that are nearer to them than this day."""
        return F.coalesce(F.sum(F.when(side, F.col("bars"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    before, after = F.col("day") < F.col("first"), F.col("day") > F.col("last")
    rows = rows.withColumns({"_before": nearer(newest, before), "_after": nearer(oldest, after)})
    return rows.groupBy(*keys).agg(
        F.max("first").alias("from_day"),
        F.greatest(F.max("last"), F.max(F.when(after & (F.lit(to_end) | (F.col("_after") < lookback)), F.col("day")))).alias("to_day"),
        F.least(F.max("first"), F.min(F.when(before & (F.col("_before") < lookback), F.col("day")))).alias("start"))


def counted_days(spark: SparkSession, batch: DataFrame, candles_path: str, batch_id: str, where: Row,
                 keys: Sequence[str] = SERIES) -> DataFrame:
    """The table of (series, day, bars) within the batch's expiries, after the days the batch touched are counted anew from
    their own partitions. A day without a bar of both legs counts none."""
    keys = list(keys)
    candles = read_candles(spark, candles_path, refresh=True)
    own = _within(candles, where, ["expiry", "day"]).join(batch.select("expiry", "day").distinct(), ["expiry", "day"], "left_semi")
    complete = F.col("CE_close").isNotNull() & F.col("PE_close").isNotNull()
    counted = B.straddle_bars(own, keys, both_legs=False, numbered=False).groupBy(*keys, "day").agg(F.count_if(complete).alias("bars"))
    upsert(counted, days_path(candles_path), f"{batch_id}/days", key=[*keys, "day"], partitions=["expiry"])
    spark.catalog.refreshByPath(days_path(candles_path))
    return _within(spark.read.schema(counted.schema).parquet(days_path(candles_path)), where, ["expiry"])


def touched_history(spark: SparkSession, batch: DataFrame, candles_path: str, batch_id: str, lookback: int,
                    keys: Sequence[str] = SERIES, to_end: bool = False) -> DataFrame:
    """Straddle bars that the signals touched by a merged batch depend on, with ``from_day`` and ``to_day``.

    The table of days tells which partitions of the candles are needed, and only these are listed and read.
    """
    keys = list(keys)
    where = _bounds(batch, ["expiry", "day"])
    if where["min_day"] is None:
        return B.straddle_bars(batch, keys, numbered=False).withColumns({"from_day": F.col("day"), "to_day": F.col("day")})
    days = counted_days(spark, batch, candles_path, batch_id, where, keys)
    touched = batch.groupBy(*keys).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    spans = affected_spans(days, touched, lookback, keys, to_end)
    reach = spans.agg(F.min("start").alias("min_day"), F.max("to_day").alias("max_day")).first()
    if reach["min_day"] is None:  # no bar with both legs
        reach = where
    candles = _within(_within(read_candles(spark, candles_path, refresh=True), where, ["expiry"]), reach, ["day"])
    straddles = B.straddle_bars(candles, keys, numbered=False).join(spans, keys)
    return straddles.where(F.col("day").between(F.col("start"), F.col("to_day"))).drop("start")


def refresh_signals(
    spark: SparkSession, batch: DataFrame, candles_path: str, signals_path: str, batch_id: str,
    version: str | None = None,
) -> None:
    """Merge a batch of candles, then recompute and merge the signals it touches. The batch is read once."""
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        upsert(batch, candles_path, f"{batch_id}/candles", version=version)
        history = touched_history(spark, batch, candles_path, batch_id, ind.ROC_LENGTH)
        signals = (S.straddle_signals(history, frame=S.DAY)
                   .where(F.col("day").between(F.col("from_day"), F.col("to_day"))).drop("from_day", "to_day", "day_num", "IS_LATEST_DAY"))
        upsert(signals, signals_path, f"{batch_id}/signals", key=[*SERIES, "date"])
    finally:
        batch.unpersist()


def totals_path(signals_path: str) -> str:
    """The table of each series' running totals before and after every day, kept beside signals of whole series."""
    return f"{signals_path.rstrip('/')}_totals"


def latest_path(path: str) -> str:
    """The newest day's row of each series of a table of states."""
    return f"{path.rstrip('/')}_latest"


def _known(spark: SparkSession, path: str, schema: T.StructType, bounds: Row | dict, columns: Sequence[str]) -> DataFrame:
    """A table kept by these jobs, empty if it isn't there yet, within literal bounds."""
    table = read_table(spark, path, schema)
    return spark.createDataFrame([], schema) if table is None else _within(table, bounds, columns)


def _onwards(where: Row) -> dict:
    return where.asDict() | {"max_day": dt.date.max}


def states_before(spark: SparkSession, batch: DataFrame, path: str, newest: str, shape: T.StructType, where: Row,
                  keys: Sequence[str]) -> DataFrame:
    """The state, in columns, of each series the batch touches before its first touched day; series without one are left out.

    ``path`` has a row per series and day with the state after it and, in ``start``, before it; ``newest`` each series'
    last one. A series whose last day is older than the batch goes on from that. Otherwise its earliest day not before
    the batch tells the state it started from. So no day before the batch is listed or read.
    """
    keys = list(keys)
    held = shape["start"].dataType.names
    touched = batch.groupBy(*keys).agg(F.min("day").alias("_first"))
    later = (_known(spark, path, shape, _onwards(where), ["expiry", "day"]).join(touched, keys).where(F.col("day") >= F.col("_first"))
             .groupBy(*keys).agg(F.min_by("start", "day").alias("_start")))
    latest = (_known(spark, newest, shape, where, ["expiry"])
              .select(*keys, F.col("day").alias("_day"), F.struct(*held).alias("_end")))
    known = touched.join(later, keys, "left").join(latest, keys, "left")
    state = F.when(F.col("_start").isNotNull(), F.col("_start")).when(F.col("_day") < F.col("_first"), F.col("_end"))
    return known.select(*keys, state.alias("s")).where("s IS NOT NULL").select(*keys, "s.*")


def _state_shape(keys: Sequence[str], fields: T.StructType, held: T.StructType) -> T.StructType:
    return T.StructType([*[fields[k] for k in keys], T.StructField("day", T.DateType()), *held, T.StructField("start", held)])


_SUMS = {"close_count": T.LongType(), "oi_sum": T.LongType(), "rows": T.LongType()}
_TOTALS = T.StructType([T.StructField(name, _SUMS.get(name, T.DoubleType())) for name in ind.RUNNING_TOTALS])


def refresh_series_signals(
    spark: SparkSession, batch: DataFrame, candles_path: str, signals_path: str, batch_id: str,
    version: str | None = None, keys: Sequence[str] = SERIES,
) -> None:
    """Merge a batch of candles, then recompute and merge the signals of whole series from their first touched day on.

    Statistics of this frame run from the first bar, so a bar alters all that follow it, but the running totals before
    the batch are kept by day: nothing older than the look-back of the rate of change is read.
    """
    keys = list(keys)
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        upsert(batch, candles_path, f"{batch_id}/candles", version=version)
        where = _bounds(batch, ["expiry", "day"])
        if where["min_day"] is None:
            return
        totals, shape = totals_path(signals_path), _state_shape(keys, batch.schema, _TOTALS)
        history = touched_history(spark, batch, candles_path, batch_id, ind.ROC_LENGTH, keys, to_end=True)
        prior = states_before(spark, batch, totals, latest_path(totals), shape, where, keys)
        signals = S.straddle_signals(history, keys, S.WHOLE, warmup=F.col("day") < F.col("from_day"), initial=prior)
        signals = signals.drop("from_day", "to_day", "day_num", "IS_LATEST_DAY")
        upsert(signals, signals_path, f"{batch_id}/signals", key=[*keys, "date"])

        touched = batch.groupBy(*keys).agg(F.min("day").alias("_first"))
        now = _known(spark, signals_path, signals.schema, _onwards(where), ["expiry", "day"]).join(touched, keys).where(F.col("day") >= F.col("_first"))
        end = F.max_by(F.struct(*[F.col(c).cast(_TOTALS[name].dataType).alias(name) for name, c in ind.RUNNING_TOTALS.items()]), "date")
        ends = now.groupBy(*keys, "day").agg(end.alias("_end")).join(prior.select(*keys, F.struct(*_TOTALS.names).alias("_prior")), keys, "left")
        start = F.coalesce(F.lag("_end").over(Window.partitionBy(*keys).orderBy("day")), F.col("_prior"))
        upsert(ends.select(*keys, "day", "_end.*", start.alias("start")), totals, f"{batch_id}/totals", key=[*keys, "day"])
        kept = _known(spark, totals, shape, _onwards(where), ["expiry", "day"]).join(touched.select(*keys), keys, "left_semi")
        rest = [c for c in shape.names if c not in keys]
        newest = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), "day").alias("_r")).select(*keys, "_r.*")
        upsert(newest, latest_path(totals), f"{batch_id}/latest", key=keys, partitions=["expiry"])
    finally:
        batch.unpersist()


def refresh_frame_signals(
    spark: SparkSession, batch: DataFrame, candles_path: str, signals_path: str, batch_id: str, num_days: int,
    version: str | None = None, keys: Sequence[str] = SERIES,
) -> None:
    """Merge a batch of candles, then replace the signals of the touched series over their last ``num_days`` days.

    A new day moves the frame, and with it every running statistic, so the frame is computed again; the table of days tells
    which days it has, and only their partitions are read.
    """
    keys = list(keys)
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        upsert(batch, candles_path, f"{batch_id}/candles", version=version)
        where = _bounds(batch, ["expiry", "day"])
        if where["min_day"] is None:
            return
        touched = batch.select(*keys).distinct()
        days = counted_days(spark, batch, candles_path, batch_id, where, keys).join(touched, keys, "left_semi")
        newest_first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc()))
        framed = days.select(*keys, "day", newest_first.alias("_nth")).where(F.col("_nth") <= num_days).drop("_nth")
        candles = _within(_within(read_candles(spark, candles_path, refresh=True), where, ["expiry"]), _bounds(framed, ["day"]), ["day"])
        straddles = B.straddle_bars(candles.join(framed, [*keys, "day"], "left_semi"), keys, both_legs=False, numbered=False)
        signals = S.straddle_signals(straddles, keys, S.WHOLE)
        replace_series(signals, signals_path, touched, keys)
    finally:
        batch.unpersist()


def states_path(readings_path: str) -> str:
    """The table of each contract's RSI state before and after every day, kept beside the readings."""
    return f"{readings_path.rstrip('/')}_states"


_RSI = T.StructType([T.StructField("bars", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in M.RSI_STATE[1:]]])


def advanced_states(spark: SparkSession, batch: DataFrame, candles_path: str, readings_path: str, where: Row,
                    keys: Sequence[str] = LEG) -> DataFrame:
    """RSI states of the contracts a merged batch touches, from their first touched day on; ``where`` has its bounds.

    Bars out of order cost the days after them; no candle of a day before the batch is read.
    """
    keys = list(keys)
    prior = states_before(spark, batch, states_path(readings_path), readings_path, _state_shape(keys, batch.schema, _RSI), where, keys)
    touched = batch.groupBy(*keys).agg(F.min("day").alias("_first"))
    candles = _within(read_candles(spark, candles_path, refresh=True), _onwards(where), ["expiry", "day"])
    return M.rsi_states(candles.join(touched, keys).where(F.col("day") >= F.col("_first")).drop("_first"), prior, keys)


def refresh_rsi(
    spark: SparkSession, batch: DataFrame, candles_path: str, readings_path: str, batch_id: str,
    version: str | None = None, keys: Sequence[str] = LEG,
) -> None:
    """Merge a batch of candles, then advance the RSI of the contracts it touches. The batch is read once."""
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        upsert(batch, candles_path, f"{batch_id}/candles", version=version)
        where = _bounds(batch, ["expiry", "day"])
        if where["min_day"] is None:
            return
        states = advanced_states(spark, batch, candles_path, readings_path, where, keys)
        upsert(states, states_path(readings_path), f"{batch_id}/states", key=[*keys, "day"])
        now = _known(spark, states_path(readings_path), _state_shape(keys, batch.schema, _RSI), _onwards(where), ["expiry", "day"])
        now = now.join(batch.select(*keys).distinct(), list(keys), "left_semi")
        upsert(M.rsi_readings(now, keys), readings_path, f"{batch_id}/rsi", key=list(keys), partitions=["expiry"])
    finally:
        batch.unpersist()


def rsi_to(
    candles: DataFrame, candles_path: str, readings_path: str, job: str, version: str | None = None,
) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        refresh_rsi(batch.sparkSession, batch, candles_path, readings_path, f"{job}/{batch_id}", version)
    return candles.writeStream.outputMode("append").foreachBatch(write)


def signals_to(
    candles: DataFrame, candles_path: str, signals_path: str, job: str, version: str | None = None,
) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        refresh_signals(batch.sparkSession, batch, candles_path, signals_path,
                        f"{job}/{batch_id}", version)
    return candles.writeStream.outputMode("append").foreachBatch(write)


def series_signals_to(
    candles: DataFrame, candles_path: str, signals_path: str, job: str, version: str | None = None,
) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        refresh_series_signals(batch.sparkSession, batch, candles_path, signals_path, f"{job}/{batch_id}", version)
    return candles.writeStream.outputMode("append").foreachBatch(write)


def frame_signals_to(
    candles: DataFrame, candles_path: str, signals_path: str, job: str, num_days: int, version: str | None = None,
) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        refresh_frame_signals(batch.sparkSession, batch, candles_path, signals_path, f"{job}/{batch_id}", num_days, version)
    return candles.writeStream.outputMode("append").foreachBatch(write)
