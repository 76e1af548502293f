"""Exact series windows that never hold a whole series in one task.

A window over a series sends every row of that series to one task, so one long series decides how
long the job takes. Here a series is cut into *segments* of whole trading days. Rows are shuffled by
(series, segment), and every window runs inside a segment:

* what a rolling window needs from before the segment is supplied by copies of the preceding rows
  (the halo), dropped again at the end;
* what a running aggregate needs is supplied by the totals of the earlier segments. These come from
  a table with one row per (series, day), built with a map-side combine; only that table is ever
  windowed per series, and a series has no more days than the calendar.

The result equals the plain window row for row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# A segment of 128 days of 3-minute bars is about 16,000 rows.
DAYS_PER_SEGMENT = 128

# Steps of a decay that are summed with their weights in one go; 2 ** 500 is far within a double.
DECAY_BLOCK = 500

_SEG, _HALO, _BEFORE, _LATEST, _ROWS = "_segment", "_halo", "_rows_before", "_latest_day", "_rows"

_MARK, _TOP = "_mark", "_top"

Carried = tuple[str, Column] | tuple[str, Column, float]


def _partial(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "count":
        return F.count(value)
    if kind == "min":
        return F.min(value)
    if kind == "max":
        return F.max(value)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _merge(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before + local, before, local)
    if kind == "count":
        return F.coalesce(before, F.lit(0)) + local
    if kind == "min":
        return F.least(before, local)
    if kind == "max":
        return F.greatest(before, local)
    if kind == "first":
        return F.coalesce(before, local)
    return F.coalesce(local, before)


def _no_step() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("b"))


def _step(before: Column, n: Column, b: Column, factor: float) -> Column:
    """Two maps ``x -> factor ** n * x + b``, one after the other."""
    return F.struct((before["n"] + n).alias("n"), (before["b"] * F.pow(F.lit(factor), n) + b).alias("b"))


def _all_steps(steps: Column, name: str, factor: float) -> Column:
    """Maps in an array of (order, map), one after the other."""
    return F.aggregate(F.array_sort(steps), _no_step(), lambda acc, d: _step(acc, d[name]["n"], d[name]["b"], factor))


def decay_steps(value: Column, order: Sequence[str], factor: float) -> Column:
    """Aggregate: the map ``x -> factor * x + value`` of every row in turn, as one map (n, b). NULLs change nothing."""
    steps = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("_b")))))
    return F.aggregate(steps, _no_step(), lambda acc, r: _step(acc, F.lit(1).cast("bigint"), r["_b"], factor))


def marked(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a hash over their columns, which an aggregate of them takes along for ``attached``."""
    return df.withColumn(_MARK, F.xxhash64(*(columns or df.columns)))


def attached(rows: DataFrame, table: DataFrame, on: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Join ``marked`` rows to a table aggregated from them, so that Spark evaluates the rows once.

    A self-join runs its input twice unless both sides come from exchanges of the same columns and filters, which Spark then
    reuses. Left alone, each side is pruned to its own needs. Here either side needs every column: the greatest hash of
    the group is compared with the row's own, a condition that always holds, and ``keep``, which drops rows, is part of
    it. Filters on the keys reach the source on both sides; the price is that columns the caller drops later are read.
    """
    here = {c: f"_on_{c}" for c in on}
    fits = F.col(_MARK) <= F.col(_TOP)
    condition = fits if keep is None else F.when(keep, fits)
    for c, other in here.items():
        condition = (F.col(c) == F.col(other)) & condition
    return rows.join(table.withColumnsRenamed(here), condition).drop(_MARK, _TOP, *here.values())


def top_mark() -> Column:
    return F.max(_MARK).alias(_TOP)


def trading_days(df: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """One row per (series, day)."""
    return df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("bars"))


@dataclass
class Segmented:
    """A frame cut into segments, and the windows to use on it."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    day: str
    lookback: int
    carried: dict[str, Carried] = field(default_factory=dict)
    totals: tuple[str, ...] = ()
    restarted: bool = False
    frame: tuple[str, ...] = ()
    shared: tuple[str, ...] = ()
    initial: tuple[str, ...] = ()

    @property
    def window(self) -> WindowSpec:
        """Rows of the segment in series order, halo included: for lags and rolling frames."""
        return Window.partitionBy(*self.keys, _SEG).orderBy(*self._sorted)

    @property
    def _sorted(self) -> list[str]:
        """Day first, so that windows within a day reuse the sort of the segment."""
        return [self.day, *(c for c in self.order if c != self.day)]

    @property
    def _running(self) -> WindowSpec:
        return (Window.partitionBy(*self.keys, _SEG, *self.frame).orderBy(*self._sorted)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def day_window(self) -> WindowSpec:
        """Rows of one trading day up to the current one. Days are never split over segments."""
        return (Window.partitionBy(*self.keys, _SEG, self.day).orderBy(*self.order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def rolling(self, rows: int) -> WindowSpec:
        if rows - 1 > self.lookback:
            raise ValueError(f"a frame of {rows} rows needs a lookback of {rows - 1}")
        return self.window.rowsBetween(-(rows - 1), Window.currentRow)

    def rownum(self) -> Column:
        """1, 2, 3 ... over the whole series."""
        own = F.count(F.when(~F.col(_HALO), F.lit(1))).over(self._running)
        return own if self.restarted else own + F.col(_BEFORE)

    def rows_in_series(self) -> Column:
        return F.col(_ROWS)

    def whole(self, name: str) -> Column:
        """The aggregate ``name`` over the whole series, the same on all its rows."""
        return F.col(f"_whole_{name}")

    def is_latest_day(self) -> Column:
        return F.col(_LATEST)

    def running(self, name: str) -> Column:
        """The carried aggregate ``name`` from the start of the series to the current row."""
        kind, value, *_ = self.carried[name]
        own = F.when(~F.col(_HALO), value)
        w = self._running
        if kind == "first":
            local = F.first(own, ignorenulls=True).over(w)
        elif kind == "last":
            local = F.last(own, ignorenulls=True).over(w)
        else:
            local = _partial(kind, own).over(w)
        return local if self.restarted else _merge(kind, F.col(f"_before_{name}"), local)

    def restart(self, df: DataFrame) -> DataFrame:
        """Begin the running aggregates anew with every trading day.

        Days are never split over segments, so nothing is carried and the halo is no longer needed.
        """
        self.restarted, self.frame = True, (self.day,)
        return self.own_rows(df)

    def add_running(self, df: DataFrame, **added: tuple[str, Column]) -> DataFrame:
        """Running aggregates (kind, column), by the name of the result, of columns that themselves depend on running
        aggregates; the kinds are sum, count, min, max and last.

        The rows are needed twice here: for the result, and for the totals of the earlier segments. With ``shared`` both
        read the shuffled rows of the segments. Nothing runs before an action.
        """
        w, locals_, totals, merged = self._running, {}, [], {}
        on = [*self.keys, _SEG]
        earlier = Window.partitionBy(*self.keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
        befores = []
        for out, (kind, value) in added.items():
            own, last = F.when(~F.col(_HALO), value), kind == "last"
            locals_[f"_local_{out}"] = (F.last(own, ignorenulls=True) if last else _partial(kind, own)).over(w)
            total = F.max_by(own, F.when(own.isNotNull(), F.struct(*self._sorted))) if last else _partial(kind, own)
            totals.append(total.alias(f"_total_{out}"))
            part = F.col(f"_total_{out}")
            before = F.last(part, ignorenulls=True) if last else _partial("sum" if kind == "count" else kind, part)
            befores.append(before.over(earlier).alias(f"_total_{out}"))
            merged[out] = _merge(kind, F.col(f"_total_{out}"), F.col(f"_local_{out}"))
        if self.restarted:
            return df.withColumns({out: locals_[f"_local_{out}"] for out in added})
        df = marked(df.withColumns(locals_), self.shared) if self.shared else df.withColumns(locals_)
        top = [_TOP] if self.shared else []
        table = df.groupBy(*on).agg(*totals, *([top_mark()] if top else [])).select(*on, *befores, *top)
        joined = attached(df, table, on) if top else df.join(table, on, "left")
        for out, (kind, _) in added.items():
            if out in self.initial:
                merged[out] = _merge(kind, F.col(f"_initial_{out}"), merged[out])
        return joined.withColumns(merged).drop(*locals_, *[f"_total_{out}" for out in added])

    def add_decayed(self, df: DataFrame, out: str, name: str, start: Column, before_row: bool = False) -> DataFrame:
        """``start`` after the carried map ``x -> factor * x + value`` of every row up to the current one, or up to the
        one before it.

        Maps compose, so a row needs the one map of all earlier segments and those of its own. Within a segment
        ``DECAY_BLOCK`` maps at a time are a weighted running sum, whatever the number of rows.
        """
        _, value, factor = self.carried[name]
        own = F.when(~F.col(_HALO), value)
        df = df.withColumn("_i", F.count(own).over(self._running))
        df = df.withColumn("_block", F.floor((F.greatest(F.col("_i"), F.lit(1)) - 1) / F.lit(DECAY_BLOCK)).cast("bigint"))
        in_block = (Window.partitionBy(*self.keys, _SEG, *self.frame, "_block").orderBy(*self._sorted)
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        nth = F.col("_i") - F.col("_block") * DECAY_BLOCK
        shrunk = F.pow(F.lit(factor), nth)
        weighted = F.sum(own * F.pow(F.lit(1 / factor), nth)).over(in_block)
        df = df.withColumn("_own", F.coalesce(weighted * shrunk, F.lit(0.0)))
        full = F.when(own.isNotNull() & (F.col("_i") % DECAY_BLOCK == 0), F.col("_own"))
        df = df.withColumn("_full", F.collect_list(full).over(self._running))
        blocks = F.aggregate(F.slice("_full", F.lit(1), F.col("_block").cast("int")), F.lit(0.0),
                             lambda acc, b: acc * F.lit(factor ** DECAY_BLOCK) + b)
        before = _no_step() if self.restarted else F.coalesce(F.col(f"_before_{name}"), _no_step())
        reached = (start * F.pow(F.lit(factor), before["n"] + F.col("_i")) + before["b"] * F.pow(F.lit(factor), F.col("_i"))
                   + blocks * shrunk + F.col("_own"))
        df = df.withColumn(out, reached).drop("_i", "_block", "_own", "_full")
        if before_row:
            rows = Window.partitionBy(*self.keys, _SEG, *self.frame).orderBy(*self._sorted)
            entered = start * F.pow(F.lit(factor), before["n"]) + before["b"]
            df = df.withColumn(out, F.coalesce(F.lag(F.when(~F.col(_HALO), F.col(out))).over(rows), entered))
        return df

    def own_rows(self, df: DataFrame) -> DataFrame:
        return df.where(~F.col(_HALO))

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the halo and the helper columns."""
        helpers = [_SEG, _HALO, _BEFORE, _LATEST, _ROWS, *(f"_before_{n}" for n in self.carried),
                   *(f"_whole_{n}" for n in self.totals), *(f"_initial_{n}" for n in self.initial)]
        return self.own_rows(df).drop(*helpers)


def cut(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str] = "date",
    day: str = "day",
    lookback: int = 0,
    carry: dict[str, Carried] | None = None,
    days: int = DAYS_PER_SEGMENT,
    keep: Column | None = None,
    number_days: bool = False,
    whole: dict[str, tuple[str, Column]] | None = None,
    shared: bool = False,
    warmup: Column | None = None,
    initial: DataFrame | None = None,
) -> Segmented:
    """Cut every series of ``df`` into segments of ``days`` trading days.

    ``lookback`` is the number of earlier rows the rolling windows read in all (add them up when one
    rolling result feeds another). ``carry`` names the running aggregates: (kind, column) with kind
    one of sum, count, min, max, first, last; the last two skip NULLs. The kind ``decay`` has a factor as well and
    carries the composition of the maps ``x -> factor * x + column`` for ``add_decayed``. ``order`` must be unique
    within a series and sort by ``day`` first.

    ``whole`` names aggregates over all rows of a series (sum, count, min or max).

    ``shared`` is for frames that come out of a shuffle, such as bars made from legs or ticks: they are evaluated once for
    the rows and the totals, see ``attached``. A frame read from a table is better read twice, the totals with few columns.

    Results can go on from earlier ones: ``initial`` has, by the keys, the totals of each series before its first row here under
    the names of ``carry``, of what ``add_running`` adds, and ``rows``, their number (decays and the kinds first and last can't be
    taken up). Rows that meet ``warmup`` only feed rolling windows and are dropped at the end.

    ``keep`` drops rows; with ``number_days`` the days are numbered from the latest back in
    ``day_num``, and a day whose rows are all dropped still takes its number.
    """
    days = max(days, lookback)  # the halo reaches one segment back, and a day has a row at least
    keys, carry, whole = list(keys), dict(carry or {}), dict(whole or {})
    order = [order] if isinstance(order, str) else list(order)

    def kept(value: Column) -> Column:
        return value if keep is None else F.when(keep, value)

    counted = (lambda value: value) if warmup is None else (lambda value: F.when(~warmup, value))
    partials = [F.count(kept(F.lit(1))).alias("_all"), F.count(kept(counted(F.lit(1)))).alias("_n")]
    for name, (kind, value, *factor) in carry.items():
        value = kept(counted(value))
        if kind == "decay":
            agg = decay_steps(value, order, *factor)
        elif kind in ("first", "last"):
            pick = F.min_by if kind == "first" else F.max_by
            agg = pick(value, F.when(value.isNotNull(), F.struct(*order)))
        else:
            agg = _partial(kind, value)
        partials.append(agg.alias(f"_p_{name}"))
    partials += [_partial(kind, kept(value)).alias(f"_w_{name}") for name, (kind, value) in whole.items()]
    if shared:  # the join on the day asks for it anyway, but Spark can't carry that over the windows of the totals
        df = marked(df.where(F.col(day).isNotNull()))
        partials.append(top_mark())
    daily = df.groupBy(*keys, day).agg(*partials)

    by_series = Window.partitionBy(*keys)
    if number_days:
        newest_first = by_series.orderBy(F.col(day).desc())
        daily = daily.withColumn("day_num", F.row_number().over(newest_first).cast("bigint"))
    if keep is not None:
        daily = daily.where(F.col("_all") > 0)
    nth_day = F.row_number().over(by_series.orderBy(day))
    daily = daily.withColumn(_SEG, F.floor((nth_day - 1) / F.lit(days)).cast("bigint"))

    in_order = by_series.orderBy(_SEG)
    earlier = in_order.rangeBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(_BEFORE),
               F.sum("_n").over(by_series).alias(_ROWS),
               (F.col(day) == F.max(day).over(by_series)).alias(_LATEST)]
    decays = {name: factor for name, (kind, _, *factor) in carry.items() if kind == "decay"}
    if decays:  # the days of a segment as one map each, which its first day holds
        own_days = F.row_number().over(Window.partitionBy(*keys, _SEG).orderBy(day)) == 1
        in_segment = Window.partitionBy(*keys, _SEG)
        for name, (factor,) in decays.items():
            steps = F.collect_list(F.struct(day, f"_p_{name}")).over(in_segment)
            daily = daily.withColumn(f"_s_{name}", _all_steps(steps, f"_p_{name}", factor))
        daily = daily.withColumns({f"_s_{name}": F.when(own_days, F.struct(_SEG, f"_s_{name}")) for name in decays})
    for name, (kind, _, *factor) in carry.items():
        part = F.col(f"_p_{name}")
        if kind == "decay":
            steps = F.collect_list(f"_s_{name}").over(earlier)
            columns.append(_all_steps(steps, f"_s_{name}", *factor).alias(f"_before_{name}"))
            continue
        if kind == "first":
            before = F.min_by(part, F.when(part.isNotNull(), F.col(day)))
        elif kind == "last":
            before = F.max_by(part, F.when(part.isNotNull(), F.col(day)))
        else:
            before = _partial("sum" if kind == "count" else kind, part)
        columns.append(before.over(earlier).alias(f"_before_{name}"))
    for name, (kind, _) in whole.items():
        total = _partial("sum" if kind == "count" else kind, F.col(f"_w_{name}"))
        columns.append(total.over(by_series).alias(f"_whole_{name}"))
    if lookback:
        later = (Window.partitionBy(*keys, _SEG).orderBy(day)
                 .rowsBetween(1, Window.unboundedFollowing))
        columns.append((
            (F.coalesce(F.sum("_all").over(later), F.lit(0)) < lookback)
            & (F.col(_SEG) < F.max(_SEG).over(by_series))).alias("_feeds_next"))
    daily = daily.select(*keys, day, _SEG, *(["day_num"] if number_days else []), *([_TOP] if shared else []), *columns)

    taken_up = ()
    if initial is not None:
        taken_up = tuple(c for c in initial.columns if c not in keys)
        daily = daily.join(initial.withColumnsRenamed({c: f"_initial_{c}" for c in taken_up}), keys, "left")
        daily = daily.withColumn(_BEFORE, F.col(_BEFORE) + F.coalesce(F.col("_initial_rows"), F.lit(0)))
        daily = daily.withColumns({f"_before_{name}": _merge(kind, F.col(f"_initial_{name}"), F.col(f"_before_{name}")) if kind != "count"
                                   else F.coalesce(F.col(f"_before_{name}"), F.lit(0)) + F.coalesce(F.col(f"_initial_{name}"), F.lit(0))
                                   for name, (kind, *_) in carry.items() if name in taken_up})
    if shared:
        rows = attached(df, daily, [*keys, day], keep)
    else:
        rows = (df if keep is None else df.where(keep)).join(daily, [*keys, day])
    plain = [c for c in rows.columns if c not in (_SEG, "_feeds_next")]
    before = F.lit(False) if warmup is None else warmup
    if lookback:
        here = F.struct(F.col(_SEG).alias(_SEG), before.alias(_HALO))
        after = F.struct((F.col(_SEG) + 1).alias(_SEG), F.lit(True).alias(_HALO))
        copies = F.when(F.col("_feeds_next"), F.array(here, after)).otherwise(F.array(here))
        rows = rows.select(*plain, F.inline(copies))
    else:
        rows = rows.select(*plain, _SEG, before.alias(_HALO))
    return Segmented(rows, keys, order, day, lookback, carry, tuple(whole), shared=tuple(rows.columns) if shared else (),
                     initial=taken_up)
