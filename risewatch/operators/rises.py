"""Rise alerts over series of any length.

A rise alert depends on every earlier reading of its series, so the obvious plan collects a series into
one task.  Here the readings are range-partitioned by (series, time) instead: Spark sizes the ranges by
sampling, so a series that holds a third of all rows is spread over a third of the tasks.

1. Each range is read once, in order.  Only its first series can have begun in an earlier range.  For
   that one, every low that an earlier range might have handed over is followed at the same time; they
   often meet in one low soon, and from there on alerts are final.  Until then the readings that decide
   between the possible lows are kept as *pending*.
2. Per range and series a table goes on: the low the range closes with (*carry*), or, where the lows did not
   meet, which low each possible one leaves the range as (*entries*, one per reading that a low from before
   can first react to).  These tables give the low that enters each range: in one ordered pass per series
   while all of them together are few rows (``SERIAL_ROWS``; small inputs by estimate), else by pointer jumping (``operators.prefix``), in
   which no task sees more than one range's table.
3. Every range's pending readings are followed again from the low that enters it, all ranges at once.

The passes stream over Arrow batches and hold a handful of lows, or those of one expiry, never a series.  No
reading passes a task that works on a whole series; a sensor that idles on one value or climbs for ever
makes pass 3 longer, not less parallel.  The outcome is the same for every number of ranges.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from risewatch.operators import prefix
from risewatch.operators.ordering import estimated_bytes, stage_counting

#: Entries of all series up to which one ordered pass per series goes through them.
SERIAL_ROWS = 100_000
#: Readings estimated at no more bytes than these cannot have many more, so they are not counted first.
SMALL_BYTES = 16 << 20

ALERT, PENDING, CARRY, LOWEST, CLOSING, SIZE, ENTRY, ENTER = range(8)
SERIAL = (CARRY, ENTRY)
_MARKS = ["t0", "v0", "t1", "v1", "n"]
_FIRST = -(2**63)


@dataclass(frozen=True)
class Rise:
    """When the running low moves.

    ``expire_us``: a low this old is dropped for the current reading, without an alert (None: never).
    ``strict_time``: a reading at the very instant of the low leaves it alone.
    """

    threshold: float
    expire_us: int | None = None
    strict_time: bool = False

    def reacts(self, low, t, v) -> bool:
        """Whether a low (time, value) gives way to a reading."""
        t0, v0 = low
        if self.expire_us is not None and t - t0 >= self.expire_us:
            return True
        return not (self.strict_time and t <= t0) and (v - v0 > self.threshold or v < v0)

    def follow(self, low, times, values, alerts: list, start: int = 0):
        """Advance a known low (time, value) over ordered readings.

        Per alert (position, low time, low value) is appended; positions count from ``start``.
        """
        t0, v0 = low
        limit, expire, strict = self.threshold, self.expire_us, self.strict_time
        for i, (t, v) in enumerate(zip(times, values), start):
            if expire is not None and t - t0 >= expire:
                t0, v0 = t, v
            elif strict and t <= t0:
                continue
            elif v - v0 > limit:
                alerts.append((i, t0, v0))
                t0, v0 = t, v
            elif v < v0:
                t0, v0 = t, v
        return t0, v0


class PossibleLows:
    """All lows a series may stand at, given readings from some point on but nothing before it.

    The lows seen since then are kept in order; that order is both by time and by value, since a reading
    below a low replaces it.  So the lows that expire or alert are at the left, those undercut at the
    right, and each reading is added and removed at most once.  ``unseen`` tells whether a low from
    before the first reading may still stand.

    ``add`` and ``rest`` give the readings from which a known low can be followed to the same alerts.
    Left out are readings no possible low reacts to, and those that can only become a low without an alert
    and are then undercut: a low that skips them is undercut, or found expired, by the same later reading.

    ``entries`` are the readings that a low from before may be the first to react to, and ``leaving`` the low
    that each of them has led to by now.
    """

    def __init__(self, rise: Rise, first_time: int):
        self.rise = rise
        self.first_time = first_time
        self.unseen = True
        self.least, self.most = float("inf"), float("-inf")
        self.lows: deque = deque()  # (time, value, whether given out, entries that led here)
        self.entries: list = []

    def add(self, t: int, v: float) -> list:
        """Take one reading; the readings now known to be needed."""
        rise, lows = self.rise, self.lows
        limit, expire, strict = rise.threshold, rise.expire_us, rise.strict_time
        needed: list = []
        led: list = []
        reacts = may_alert = False
        if self.unseen:
            if strict and t == self.first_time:
                # The unseen low may share this instant, so the reading rules nothing out.
                reacts = may_alert = True
            else:
                may_alert = v > self.most
                reacts = may_alert or expire is not None or v < self.least
                self.least, self.most = min(self.least, v), max(self.most, v)
                self.unseen = self.most - self.least <= limit and (
                    expire is None or t - self.first_time < expire
                )
            if reacts:
                led.append(len(self.entries))
                self.entries.append((t, v))
        while lows:
            t0, v0, given, members = lows[0]
            if expire is not None and t - t0 >= expire:
                pass
            elif v - v0 > limit and not (strict and t <= t0):
                may_alert = True
            else:
                break
            lows.popleft()
            led = _joined(led, members)
            reacts = True
            if not given:
                needed.append((t0, v0))
        while lows and lows[-1][1] > v and not (strict and t <= lows[-1][0]):
            led = _joined(led, lows.pop()[3])
            reacts = True
        if strict and may_alert:
            # Lows of this very instant do not react, and only they can tell so.
            same = []
            while lows and lows[-1][0] == t and not lows[-1][2]:
                same.append(lows.pop())
            needed += [low[:2] for low in same]
            lows.extend((*low[:2], True, low[3]) for low in reversed(same))
        if reacts:
            # Where lows never expire only their value matters, and equal values are one low.
            known = expire is None and lows and lows[-1][1] == v
            if known or may_alert:
                needed.append((t, v))
            if known:
                lows[-1] = (*lows[-1][:3], _joined(lows[-1][3], led))
            else:
                lows.append((t, v, may_alert, led))
        return needed

    def rest(self) -> list:
        """The lows still possible, where not given out yet."""
        return [(t, v) for t, v, given, _ in self.lows if not given]

    def settled(self):
        """The low (time, value), once only one is possible."""
        return self.lows[0][:2] if not self.unseen and len(self.lows) == 1 else None

    def leaving(self) -> list:
        """Per entry its reading and the low it has led to: (low time, low value, time, value)."""
        return [(t0, v0, *self.entries[i]) for t0, v0, _, members in self.lows for i in members]


def _joined(some: list, others: list) -> list:
    """Both lists in the larger one."""
    if len(some) < len(others):
        some, others = others, some
    some.extend(others)
    return some


def rise_alerts(
    readings: DataFrame,
    keys: list[str],
    *,
    threshold: float,
    expire: str | None = None,
    strict_time: bool = False,
    ts: str = "_timestamp",
    value: str = "value",
    partitions: int | None = None,
) -> DataFrame:
    """Alerts of every series: ``keys, min_ts, min_value, max_ts, max_value``.

    Per series, in (ts, value) order, a low starts at the first reading, follows the values down, and is
    moved to each reading that stands more than ``threshold`` above it, which is an alert.  ``expire`` is an
    interval such as "1 hour".  Without it ``min_ts`` is null, since equal lows are not told apart.
    Rows without a usable time or value take no part.
    """
    expire_us = None if expire is None else pd.Timedelta(expire).value // 1000
    rise = Rise(float(threshold), expire_us, strict_time)
    names = _names(keys)
    ranges = _ranges(readings, keys, names, ts, value, partitions)
    settled = _settled_alerts(ranges, names, rise, counted=False)
    min_ts = F.timestamp_micros("t0") if expire else F.lit(None).cast("timestamp")
    return settled.select(
        *_restored(readings, keys, names),
        min_ts.alias("min_ts"),
        F.col("v0").alias("min_value"),
        F.timestamp_micros("t1").alias("max_ts"),
        F.col("v1").alias("max_value"),
    )


def rise_steps(
    readings: DataFrame,
    keys: list[str],
    *,
    threshold: float,
    expire: str | None = None,
    strict_time: bool = False,
    ts: str = "_timestamp",
    value: str = "value",
    partitions: int | None = None,
) -> DataFrame:
    """Alerts and closing lows of every series, for a caller that goes on later:
    ``keys, closing, low_ts, low_value, max_ts, max_value``.

    One row per alert, as in ``rise_alerts``, and one with ``closing`` true per series, which holds the low
    that the series stands at after its last reading.
    """
    expire_us = None if expire is None else pd.Timedelta(expire).value // 1000
    rise = Rise(float(threshold), expire_us, strict_time)
    names = _names(keys)
    ranges = _ranges(readings, keys, names, ts, value, partitions)
    settled = _settled_alerts(ranges, names, rise, counted=False, closing=True)
    return settled.select(
        *_restored(readings, keys, names),
        (F.col("kind") == CLOSING).alias("closing"),
        F.timestamp_micros("t0").alias("low_ts"),
        F.col("v0").alias("low_value"),
        F.timestamp_micros("t1").alias("max_ts"),
        F.col("v1").alias("max_value"),
    )


def rise_counts(
    readings: DataFrame,
    keys: list[str],
    *,
    threshold: float,
    ts: str = "_timestamp",
    value: str = "value",
    partitions: int | None = None,
) -> DataFrame:
    """Series with at least one alert: ``keys, alerts, n_values, first_ts, last_ts``.

    Alerts and sizes come out of the same scan of the ranges, as one row per series and range at most for
    each; both are added up before their own shuffle.
    """
    names = _names(keys)
    ranges = _ranges(readings, keys, names, ts, value, partitions)
    marks = _settled_alerts(ranges, names, Rise(float(threshold)), counted=True)
    is_size = F.col("kind") == SIZE
    sums = (
        marks.groupBy(*names)
        .agg(
            F.coalesce(F.sum(F.when(~is_size, F.col("n"))), F.lit(0)).alias("alerts"),
            F.sum(F.when(is_size, F.col("n"))).alias("n_values"),
            F.min(F.when(is_size, F.col("t0"))).alias("t0"),
            F.max(F.when(is_size, F.col("t1"))).alias("t1"),
        )
        .where(F.col("alerts") > 0)
    )
    return sums.select(
        *_restored(readings, keys, names),
        F.col("alerts").cast("int").alias("alerts"),
        "n_values",
        F.timestamp_micros("t0").alias("first_ts"),
        F.timestamp_micros("t1").alias("last_ts"),
    )


def rise_folds(
    readings: DataFrame,
    keys: list[str],
    *,
    threshold: float,
    ts: str = "_timestamp",
    value: str = "value",
    partitions: int | None = None,
) -> DataFrame:
    """What the fold over each series comes to, for a caller that goes on with later readings:
    ``keys, alerts, low_value, n_values, first_ts, last_ts``.

    A series that is later continued by its low, put before the new readings, gives the alerts that follow.
    """
    names = _names(keys)
    ranges = _ranges(readings, keys, names, ts, value, partitions)
    marks = _settled_alerts(ranges, names, Rise(float(threshold)), counted=True, closing=True)
    kind = F.col("kind")
    sums = marks.groupBy(*names).agg(
        F.coalesce(F.sum(F.when(kind == ALERT, F.col("n"))), F.lit(0)).alias("alerts"),
        F.max(F.when(kind == CLOSING, F.col("v0"))).alias("low_value"),
        F.sum(F.when(kind == SIZE, F.col("n"))).alias("n_values"),
        F.min(F.when(kind == SIZE, F.col("t0"))).alias("t0"),
        F.max(F.when(kind == SIZE, F.col("t1"))).alias("t1"),
    )
    return sums.select(
        *_restored(readings, keys, names), F.col("alerts").cast("int").alias("alerts"), "low_value", "n_values",
        F.timestamp_micros("t0").alias("first_ts"), F.timestamp_micros("t1").alias("last_ts"),
    )


def _settled_alerts(
    ranges: DataFrame, names: list[str], rise: Rise, counted: bool, closing: bool = False
) -> DataFrame:
    """The two passes.  ``counted``: one mark per run of readings with the number of its alerts in ``n``, and
    one with its size.  ``closing``: also one mark per series with its last low."""
    schema = _mark_schema(ranges, names)
    arrow = to_arrow_schema(schema)

    def counts(alerts: list) -> list:
        """The last alert of a run and how many there were."""
        return [(*alerts[-1], len(alerts))] if counted and alerts else [(*a, 1) for a in alerts]

    def sizes(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        """Number of readings and first and last instant of each run."""
        runs = list(_runs(batch, names))
        if not runs:
            return []
        starts = pa.array([start for _, start, _ in runs])
        lasts = pa.array([end - 1 for _, _, end in runs])
        first, last = batch.take(starts), batch.take(lasts)
        columns = [pa.array([SIZE] * len(runs)), *[first[k] for k in names], first["t"], first["v"], last["t"],
                   last["v"], pc.add(pc.subtract(lasts, starts), 1)]
        return [pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, low, possible = None, None, None
        last = None  # the newest reading, to place the closing carry
        headed = False  # whether the series at hand is the range's first
        place = TaskContext.get().partitionId()  # ranges are numbered in order

        def pass_on(out: _Marks) -> None:
            if possible is not None:
                out.add(PENDING, current, [(0, 0.0, t, v, place) for t, v in possible.rest()])
                out.add(ENTRY, current, [(*row, place) for row in possible.leaving()])

        for batch in batches:
            out, found = _Marks(arrow, names), []
            times, values = batch["t"].to_numpy().tolist(), batch["v"].to_numpy().tolist()
            for key, start, end in _runs(batch, names):
                if key != current:
                    if current is None:
                        possible, headed = PossibleLows(rise, times[start]), True
                    else:
                        pass_on(out)
                        if possible is None and (closing or headed):
                            out.add(CARRY, current, [(*low, *last, place)])
                        headed = False
                        possible, low = None, (times[start], values[start])
                    current = key
                last = (times[end - 1], values[end - 1])
                if possible is not None:
                    needed = []
                    while start < end and possible is not None:
                        needed += possible.add(times[start], values[start])
                        start += 1
                        low = possible.settled()
                        if low is not None:
                            needed += possible.rest()
                            possible = None
                    out.add(PENDING, key, [(0, 0.0, t, v, place) for t, v in needed])
                if start < end:
                    alerts: list = []
                    low = rise.follow(low, times[start:end], values[start:end], alerts, start)
                    found += counts(alerts)
            yield from out.batch()
            if counted:
                yield from sizes(batch)
            if found:
                at, t0, v0, n = zip(*found)
                rows = batch.take(pa.array(at))
                columns = [pa.array([ALERT] * len(at)), *[rows[k] for k in names],
                           pa.array(t0), pa.array(v0), rows["t"], rows["v"], pa.array(n)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(field.type) for c, field in zip(columns, arrow)], schema=arrow
                )
        if current is not None:
            out = _Marks(arrow, names)
            pass_on(out)
            if possible is None:
                out.add(CARRY, current, [(*low, *last, place)])
            yield from out.batch()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ordered pass over the ranges' tables: the low that enters each range."""
        current, place, low, leaving = None, None, None, None

        def step(t1: int, v1: float, t0: int, v0: float) -> None:
            """An entry of the range: the first one that the low reacts to says what it leaves as."""
            nonlocal leaving
            if leaving is None and (low is None or rise.reacts(low, t1, v1)):
                leaving = (t0, v0)

        def close(out: _Marks) -> None:
            if closing and (leaving or low) is not None:
                out.add(CLOSING, current, [(*(leaving or low), *(leaving or low), 0)])

        for final, marks in _split(batches, SERIAL):
            yield from final
            out = _Marks(arrow, names)
            kinds, rows = _mark_rows(marks)
            for key, start, end in _runs(marks, names):
                if key != current:
                    if current is not None:
                        close(out)
                    current, place, low, leaving = key, None, None, None
                for kind, (t0, v0, t1, v1, n) in zip(kinds[start:end], rows[start:end]):
                    if n != place:
                        place, low, leaving = n, leaving or low, None
                        out.add(ENTER, key, [(*(low or (0, 0.0)), 0, 0.0, n) if low else (_FIRST, 0.0, 0, 0.0, n)])
                    if kind == CARRY:
                        leaving = (t0, v0)
                    else:
                        step(t1, v1, t0, v0)
            yield from out.batch()
        out = _Marks(arrow, names)
        if current is not None:
            close(out)
        yield from out.batch()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each range's pending readings from the low that enters it."""
        current, low = None, None
        for final, marks in _split(batches, (ENTER, PENDING)):
            yield from final
            out = _Marks(arrow, names)
            kinds, rows = _mark_rows(marks)
            for key, start, end in _runs(marks, [*names, "n"]):
                if key != current:
                    current, low = key, None
                found: list = []
                for kind, (t0, v0, t1, v1, _) in zip(kinds[start:end], rows[start:end]):
                    if kind == ENTER:
                        low = None if t0 == _FIRST else (t0, v0)
                    elif low is None:
                        low = (t1, v1)
                    else:
                        alerts: list = []
                        low = rise.follow(low, (t1,), (v1,), alerts)
                        found += [(t, v, t1, v1, 1) for _, t, v in alerts]
                out.add(ALERT, key[:-1], found)
            yield from out.batch()

    marks = _ordered(ranges, names).mapInArrow(scan, schema)
    small = SERIAL_ROWS >= 0 and estimated_bytes(ranges) <= SMALL_BYTES
    if not small:  # only then is it worth a look at how many entries there are
        marks, found = stage_counting(marks, "rises", {"entries": F.count_if(F.col("kind") == ENTRY)})
        small = found["entries"] <= SERIAL_ROWS
    if small:
        entered = _spread(marks, names, SERIAL, names, ["n", "t1", "v1"]).mapInArrow(enter, schema)
    else:
        entered = _entered(marks, names, rise, schema, closing)
    return _spread(entered, names, (ENTER, PENDING), ["n"], [*names, F.col("kind") != ENTER, "t1", "v1"]).mapInArrow(
        settle, schema
    )


def _entered(marks: DataFrame, names: list[str], rise: Rise, schema: T.StructType, closing: bool) -> DataFrame:
    """What the ordered pass gives, by pointer jumping: see ``operators.prefix``.

    Of the series that lie in one range, any number, only their own rows tell the low; those in several
    are at most as many as ranges.
    """
    kind = F.col("kind")
    serial = marks.where(kind.isin(*SERIAL))
    spans = serial.groupBy(*names).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    several = F.broadcast(spans.where("lo < hi").select(*(F.col(n).alias(f"s_{n}") for n in names)))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"s_{n}"))
    tables = serial.join(several, same, "left_semi").select(
        *names, F.col("n").alias("place"), (kind == CARRY).alias("sure"), "t1", "v1", "t0", "v0"
    )
    places, taken = prefix.paths(tables, names, prefix.Reaction(rise.threshold, rise.expire_us, rise.strict_time))
    rows = []
    for series, place in places:
        before = [low for low in taken[series] if low[0] < place]
        rows.append((ENTER, *series, *(before[-1][1:] if before else (_FIRST, 0.0)), 0, 0.0, place))
    if closing:
        rows += [(CLOSING, *series, *lows[-1][1:], *lows[-1][1:], 0) for series, lows in taken.items()]
    found = marks.sparkSession.createDataFrame(rows, schema)

    def marked(number: int, low: list, high: list, place: Column) -> list[Column]:
        columns = [F.lit(number).alias("kind"), *map(F.col, names), *low, *high, place.alias("n")]
        return [c.cast(f.dataType).alias(f.name) for c, f in zip(columns, schema)]

    zero = [F.lit(0), F.lit(0.0)]
    alone = serial.join(several, same, "left_anti")
    first = [F.lit(_FIRST), F.lit(0.0)]
    begun = alone.where(kind == ENTRY).select(*names, "n").distinct().select(*marked(ENTER, first, zero, F.col("n")))
    out = marks.where(~kind.isin(*SERIAL)).unionByName(found).unionByName(begun)
    if closing:
        low = F.min_by(F.struct("t0", "v0"), F.struct("t1", "v1")).alias("low")
        last = [F.col("low.t0"), F.col("low.v0")]
        out = out.unionByName(alone.groupBy(*names).agg(low).select(*marked(CLOSING, last, last, F.lit(0))))
    return out


def rising_alerts(
    readings: DataFrame,
    keys: list[str],
    *,
    threshold: float,
    ts: str = "_timestamp",
    value: str = "value",
    partitions: int | None = None,
) -> DataFrame:
    """Rising-prefix alerts of every series: ``keys, alert, max_ts, max_value, prefix_length``.

    The level starts at the lowest value of the whole series; a reading at least ``threshold`` above it is
    an alert and the new level.  The alert's readings are the first ``prefix_length`` ones of the series in
    (ts, value) order; they are counted here, not repeated per alert.

    Only a reading above all earlier ones can alert, so of a series that may reach into other ranges just
    those are passed on, with the range's row count and lowest value.
    """
    limit = float(threshold)
    names = _names(keys)
    ranges = _ranges(readings, keys, names, ts, value, partitions)
    schema = _mark_schema(ranges, names)
    arrow = to_arrow_schema(schema)

    def climb(level: float, alert: int, before: int, highs: list):
        """Alerts among a series' highs (time, value, position), and where that leaves level and count."""
        alerts = []
        for t, v, n in highs:
            if v - level >= limit:
                level = v
                alert += 1
                alerts.append((alert, 0.0, t, v, before + n))
        return level, alert, alerts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, count, least, most, last = None, True, 0, 0.0, 0.0, None
        highs: list = []  # of the current series in this range

        def pass_on(out: _Marks) -> None:
            out.add(LOWEST, current, [(0, least, _FIRST, least, 0)])
            out.add(PENDING, current, [(0, 0.0, *high) for high in highs])
            out.add(CARRY, current, [(0, 0.0, *last, count)])

        for batch in batches:
            out = _Marks(arrow, names)
            times, values = batch["t"], batch["v"].to_numpy()
            for key, start, end in _runs(batch, names):
                if key != current:
                    if current is not None and first:
                        pass_on(out)
                        first = False
                    elif current is not None:
                        # Neither first nor last in its range, so the series is whole.
                        out.add(ALERT, current, climb(least, 0, 0, highs)[2])
                    current, count, least, most, highs = key, 0, float("inf"), float("-inf"), []
                run = values[start:end]
                tops = np.maximum.accumulate(np.concatenate(([most], run)))
                new = np.flatnonzero(tops[1:] > tops[:-1]).tolist()
                highs += [(times[start + i].as_py(), float(run[i]), count + i + 1) for i in new]
                count += end - start
                least, most = min(least, float(run.min())), float(tops[-1])
                last = (times[end - 1].as_py(), float(run[-1]))
            yield from out.batch()
        if current is not None:
            out = _Marks(arrow, names)
            pass_on(out)
            yield from out.batch()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, level, before, alert = None, None, 0, 0
        for final, marks in _split(batches, (PENDING, CARRY, LOWEST)):
            yield from final
            out = _Marks(arrow, names)
            kinds, rows = _mark_rows(marks)
            for key, start, end in _runs(marks, names):
                if key != current:
                    current, level, before, alert = key, None, 0, 0
                for kind, (_, v0, t1, v1, n) in zip(kinds[start:end], rows[start:end]):
                    if kind == LOWEST:
                        level = v0 if level is None else min(level, v0)
                    elif kind == CARRY:
                        before += n
                    else:
                        level, alert, alerts = climb(level, alert, before, [(t1, v1, n)])
                        out.add(ALERT, key, alerts)
            yield from out.batch()

    settled = _by_series(_ordered(ranges, names).mapInArrow(scan, schema), names).mapInArrow(settle, schema)
    return settled.select(
        *_restored(readings, keys, names),
        F.col("t0").alias("alert"),
        F.timestamp_micros("t1").alias("max_ts"),
        F.col("v1").alias("max_value"),
        F.col("n").alias("prefix_length"),
    )


def _names(keys: list[str]) -> list[str]:
    return [f"k{i}" for i in range(len(keys))]


def _plain(readings: DataFrame, key: str) -> Column:
    """A key column as Python tasks see it; instants travel as microseconds."""
    if isinstance(readings.schema[key].dataType, T.TimestampType):
        return F.unix_micros(key)
    return F.col(key)


def _restored(readings: DataFrame, keys: list[str], names: list[str]) -> list[Column]:
    instants = [isinstance(readings.schema[k].dataType, T.TimestampType) for k in keys]
    return [
        (F.timestamp_micros(n) if instant else F.col(n)).alias(k)
        for k, n, instant in zip(keys, names, instants)
    ]


def _ranges(readings, keys, names, ts, value, partitions) -> DataFrame:
    rows = readings.select(
        *[_plain(readings, k).alias(n) for n, k in zip(names, keys)],
        F.unix_micros(ts).alias("t"),
        F.col(value).cast("double").alias("v"),
    ).where(F.col("t").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    order: list[Column | str] = [*names, "t", "v"]
    # Without a number adaptive execution may join small neighbouring ranges, which keeps the order.
    return rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)


def _ordered(ranges: DataFrame, names: list[str]) -> DataFrame:
    return ranges.sortWithinPartitions(*names, "t", "v")


def _spread(marks: DataFrame, names: list[str], kinds: tuple, by: list, order: list) -> DataFrame:
    """Marks of some kinds together by columns and in order; all others anywhere, ahead of them."""
    other = ~F.col("kind").isin(*kinds)
    place = F.when(other, F.xxhash64(*names, "t1", "v1")).otherwise(F.xxhash64(*by))
    # The others need no order and are not compared.
    columns = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    return marks.repartition(place).sortWithinPartitions(other.desc(), *[F.when(~other, c) for c in columns])


def _by_series(marks: DataFrame, names: list[str]) -> DataFrame:
    """Pending rows and carries together by series and in order; alerts anywhere, ahead of them."""
    return _spread(marks, names, (PENDING, CARRY, LOWEST), names, ["t1", "v1", "kind"])


def _mark_schema(ranges: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([
        T.StructField("kind", T.IntegerType()),
        *[T.StructField(n, ranges.schema[n].dataType) for n in names],
        T.StructField("t0", T.LongType()),
        T.StructField("v0", T.DoubleType()),
        T.StructField("t1", T.LongType()),
        T.StructField("v1", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ])


class _Marks:
    """Rows for the second pass, gathered for one Arrow batch."""

    def __init__(self, schema: pa.Schema, names: list[str]):
        self.schema = schema
        self.names = names
        self.kinds: list = []
        self.keys: list = []
        self.rows: list = []

    def add(self, kind: int, key: tuple, rows: list) -> None:
        self.kinds += [kind] * len(rows)
        self.keys += [key] * len(rows)
        self.rows += rows

    def batch(self) -> list[pa.RecordBatch]:
        if not self.rows:
            return []
        columns = [self.kinds, *zip(*self.keys), *zip(*self.rows)]
        arrays = [pa.array(c, field.type) for c, field in zip(columns, self.schema)]
        return [pa.RecordBatch.from_arrays(arrays, schema=self.schema)]


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) per run of equal keys; a missing key equals itself."""
    size = batch.num_rows
    if size == 0:
        return
    new = np.zeros(size, dtype=bool)
    new[0] = True
    for name in names:
        column = batch[name]
        here, before = column.slice(1), column.slice(0, size - 1)
        # Null where either side is missing; then it is a new key unless both are.
        differs = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        missing = pc.not_equal(pc.is_null(here), pc.is_null(before)).to_numpy(zero_copy_only=False)
        new[1:] |= differs | missing
    starts = np.flatnonzero(new)
    first = batch.select(names).take(pa.array(starts))
    keys = zip(*[first[name].to_pylist() for name in names])
    yield from zip(keys, starts.tolist(), [*starts[1:].tolist(), size])


def _split(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
    """Per batch the rows of other kinds, which pass as they are, and those of these kinds."""
    for batch in batches:
        own = pc.is_in(batch["kind"], pa.array(kinds, batch["kind"].type))
        final = batch.filter(pc.invert(own))
        yield ([final] if final.num_rows else []), batch.filter(own)


def _mark_rows(batch: pa.RecordBatch) -> tuple[list, list]:
    return batch["kind"].to_pylist(), list(zip(*[batch[c].to_pylist() for c in _MARKS]))
