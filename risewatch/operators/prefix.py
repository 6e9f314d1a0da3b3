"""The low that enters each range of a series, by pointer jumping.

A range that cannot know the low it starts with gives a table: its *entries*, in order, and for each the low
that the series leaves the range with if a low from before first reacts to that entry.  A range that knows its
closing low gives just that.  Going through the tables one after the other finds the low that enters each
range, but it is one task per series.  Here the tables become a graph instead:

* nodes are the different lows that a range may leave;
* a node points at the node that its low becomes next.  Which later range first makes it react is read off the
  ranges' greatest and least values and last times, one row per range; which entry, by binary search in that
  range's table, all ranges at once;
* the lows that were really taken are those reached from the series' first.  Pointers are joined with
  themselves until they span all ranges (a logarithm of their number of rounds), and the path is then read off
  from the longest pointers to the shortest.

No task sees more than one range's table and a share of the lows that meet it.  What passes the driver are one
row per range and the path, which has at most one node per range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.operators.ordering import stage

#: Lows of one range beyond which they are dealt to several copies of its table.
LOWS_PER_TASK = 200_000


@dataclass(frozen=True)
class Reaction:
    """When a low (time, value) gives way: see ``operators.rises.Rise``."""

    threshold: float
    expire_us: int | None
    strict_time: bool


class _Ranges:
    """One series' ranges in order: what their entries reach."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["place"])
        self.places = np.array([r["place"] for r in rows])
        last = np.iinfo(np.int64).max
        sure = np.array([r["sure"] for r in rows], bool)
        # A range that any low reacts in counts as one that reaches everything.
        self.first = np.array([r["first"] for r in rows], np.int64)
        self.high = [np.where(sure, np.inf, [r["high"] for r in rows])]
        self.low = [np.where(sure, -np.inf, [r["low"] for r in rows])]
        self.until = [np.where(sure, last, np.array([r["until"] for r in rows], np.int64))]
        # The same without the entries at the range's first instant, which a low of that instant ignores.
        missing = lambda name, value: np.array([value if r[name] is None else r[name] for r in rows])
        self.high_after = np.where(sure, np.inf, missing("high_after", -np.inf))
        self.low_after = np.where(sure, -np.inf, missing("low_after", np.inf))
        size = 1
        while 2 * size <= len(rows):
            for table, join in ((self.high, np.maximum), (self.low, np.minimum), (self.until, np.maximum)):
                table.append(join(table[-1][: len(rows) - 2 * size + 1], table[-1][size : len(rows) - size + 1]))
            size *= 2

    def next_of(self, reaction: Reaction, place: np.ndarray, t0: np.ndarray, v0: np.ndarray) -> np.ndarray:
        """Per low the place of the first later range in which it reacts, -1 for none."""
        at = np.searchsorted(self.places, place, "right")
        open_ = np.arange(len(at))
        count = len(self.places)
        found = np.full(len(at), -1, np.int64)
        while len(open_):
            here, t, v = at[open_], t0[open_], v0[open_]
            for k in range(len(self.high) - 1, -1, -1):
                inside = here + (1 << k) <= count
                block = np.where(inside, here, 0)
                block = np.minimum(block, len(self.high[k]) - 1)
                calm = inside & ~_reaches(reaction, self.high[k][block], self.low[k][block], self.until[k][block], t, v)
                here = here + np.where(calm, 1 << k, 0)
            met = here < count
            open_, here, t, v = open_[met], here[met], t[met], v[met]
            real = np.ones(len(open_), bool)
            if reaction.strict_time:
                same = self.first[here] == t
                real = ~same | _reaches(reaction, self.high_after[here], self.low_after[here], self.until[0][here], t, v)
            found[open_[real]] = self.places[here[real]]
            at[open_] = here + 1
            open_ = open_[~real]
        return found


def _reaches(reaction: Reaction, high, low, until, t0, v0) -> np.ndarray:
    found = (high - v0 > reaction.threshold) | (low < v0)
    return found if reaction.expire_us is None else found | (until - t0 >= reaction.expire_us)


def first_reacting(reaction: Reaction, times: np.ndarray, values: np.ndarray, t0: np.ndarray, v0: np.ndarray) -> np.ndarray:
    """Per low the position of the first entry (ordered by time) that it reacts to; their number for none."""
    count = len(times)
    found = np.full(len(t0), count)
    skipped = int(np.searchsorted(times, times[0], "right")) if reaction.strict_time else 0
    for start, chosen in ((0, t0 < times[0]), (skipped, t0 >= times[0])) if reaction.strict_time else ((0, np.ones(len(t0), bool)),):
        if not chosen.any() or start == count:
            continue
        v = v0[chosen]
        highs, lows = np.maximum.accumulate(values[start:]), np.minimum.accumulate(values[start:])
        size = len(highs)
        up = np.searchsorted(highs, v + reaction.threshold, "right")
        # The sum may have been rounded; what counts is the difference.
        while (back := (up > 0) & (highs[np.maximum(up, 1) - 1] - v > reaction.threshold)).any():
            up = up - back
        while (on := (up < size) & ~(highs[np.minimum(up, size - 1)] - v > reaction.threshold)).any():
            up = up + on
        down = np.searchsorted(-lows, -v, "right")
        first = np.minimum(up, down) + start
        found[chosen] = np.where(first < count, first, count)
    if reaction.expire_us is not None:
        found = np.minimum(found, np.searchsorted(times, t0 + reaction.expire_us, "left"))
    return found


def paths(tables: DataFrame, names: list[str], reaction: Reaction) -> tuple[list, dict]:
    """The ranges of all series in ``tables`` and the lows really taken.

    ``tables``: names, place, sure, t1, v1 (the entry), t0, v0 (the low it leads to); a ``sure`` row is a
    range's closing low.  Gives the ranges, one row each with its names and place, and per series (a tuple) its
    lows [(place, time, value)] in order.
    """
    spark = tables.sparkSession
    first = tables.groupBy(*names, "place").agg(F.min("t1").alias("start"))
    summary = tables.join(first.withColumnsRenamed({n: f"f_{n}" for n in names}).withColumnRenamed("place", "f_place"),
                          _same(names) & (F.col("place") == F.col("f_place")))
    after = F.when(F.col("t1") > F.col("start"), F.col("v1"))
    ranges = summary.groupBy(*names, "place").agg(
        F.max("v1").alias("high"), F.min("v1").alias("low"), F.max("t1").alias("until"), F.min("t1").alias("first"),
        F.max(after).alias("high_after"), F.min(after).alias("low_after"), F.bool_or("sure").alias("sure"),
        F.min_by(F.struct("t0", "v0"), F.struct("t1", "v1")).alias("start"),
    ).collect()  # one row per range of a series that has several
    by_series: dict = {}
    for row in ranges:
        by_series.setdefault(tuple(row[n] for n in names), []).append(row)
    reach = spark.sparkContext.broadcast({k: _Ranges(v) for k, v in by_series.items()})

    nodes = tables.select(*names, "place", "t0", "v0").distinct()
    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "place", "t0", "v0"])

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for series, rows in _grouped(frame, names):
                target = reach.value[series].next_of(reaction, rows["place"].to_numpy(), rows["t0"].to_numpy(), rows["v0"].to_numpy())
                rows = rows.assign(target=target)
                yield rows[target >= 0]

    asking = stage(nodes.mapInPandas(route, f"{schema}, target bigint"), "rise-routes")
    counts = asking.groupBy(*names, "target").count().where(F.col("count") > LOWS_PER_TASK)
    copies = {(*(r[n] for n in names), r["target"]): -(-r["count"] // LOWS_PER_TASK) for r in counts.collect()}
    copied = spark.sparkContext.broadcast(copies)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Table rows once per copy of their range, lows to one of the copies."""
        for frame in frames:
            number = [copied.value.get((*k, p), 1) for k, p in zip(_keys(frame, names), frame["at"].tolist())]
            if frame["low"].iloc[0]:
                spread = pd.util.hash_array(frame["t0"].to_numpy()).astype(np.int64) & 0x7FFFFFFF
                yield frame.assign(copy=spread % np.array(number))
            else:
                again = np.repeat(np.arange(len(frame)), number)
                yield frame.iloc[again].assign(copy=np.concatenate([np.arange(n) for n in number]) if number else [])

    # Numbers rather than nulls, which pandas would turn into floats.
    none = F.lit(0)
    entries = tables.select(*names, F.col("place").alias("at"), F.lit(False).alias("low"), "t1", "v1", "t0", "v0", "sure", none.cast("bigint").alias("place"))
    lows = asking.select(*names, F.col("target").alias("at"), F.lit(True).alias("low"), none.cast("bigint").alias("t1"),
                         none.cast("double").alias("v1"), "t0", "v0", F.lit(False).alias("sure"), "place")
    row = ", ".join(f"{n} {kinds[n]}" for n in names) + ", at bigint, low boolean, t1 bigint, v1 double, t0 bigint, v0 double, sure boolean, place bigint, copy bigint"
    met = entries.mapInPandas(dealt, row).unionByName(lows.mapInPandas(dealt, row))
    group = [*names, "at", "copy"]
    met = met.repartition(*group).sortWithinPartitions(*group, "low", "t1", "v1")
    edge = ", ".join(f"{n} {kinds[n]}" for n in names) + ", place bigint, t0 bigint, v0 double, next_place bigint, next_t0 bigint, next_v0 double"

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, table = None, []
        for frame in frames:
            for group_key, rows in _grouped(frame, group):
                if group_key != current:
                    current, table = group_key, []
                own = rows[~rows["low"].astype(bool)]
                if len(own):
                    table.append(own)
                asked = rows[rows["low"].astype(bool)]
                if not len(asked):
                    continue
                if len(table) > 1:
                    table = [pd.concat(table)]
                times, values = table[0]["t1"].to_numpy(np.int64), table[0]["v1"].to_numpy(np.float64)
                if table[0]["sure"].iloc[0]:
                    at = np.zeros(len(asked), np.int64)
                else:
                    at = first_reacting(reaction, times, values, asked["t0"].to_numpy(np.int64), asked["v0"].to_numpy(np.float64))
                led = table[0].iloc[at]
                yield pd.DataFrame({
                    **{n: asked[n].to_numpy() for n in names}, "place": asked["place"].to_numpy(np.int64), "t0": asked["t0"].to_numpy(), "v0": asked["v0"].to_numpy(),
                    "next_place": asked["at"].to_numpy(), "next_t0": led["t0"].to_numpy(), "next_v0": led["v0"].to_numpy(),
                })

    node = F.struct(*names, "place", "t0", "v0")
    after_node = F.struct(*names, F.col("next_place").alias("place"), F.col("next_t0").alias("t0"), F.col("next_v0").alias("v0"))
    edges = stage(met.mapInPandas(meet, edge).select(node.alias("node"), after_node.alias("next")), "rise-pointers")

    starts = []
    for series, rows in by_series.items():
        begin = min(rows, key=lambda r: r["place"])
        starts.append((*series, begin["place"], begin["start"]["t0"], begin["start"]["v0"]))
    path = {s: None for s in starts}
    most = max((len(v) for v in by_series.values()), default=0)
    # A node that nothing points at is on no path, but for the series' first.
    met_nodes = edges.select(F.col("next").alias("node")).unionByName(
        spark.createDataFrame(starts, schema).select(node.alias("node"))).distinct()
    pointers = [stage(edges.join(met_nodes, "node", "left_semi"), "rise-pointers")]
    while 1 << len(pointers) < most:
        one = pointers[-1]
        two = one.join(one.select(F.col("node").alias("next"), F.col("next").alias("beyond")), "next").select("node", F.col("beyond").alias("next"))
        pointers.append(stage(two, "rise-pointers"))
    for far in reversed(pointers):
        on = spark.createDataFrame(list(path), schema).select(F.struct(*names, "place", "t0", "v0").alias("node"))
        for row in far.join(F.broadcast(on), "node", "left_semi").select("next.*").collect():
            path[tuple(row)] = None
    taken: dict = {}
    for *series, place, t0, v0 in path:
        taken.setdefault(tuple(series), []).append((place, t0, v0))
    return [(s, r["place"]) for s, rows in by_series.items() for r in rows], {k: sorted(v) for k, v in taken.items()}


def _same(names: list[str]):
    found = F.lit(True)
    for n in names:
        found = found & F.col(n).eqNullSafe(F.col(f"f_{n}"))
    return found


def _keys(frame: pd.DataFrame, names: list[str]) -> list[tuple]:
    columns = [frame[n].astype(object).where(frame[n].notna(), None).tolist() for n in names]
    return list(zip(*columns))


def _grouped(frame: pd.DataFrame, names: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key, missing ones included, keys as they first appear and rows in the frame's order."""
    if not len(frame):
        return
    number = frame.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(number, kind="stable")
    frame = frame.iloc[order]
    starts = np.flatnonzero(np.diff(number[order], prepend=-1))
    keys = _keys(frame.iloc[starts], names)
    for key, start, end in zip(keys, starts, [*starts[1:], len(frame)]):
        yield key, frame.iloc[start:end]
