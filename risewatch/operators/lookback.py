"""The readings of the hour before each alert.

History is ``truck, time, value``, one row per (truck, time).  Time is cut into buckets as long as the
look-back, so the interval up to an alert touches just the alert's bucket and the one before.  Totals run
within a bucket, and a bucket may hold any number of readings: rows are cut into ranges of (truck, bucket,
time) that Spark sizes by sampling, totals run within each range, and what the other ranges of a bucket hold is
added from a table of the buckets that lie in several ranges, at most one per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risewatch.operators.alerts import parts_of, sample
from risewatch.operators.ordering import positions, stage

# In the order of one instant: a look-back begins, its readings, a look-back ends.
_BEGIN, _HISTORY, _END = -1, 0, 1


def _bucket(us: Column, length: int) -> Column:
    return F.floor(us / length).cast("bigint")


def _history(history: DataFrame, length: int) -> DataFrame:
    us = F.unix_micros("time")
    return history.where(F.col("time").isNotNull()).select(
        "truck", _bucket(us, length).alias("bucket"), us.alias("at"), "value"
    )


def _ranges(marks: DataFrame, name: str) -> DataFrame:
    """Marks with the number of their range, ``slice``, written out so that all passes see the same ranges."""
    placed = marks.repartitionByRange("truck", "bucket", "at", "kind", "value")
    return stage(placed.withColumn("slice", F.spark_partition_id()), name)


def _forward():
    """From the first row of a bucket's part in a range up to each row."""
    return Window.partitionBy("slice", "truck", "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _backward():
    """From the last row down to each row."""
    return Window.partitionBy("slice", "truck", "bucket").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from_other_ranges(ranges: DataFrame, sums: dict[str, Column], earlier: dict[str, Column], later: dict[str, Column]) -> DataFrame:
    """Per (truck, bucket, slice) of the buckets in several ranges: what the ranges before and after hold.

    ``sums`` are taken per range, and ``earlier`` and ``later`` are aggregates over them.  A range shares
    its first and last bucket at most, so the rows are no more than twice the ranges.
    """
    parts = ranges.groupBy("truck", "bucket", "slice").agg(*(c.alias(n) for n, c in sums.items()))
    bucket = Window.partitionBy("truck", "bucket")
    before = bucket.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    after = bucket.orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shared = parts.select(
        F.col("truck").alias("o_truck"), F.col("bucket").alias("o_bucket"), F.col("slice").alias("o_slice"),
        F.count(F.lit(1)).over(bucket).alias("ranges"),
        *(c.over(before).alias(f"earlier_{n}") for n, c in earlier.items()),
        *(c.over(after).alias(f"later_{n}") for n, c in later.items()),
    )
    return shared.where("ranges > 1")


def _with_other_ranges(rows: DataFrame, others: DataFrame) -> DataFrame:
    same = (
        F.col("truck").eqNullSafe(F.col("o_truck")) & (F.col("bucket") == F.col("o_bucket")) & (F.col("slice") == F.col("o_slice"))
    )
    return rows.join(F.broadcast(others), same, "left")


def lookback_stats(alerts: DataFrame, history: DataFrame, *, seconds: int = 3600) -> DataFrame:
    """Alerts with ``n, total, first_time, last_time`` of the readings in [max_ts - look-back, max_ts].

    The interval is the tail of one bucket and the head of the next, so running totals over each sorted
    bucket, read at the interval's ends, are all it takes.  Work is linear in readings plus alerts, and alerts
    themselves do not travel with the readings.
    """
    length = seconds * 1_000_000
    us = F.unix_micros("max_ts")
    ends = F.array(
        F.struct(F.col("until").alias("at"), F.lit(_END).alias("kind")),
        F.struct((F.col("until") - length).alias("at"), F.lit(_BEGIN).alias("kind")),
    )
    places = alerts.select("truck", us.alias("until")).distinct().select("truck", "until", F.explode(ends).alias("end")).select(
        "truck", _bucket(F.col("end.at"), length).alias("bucket"), "end.at", F.lit(None).cast("double").alias("value"), "end.kind", "until",
    )
    history = _history(history, length).withColumns({"kind": F.lit(_HISTORY), "until": F.lit(None).cast("bigint")})
    ranges = _ranges(history.unionByName(places), "look-back")
    row_time = F.when(F.col("kind") == _HISTORY, F.col("at"))
    total = F.coalesce(F.sum("value"), F.lit(0.0))
    sums = {"n": F.count(row_time), "total": total, "first": F.min(row_time), "last": F.max(row_time)}
    added = {"n": F.sum("n"), "total": F.sum("total"), "first": F.min("first"), "last": F.max("last")}
    others = _from_other_ranges(ranges, sums, added, added)

    def running(w, side: str):
        return F.struct(
            F.count(row_time).over(w).alias("n"), F.coalesce(F.sum("value").over(w), F.lit(0.0)).alias("total"),
            F.min(row_time).over(w).alias("first"), F.max(row_time).over(w).alias("last"),
        ).alias(side)

    halves = ranges.select(
        "truck", "bucket", "slice", "kind", "until", running(_forward(), "earlier"), running(_backward(), "later")
    ).where(F.col("kind") != _HISTORY)
    halves = _with_other_ranges(halves, others)

    def half(side: str) -> Column:
        return F.struct(
            (F.col(side)["n"] + F.coalesce(f"{side}_n", F.lit(0))).alias("n"),
            (F.col(side)["total"] + F.coalesce(f"{side}_total", F.lit(0.0))).alias("total"),
            F.least(F.col(side)["first"], f"{side}_first").alias("first"), F.greatest(F.col(side)["last"], f"{side}_last").alias("last"),
        )

    chosen = F.when(F.col("kind") == _END, half("earlier")).otherwise(half("later"))
    stats = halves.select(F.col("truck").alias("s_truck"), "until", chosen.alias("half")).groupBy("s_truck", "until").agg(
        F.sum("half.n").alias("n"), F.sum("half.total").alias("total"),
        F.timestamp_micros(F.min("half.first")).alias("first_time"), F.timestamp_micros(F.max("half.last")).alias("last_time"),
    )
    same = F.col("truck").eqNullSafe(F.col("s_truck")) & us.eqNullSafe(F.col("until"))
    return alerts.join(stats, same).drop("s_truck", "until")


def recorded_readings(alerts: DataFrame, history: DataFrame, *, seconds: int = 3600) -> DataFrame:
    """The readings that belong to at least one alert's look-back, each once:
    ``truck, time, value, alert_ts`` with the earliest such alert.

    That alert is the next one at or after the reading.  It lies in the reading's bucket or the one after,
    so every alert is put into its own bucket and the one before, and read off in descending time.
    """
    length = seconds * 1_000_000
    us = F.unix_micros("max_ts")
    none = F.lit(None).cast("double")
    own = _bucket(F.col("at"), length)
    ends = alerts.select("truck", us.alias("at")).distinct().select(
        "truck", "at", F.explode(F.array(own, own - 1)).alias("bucket")
    )
    marks = _history(history, length).withColumn("kind", F.lit(_HISTORY)).unionByName(
        ends.select("truck", "bucket", "at", none.alias("value"), F.lit(_END).alias("kind"))
    )
    ranges = _ranges(marks, "look-back")
    end = F.when(F.col("kind") != _HISTORY, F.col("at"))
    others = _from_other_ranges(ranges, {"end": F.min(end)}, {}, {"end": F.min("end")})
    upcoming = ranges.withColumn("in_range", F.min(end).over(_backward())).where(F.col("kind") == _HISTORY)
    return (
        _with_other_ranges(upcoming, others)
        .withColumn("alert_at", F.least("in_range", "later_end"))
        .where(F.col("alert_at") - F.col("at") <= length)
        .select(
            "truck",
            F.timestamp_micros("at").alias("time"),
            "value",
            F.timestamp_micros("alert_at").alias("alert_ts"),
        )
    )


def with_measurements(alerts: DataFrame, history: DataFrame, *, seconds: int = 3600) -> DataFrame:
    """Every alert with the full list of its look-back readings, in time order, empty where there are none.

    This is the message form, in which overlapping look-backs repeat readings.  Where that is not wanted,
    ``recorded_readings`` gives the same readings once each and ``lookback_stats`` their summary.
    """
    length = seconds * 1_000_000
    us = F.unix_micros("max_ts")
    asked = alerts.withColumn("us", us).withColumn(
        "bucket", F.explode(F.array(_bucket(F.col("us"), length), _bucket(F.col("us"), length) - 1))
    )
    rows = _history(history, length).withColumnsRenamed({"truck": "h_truck", "bucket": "h_bucket", "value": "h_value"})
    inside = (
        F.col("truck").eqNullSafe(F.col("h_truck"))
        & (F.col("bucket") == F.col("h_bucket"))
        & F.col("at").between(F.col("us") - length, F.col("us"))
    )
    found = F.when(F.col("at").isNotNull(), sample(F.timestamp_micros("at"), "h_value"))
    return (
        asked.join(rows, inside, "left")
        .groupBy(*alerts.columns)
        .agg(F.sort_array(F.collect_list(found)).alias("measurements"))
    )


def with_new_measurements(alerts: DataFrame, history: DataFrame, *, seconds: int = 3600) -> DataFrame:
    """Alerts with the look-back readings that no earlier alert has brought: ``measurements, part, parts``.

    Readings land in the point store under their own time, so sending each once gives the same points as
    repeating them.  An alert's readings go out in parts of ``PER_MESSAGE`` in time order, as those of a
    window do; an alert without any is one part with an empty list.
    """
    once = positions(
        recorded_readings(alerts, history, seconds=seconds), ["truck", "alert_ts"], [F.col("time")], "look-backs"
    )
    sizes = once.groupBy("truck", "alert_ts").agg(F.count(F.lit(1)).alias("n"))
    lists = (
        once.withColumn("part", parts_of("position", "position")["part"])
        .groupBy("truck", "alert_ts", "part")
        .agg(F.sort_array(F.collect_list(sample("time", "value"))).alias("list"))
    )

    def of_alert(name: str) -> Column:
        return F.col("truck").eqNullSafe(F.col(f"{name}_truck")) & (F.col("max_ts") == F.col(f"{name}_ts"))

    sizes = sizes.withColumnsRenamed({"truck": "n_truck", "alert_ts": "n_ts"})
    lists = lists.withColumnsRenamed({"truck": "l_truck", "alert_ts": "l_ts", "part": "l_part"})
    joined = alerts.join(sizes, of_alert("n"), "left").join(lists, of_alert("l"), "left")
    empty = F.array().cast("array<struct<timestamp: timestamp, value: double>>")
    return joined.select(
        *alerts.columns,
        F.coalesce("list", empty).alias("measurements"),
        F.coalesce("l_part", F.lit(0)).alias("part"),
        parts_of("n", "n")["parts"].alias("parts"),
    )
