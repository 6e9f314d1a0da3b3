"""Checks of a series against its neighbours and of readings against the channel dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risewatch.functions.channels import channel_table
from risewatch.operators.ordering import stage

TS = "_timestamp"


def with_neighbours(readings: DataFrame, key: str = "truck", *, value: str = "value") -> DataFrame:
    """Readings with ``prev`` and ``next``, the (ts, value) pairs before and after in their series.

    Readings are cut into ranges of (series, ts, value) that Spark sizes by sampling, so neither a long
    series nor a dense stretch of one sits in one task.  Only a range's first and last reading of a series
    have a neighbour elsewhere: the end of the range before or after, found among all range ends of the
    series, at most two per range.  The ranges are written out once, and both parts read them.  Readings
    without a series or an instant have no neighbours.
    """
    placed = F.col(key).isNotNull() & F.col(TS).isNotNull()
    # Both parts below must agree on which readings are ends, so ties are ordered by what else there is.
    others = [c for c in readings.columns if c not in (key, TS, value)]
    ranges = readings.where(placed).repartitionByRange(key, TS, value, *others)
    rows = stage(ranges.withColumn("slice", F.spark_partition_id()), "neighbours")

    def around(w):
        return [
            F.lag(TS).over(w).alias("prev_ts"), F.lag(value).over(w).alias("prev_value"),
            F.lead(TS).over(w).alias("next_ts"), F.lead(value).over(w).alias("next_value"),
        ]

    def pair(side: str):
        ts, of_value = F.col(f"{side}_ts"), F.col(f"{side}_value")
        return F.when(ts.isNotNull(), F.struct(ts.alias("ts"), of_value.alias("value")))

    in_slice = Window.partitionBy(key, "slice").orderBy(TS, value, *others)
    sliced = rows.select(*readings.columns, "slice", *around(in_slice))
    is_head, is_tail = F.col("prev_ts").isNull(), F.col("next_ts").isNull()
    sides = [pair("prev").alias("prev"), pair("next").alias("next")]
    inside = sliced.where(~is_head & ~is_tail).select(*readings.columns, *sides)
    ends = sliced.where(is_head | is_tail).select(
        *readings.columns, "slice", is_head.alias("head"), is_tail.alias("tail"), *sides
    )
    # Of a slice's two ends the head comes first, whatever their readings are.
    in_ends = Window.partitionBy(key).orderBy("slice", F.col("head").desc())
    outer = ends.select("*", *around(in_ends)).select(
        *readings.columns, "head", "tail", "prev", "next",
        pair("prev").alias("earlier"), pair("next").alias("later"),
    )
    found = inside.unionByName(outer.select(
        *readings.columns,
        F.when(F.col("head"), F.col("earlier")).otherwise(F.col("prev")).alias("prev"),
        F.when(F.col("tail"), F.col("later")).otherwise(F.col("next")).alias("next"),
    ))
    alone = readings.where(~placed).select(
        "*", *(F.lit(None).cast(found.schema[side].dataType).alias(side) for side in ("prev", "next"))
    )
    return found.unionByName(alone)


def without_spikes(
    readings: DataFrame,
    threshold: float,
    *,
    key: str = "truck",
    value: str = "value",
    send_all: bool = False,
) -> DataFrame:
    """Readings less than ``threshold`` away from both neighbours; a missing neighbour raises no objection."""
    if send_all:
        return readings
    rows = with_neighbours(readings, key, value=value)

    def near(side: str):
        return F.coalesce(F.abs(F.col(value) - F.col(f"{side}.value")) < F.lit(float(threshold)), F.lit(True))

    return rows.where(near("prev") & near("next")).select(*readings.columns)


def series_gaps(
    readings: DataFrame, threshold_ms: int, *, key: str = "truck", value: str = "value"
) -> DataFrame:
    """Readings with ``gap_ms`` since the one before (null for the first) and ``is_gap``, whether that is
    above the threshold; a threshold of 0 or less flags nothing."""
    rows = with_neighbours(readings, key, value=value)
    gap = F.unix_millis(TS) - F.unix_millis("prev.ts")
    flagged = F.coalesce(F.col("gap_ms") > threshold_ms, F.lit(False)) & F.lit(threshold_ms > 0)
    return rows.select(*readings.columns, gap.alias("gap_ms")).withColumn("is_gap", flagged)


def channel_range_check(readings: DataFrame) -> DataFrame:
    """Readings with ``range_status``: ok, low, high, unbounded (no range known), or unknown channel,
    and the dictionary's unit as ``expected_unit``."""
    # The dictionary has a fixed, small number of rows.
    known = F.broadcast(channel_table(readings.sparkSession).withColumnsRenamed({"unit": "expected_unit"}))
    rows = readings.join(known, "channel", "left")
    status = (
        F.when(F.col("min").isNull(), "unknown")
        .when((F.col("min") == 0) & (F.col("max") == 0), "unbounded")
        .when(F.col("value") < F.col("min"), "low")
        .when(F.col("value") > F.col("max"), "high")
        .otherwise("ok")
    )
    return rows.select(*readings.columns, "expected_unit", status.alias("range_status"))
