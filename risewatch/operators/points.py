"""Time-series points: ``measurement, tags, time, value``; time has millisecond precision.

A point's key is (measurement, tags, time), and a later point with the same key replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which points are stored.
WINDOW_ALERT = "icd_alert_lift_motor_temp"
STATEFUL_ALERT = "icd_stateful_alert"
STATEFUL_ALERT_TIME = "icd_stateful_alert_time"
RECORDED_TEMP = "icd_recorded_temp"
RECORDED_CHANNEL = "T_motTemp_Lft"
RETENTION_POLICY = "autogen"

POINT_COLUMNS = ["measurement", "tags", "time", "value"]


def _tags(job: str | None, cluster: str | None, **others: Column) -> Column:
    """Tags of a point; those without a value are left out."""
    named = {"jenkins_job": job, "cluster_id": cluster}
    pairs = [F.lit(part) for name, value in named.items() if value is not None for part in (name, value)]
    pairs += [part for name, value in others.items() for part in (F.lit(name), value)]
    without = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.when(F.col("truck").isNull(), without).otherwise(
        F.create_map(F.lit("truck"), F.col("truck"), *pairs)
    )


def _ms(ts: Column | str) -> Column:
    return F.timestamp_millis(F.unix_millis(ts))


def reading_points(readings: DataFrame, job: str | None = None, cluster: str | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """One point per reading, named after its channel."""
    return readings.select(
        F.col("channel").alias("measurement"),
        _tags(job, cluster).alias("tags"),
        _ms("_timestamp").alias("time"),
        F.col("value").cast("double").alias("value"),
        *keep,
    )


def window_alert_points(alerts: DataFrame, job: str | None = None, cluster: str | None = None,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """One point per window alert, at the time the log wrote its first message; further parts bring none."""
    return alerts.where("part = 0").select(
        F.lit(WINDOW_ALERT).alias("measurement"),
        _tags(job, cluster).alias("tags"),
        _ms("timestamp").alias("time"),
        F.col("alerts").cast("double").alias("value"),
        *keep,
    )


def stateful_alert_points(alerts: DataFrame, job: str | None = None, cluster: str | None = None,
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """Points of stateful alert messages: high, low, difference, rise time in ms, and one per measurement.

    One pass turns each message into all its points; only the first part of an alert brings its own four.
    """
    low, high = F.col("min"), F.col("max")
    whole = F.array(*_summary(low, high, job, cluster))
    empty = F.array().cast("array<struct<timestamp: timestamp, value: double>>")
    recorded = F.transform(
        F.coalesce("measurements", empty), lambda m: _recorded(m["timestamp"], m["value"], job, cluster)
    )
    found = F.concat(F.when(F.col("part") == 0, whole).otherwise(F.slice(whole, 1, 0)), recorded)
    return alerts.select(F.explode(found).alias("p"), *keep).select("p.*", *keep)


def alert_and_reading_points(alerts: DataFrame, recorded: DataFrame, job: str | None = None,
                             cluster: str | None = None) -> DataFrame:
    """The same points straight from stateful alerts (truck, min_ts, min_value, max_ts, max_value) and the
    readings of their look-backs (truck, time, value), without messages or lists between."""
    low = F.struct(F.col("min_ts").alias("timestamp"), F.col("min_value").alias("value"))
    high = F.struct(F.col("max_ts").alias("timestamp"), F.col("max_value").alias("value"))
    own = alerts.select(F.explode(F.array(*_summary(low, high, job, cluster))).alias("p"))
    readings = recorded.select(_recorded(F.col("time"), F.col("value"), job, cluster).alias("p"))
    return own.unionByName(readings).select("p.*")


def _point(measurement: str, tags: Column, at: Column, value: Column) -> Column:
    return F.struct(
        F.lit(measurement).alias("measurement"), tags.alias("tags"), _ms(at).alias("time"),
        value.cast("double").alias("value"),
    )


def _recorded(at: Column, value: Column, job: str | None, cluster: str | None) -> Column:
    return _point(RECORDED_TEMP, _tags(job, cluster, temp=F.lit(RECORDED_CHANNEL)), at, value)


def _summary(low: Column, high: Column, job: str | None, cluster: str | None) -> list[Column]:
    rise_ms = F.unix_millis(high["timestamp"]) - F.unix_millis(low["timestamp"])

    def point(measurement: str, tag: str, tag_value: str, at: Column, value: Column) -> Column:
        return _point(measurement, _tags(job, cluster, **{tag: F.lit(tag_value)}), at, value)

    return [
        point(STATEFUL_ALERT, "alert_mode", "max_alert", high["timestamp"], high["value"]),
        point(STATEFUL_ALERT, "alert_mode", "min_alert", low["timestamp"], low["value"]),
        point(STATEFUL_ALERT, "alert_mode", "diff_temp", high["timestamp"], high["value"] - low["value"]),
        point(STATEFUL_ALERT_TIME, "time_mode", "rise_time", high["timestamp"], rise_ms),
    ]


def latest_points(points: DataFrame, version: str) -> DataFrame:
    """One point per key, the one with the highest version."""
    tag_list = F.sort_array(F.map_entries("tags")).alias("tag_list")
    keyed = points.select("measurement", tag_list, "time", "value", version)
    latest = keyed.groupBy("measurement", "tag_list", "time").agg(F.max_by("value", version).alias("value"))
    return latest.select("measurement", F.map_from_entries("tag_list").alias("tags"), "time", "value")


def history_of(points: DataFrame, channel: str) -> DataFrame:
    """Stored readings of one channel as look-back history: ``truck, time, value``."""
    return points.where(F.col("measurement") == channel).select(
        F.col("tags")["truck"].alias("truck"), "time", "value"
    )
