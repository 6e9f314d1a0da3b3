"""Window alerts and stateful alerts, and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.functions.rises import ordered_values, rise_count
from risewatch.functions.text import json_text
from risewatch.operators.ordering import positions
from risewatch.operators.rises import rise_alerts, rise_counts, rising_alerts

TS = "_timestamp"

#: Readings in one message.  More go out as further parts of the same alert.
PER_MESSAGE = 1000


def windowed(readings: DataFrame, window: str, slide: str | None = None) -> DataFrame:
    """``truck, window_start, _timestamp, value`` and what else there is; one row per window a reading is in."""
    # A filter before the window keeps it on the file scan.
    rows = readings.where(F.col(TS).isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    start = F.window(TS, window, slide or window)["start"]
    return rows.select(start.alias("window_start"), *readings.columns)


def window_end(window: str) -> Column:
    return (F.col("window_start") + F.expr(f"interval {window}")).alias("window_end")


def window_alerts(
    readings: DataFrame, threshold: float, window: str = "60 minutes", slide: str | None = None
) -> DataFrame:
    """Windows of a series with at least one rise alert:
    ``truck, window_start, window_end, alerts, n_values, first_ts, last_ts``.

    For tables: no window's readings are gathered in one place, however many there are.
    """
    rows = windowed(readings.select("truck", TS, "value"), window, slide)
    found = rise_counts(rows, ["truck", "window_start"], threshold=threshold)
    return found.select("truck", "window_start", window_end(window), "alerts", "n_values", "first_ts", "last_ts")


def window_alert_values(
    alerts: DataFrame,
    readings: DataFrame,
    window: str = "60 minutes",
    slide: str | None = None,
    *,
    spread_by: tuple[str, ...] = (TS, "value"),
) -> DataFrame:
    """Window alerts with their ``values`` in time order, ready to be encoded:
    ``truck, alert_time, alerts, values, part, parts``.

    A window's values go out in parts of ``PER_MESSAGE`` consecutive readings, numbered from 0, of which
    only the last may be shorter; every window is treated alike, and no task has to gather a large one.
    ``spread_by`` are columns that tell readings apart, such as the log offset, and order ties.
    """
    group = ["truck", "window_start"]
    extra = [c for c in spread_by if c not in (TS, "value")]
    rows = windowed(readings.select("truck", TS, "value", *extra), window, slide)
    found = alerts.select(F.col("truck").alias("t"), F.col("window_start").alias("w"), "alerts", "n_values")
    # A missing series name equals itself.
    same = F.col("truck").eqNullSafe(F.col("t")) & (F.col("window_start") == F.col("w"))
    rows = rows.join(found, same).drop("t", "w")
    placed = positions(rows, group, [F.col(c) for c in (TS, "value", *extra)], "window-values")
    return (
        placed.withColumns(parts_of("position", "n_values"))
        .groupBy(*group, "alerts", "part", "parts")
        .agg(ordered_values(TS, "value").alias("values"))
        .select(
            "truck",
            F.struct(F.col("window_start").alias("start"), window_end(window).alias("end")).alias("alert_time"),
            "alerts", "values", "part", "parts",
        )
    )


def parts_of(position: str, number: str) -> dict[str, Column]:
    """The part a position falls into, and how many parts there are; one even for nothing."""
    return {
        "part": F.floor(F.coalesce(position, F.lit(0)) / PER_MESSAGE).cast("int"),
        "parts": F.greatest(F.lit(1), F.ceil(F.coalesce(number, F.lit(0)) / PER_MESSAGE)).cast("int"),
    }


def live_window_alerts(
    readings: DataFrame,
    threshold: float,
    window: str = "60 minutes",
    slide: str | None = None,
    watermark: str | None = "60 minutes",
) -> DataFrame:
    """The same for streams (and for tables of bounded windows):
    ``processing_time, truck, alert_time, alerts, values``.

    The watermark bounds how many windows stay in state, the window bounds each one's readings.
    """
    rows = readings.where(F.col(TS).isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    if watermark is not None:
        rows = rows.withWatermark(TS, watermark)
    found = (
        rows.groupBy(F.window(TS, window, slide or window).alias("alert_time"), "truck")
        .agg(ordered_values(TS, "value").alias("values"))
        .withColumn("alerts", rise_count(F.col("values"), threshold))
        .where(F.col("alerts") > 0)
    )
    return found.select(F.current_timestamp().alias("processing_time"), "truck", "alert_time", "alerts", "values")


def stateful_alerts(readings: DataFrame, threshold: float, keys: tuple[str, ...] = ("truck",)) -> DataFrame:
    """Rises across windows: ``truck, min_ts, min_value, max_ts, max_value``.

    The low is given up once a reading comes a whole hour or more after it.
    """
    return rise_alerts(readings, list(keys), threshold=threshold, expire="1 hour", strict_time=True)


def rising_prefix_alerts(
    readings: DataFrame, threshold: float, window: str | None = None, slide: str | None = None
) -> DataFrame:
    """Rising-prefix alerts per series, or per series and window."""
    if window is None:
        return rising_alerts(readings, ["truck"], threshold=threshold)
    rows = windowed(readings.select("truck", TS, "value"), window, slide)
    return rising_alerts(rows, ["truck", "window_start"], threshold=threshold)


def _numbered(alerts: DataFrame) -> DataFrame:
    """Alerts that are whole are part 0 of 1."""
    if "part" in alerts.columns:
        return alerts
    return alerts.withColumns({"part": F.lit(0), "parts": F.lit(1)})


def encode_window_alerts(alerts: DataFrame) -> DataFrame:
    """``value``: one JSON message per window alert and part.

    Parts of one alert are equal but for ``values`` and ``part``; whoever counts alerts takes part 0.
    """
    if "processing_time" not in alerts.columns:
        alerts = alerts.withColumn("processing_time", F.current_timestamp())
    return _numbered(alerts).select(
        json_text("processing_time", "truck", "alert_time", "alerts", "values", "part", "parts").alias("value")
    )


def sample(ts: str | Column, value: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    value = F.col(value) if isinstance(value, str) else value
    return F.struct(ts.alias("timestamp"), value.alias("value"))


def encode_stateful_alerts(alerts: DataFrame) -> DataFrame:
    """``key, value``: one JSON message per stateful alert and part, keyed by series.

    ``measurements`` is an empty list where no history was attached.  Parts of one alert are equal but for
    ``measurements`` and ``part``.
    """
    if "measurements" not in alerts.columns:
        empty = F.array().cast("array<struct<timestamp: timestamp, value: double>>")
        alerts = alerts.withColumn("measurements", empty)
    return _numbered(alerts).select(
        F.col("truck").alias("key"),
        json_text(
            "truck",
            sample("min_ts", "min_value").alias("min"),
            sample("max_ts", "max_value").alias("max"),
            "measurements", "part", "parts",
        ).alias("value"),
    )

