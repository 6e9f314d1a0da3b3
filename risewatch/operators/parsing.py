"""From log messages to typed rows.

Parsing is permissive: text that is no JSON object gives a row of nulls, a field of the wrong type is
null by itself, unknown fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risewatch import schemas


def parse_log(log: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """The JSON bodies as columns, next to the message columns in ``keep``.

    The body is expanded by ``inline``, one row to one row.  Filters on its fields then stay above it; with
    a plain projection they would be pushed below, and each would parse the text again.
    """
    body = F.from_json(F.col("value").cast("string"), schema)
    return log.select(*[F.col(k).alias(f"_{k}") for k in keep], F.inline(F.array(body))).select(
        *schema.fieldNames(), *[F.col(f"_{k}").alias(k) for k in keep]
    )


def parse_signals(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return parse_log(log, schemas.SIGNAL, keep)


def parse_untyped_signals(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return parse_log(log, schemas.UNTYPED_SIGNAL, keep)


def parse_readings(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return parse_log(log, schemas.READING, keep)


def parse_unitless_readings(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return parse_log(log, schemas.UNITLESS_READING, keep)


def watched_readings(readings: DataFrame, channel: str = schemas.WATCHED_CHANNEL) -> DataFrame:
    """Readings of one channel."""
    return readings.where(F.col("channel") == channel)


def parse_window_alerts(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``truck, alerts, timestamp, start, end, part``; the timestamp is the one the log wrote.

    A message without a part number is a whole alert, part 0.
    """
    parsed = parse_log(log, schemas.WINDOW_ALERT, ("timestamp", *keep))
    part = F.coalesce("part", F.lit(0)).alias("part")
    return parsed.select("truck", "alerts", "timestamp", "alert_time.start", "alert_time.end", part, *keep)


def parse_stateful_alerts(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``truck, timestamp, min, max, measurements, part, parts``, whole alerts being part 0 of 1."""
    return parse_log(log, schemas.STATEFUL_ALERT, ("timestamp", *keep)).select(
        "truck", "timestamp", "min", "max", "measurements",
        F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), *keep,
    )
