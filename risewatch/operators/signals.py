"""Signals: duplicates, routes, counts and statistics, newest record per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.functions.text import json_text, signal_timestamp
from risewatch.schemas import SIGNAL

# Signal type and the topic its signals go to.
ROUTES = {"SORTER": "sorter", "PICKER": "picker", "DMS": "dms"}

SIGNAL_KEY = ["id", "timestamp", "signalType"]


def newest(rows: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """One row per key, the one with the highest version.

    Copies meet on the map side, so a key with very many of them costs one row per map task in the shuffle.
    The rows kept hold text, for which Spark aggregates over sorted input rather than by hash.
    """
    best = F.max_by(F.struct(*values), version).alias("best")
    return rows.groupBy(*keys).agg(best, F.max(version).alias(version)).select(
        *keys, *[F.col("best")[v].alias(v) for v in values], version
    )


def distinct_signals(signals: DataFrame, watermark: str | None = None, event_time: str | None = None) -> DataFrame:
    """One signal per (id, timestamp, signalType), whichever comes first.

    With ``watermark`` a stream forgets signals that far behind; without, it remembers them for good.
    """
    if watermark is None:
        return signals.dropDuplicates(SIGNAL_KEY)
    if event_time is None:
        signals = signals.withColumn("event_time", F.try_to_timestamp("timestamp"))
        event_time = "event_time"
    return signals.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(SIGNAL_KEY)


def first_signals(signals: DataFrame, version: str = "offset") -> DataFrame:
    """The same for tables with a position in the log: of equal signals the earliest, so that the value
    kept does not depend on how the table was read."""
    values = ["value", "producerId"]
    first = F.min_by(F.struct(*values), version).alias("first")
    return signals.groupBy(*SIGNAL_KEY).agg(first).select(*SIGNAL_KEY, "first.*")


def route_of(signal_type: Column | str) -> Column:
    """Topic for a signal type; null for a type that is routed nowhere."""
    signal_type = F.col(signal_type) if isinstance(signal_type, str) else signal_type
    topic: Column = F.lit(None).cast("string")
    for name, route in ROUTES.items():
        topic = F.when(signal_type == name, F.lit(route)).otherwise(topic)
    return topic


def route_signals(signals: DataFrame, payload: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``topic, value`` for every routed signal, in one pass for all routes.

    ``payload`` is "value" for the bare number as text, or "json" for the whole signal, which a consumer
    can parse again.
    """
    if payload == "value":
        text = F.col("value").cast("string")
    elif payload == "json":
        text = json_text(*SIGNAL.fieldNames())
    else:
        raise ValueError(f"payload {payload!r} is neither 'value' nor 'json'")
    return signals.select(route_of("signalType").alias("topic"), text.alias("value"), *keep).where(
        F.col("topic").isNotNull()
    )


def topic_counts(log: DataFrame) -> DataFrame:
    """Messages per topic."""
    return log.groupBy("topic").count()


def signal_stats(signals: DataFrame, duration: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """Count, average, lowest, highest and sum of the values per id and window.

    ``timestamp`` may be text; text that is no instant belongs to no window.
    """
    at = F.col("timestamp")
    if dict(signals.dtypes)["timestamp"] == "string":
        at = F.try_to_timestamp("timestamp")
    rows = signals.select("id", "value", at.alias("at"))
    if watermark is not None:
        rows = rows.withWatermark("at", watermark)
    stats = rows.groupBy(F.window("at", duration).alias("aggregate_time"), "id").agg(
        F.count("id").alias("count"),
        F.avg("value").alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum("value").alias("sum"),
    )
    return stats.select("id", F.col("aggregate_time.start").alias("aggregate"), "count", "avg", "min", "max", "sum")


def signal_records(signals: DataFrame, version: str = "offset") -> DataFrame:
    """Rows of the signal table: the newest signal per (id, whole second).

    Signals without an id or a readable timestamp have no key and are left out.
    """
    rows = signals.withColumn("timestamp", signal_timestamp(F.col("timestamp")))
    rows = rows.where(F.col("id").isNotNull() & F.col("timestamp").isNotNull())
    return newest(rows, ["id", "timestamp"], version, ["signalType", "value", "producerId"])
