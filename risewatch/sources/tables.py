"""Tables as sources: time ranges of history, and the event table read as readings or signals."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.schemas import EVENT, WATCHED_CHANNEL
from risewatch.session import configure
from risewatch.sources.log import to_log

# Channel an event type stands for where a query needs several channels.
EVENT_CHANNELS = {
    "view": "T_motTemp_Lft",
    "click": "BatTemp",
    "signup": "BatCharState",
    "purchase": "TSteerAngle",
    "error": "Key1State",
}

# Signal type an event type stands for; the others belong to no route.
EVENT_SIGNAL_TYPES = {"view": "SORTER", "click": "PICKER", "purchase": "DMS"}


def _choose(column: str, table: dict[str, str]) -> Column:
    choice: Column = F.lit(None).cast("string")
    for name, result in table.items():
        choice = F.when(F.col(column) == name, F.lit(result)).otherwise(choice)
    return choice


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(os.path.join(sf_dir, "events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream of its files, be it one file or a folder of them.

    Without ``files_per_trigger`` a bounded run takes all files in one batch, so nothing depends on their
    order.  With it, files come in the order of their modification times; then a watermark must be at
    least as wide as the event times of consecutive batches overlap.
    """
    stream = configure(spark).readStream.schema(EVENT)
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    path = os.path.join(sf_dir, "events.parquet")
    # A stream reads folders; a table that is one file is the only file of its name in its folder.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(hadoop).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def event_readings(rows: DataFrame, channel: Column | None = None) -> DataFrame:
    """Event rows as readings; the event type is the series."""
    return rows.select(
        F.col("event_type").alias("truck"),
        F.col("ts").cast("timestamp").alias("_timestamp"),
        (F.lit(WATCHED_CHANNEL) if channel is None else channel).alias("channel"),
        F.col("value"),
        F.lit("C°").alias("unit"),
        F.col("event_id"),
    )


def event_channel() -> Column:
    return _choose("event_type", EVENT_CHANNELS)


def reading_log(rows: DataFrame, channel: Column | None = None) -> DataFrame:
    """Event rows as reading messages."""
    return to_log(
        event_readings(rows, channel), "truck", "_timestamp", "channel", "value", "unit",
        topic=F.lit("readings"), offset="event_id", timestamp="_timestamp", key=F.col("truck"),
    )


def event_signals(rows: DataFrame) -> DataFrame:
    """Event rows as signals of the user."""
    return rows.select(
        F.col("user_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.coalesce(_choose("event_type", EVENT_SIGNAL_TYPES), F.upper("event_type")).alias("signalType"),
        F.floor("value").cast("int").alias("value"),
        F.concat(F.lit("p"), F.col("user_id")).alias("producerId"),
        F.col("event_id"),
        F.col("event_type"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def signal_log(rows: DataFrame) -> DataFrame:
    """Event rows as signal messages, one topic per event type."""
    return to_log(
        event_signals(rows), "id", "timestamp", "signalType", "value", "producerId",
        topic="event_type", offset="event_id", timestamp="at",
    )


def history_range(readings: DataFrame, low, high, *, ts: str = "_timestamp") -> DataFrame:
    """Readings strictly between two instants, in time order.

    The bounds are plain comparisons on the stored column, so they reach the file scan.  Spark sorts by
    ranges, so no task holds more than its share.
    """
    return readings.where((F.col(ts) > F.lit(low)) & (F.col(ts) < F.lit(high))).orderBy(ts)
