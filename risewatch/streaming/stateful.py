"""Stateful alerts across micro-batches.

Each batch runs the batch operators over its own readings, so a series that holds most of them is spread
over many tasks.  What one batch hands on to the next is kept in the shared folder, keyed by batch id:

* ``lows/batch=<id>``: the low each series stands at, one row per series, without those older than the
  expiry and the lateness behind the newest reading, which nothing can rise from any more;
* ``history/``: the readings of the last day, for look-backs, see ``streaming.store``;
* ``alerts/batch=<id>``: the batch's alerts.

A batch that Spark repeats after a failure reads the lows of the batch before it and replaces its own
folders, so every reading and alert counts once.  Batch ids belong to a checkpoint: a query that starts with
a new checkpoint on the same path takes a new ``run`` label, which gets tables of its own; the run that
started last is the one that is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.operators import lookback
from risewatch.operators.rises import rise_steps
from risewatch.session import adaptive
from risewatch.streaming.run import BatchSink
from risewatch.streaming.sinks import run_folder
from risewatch.streaming.store import ReadingStore, children

#: (alerts, history) -> alerts with the look-back.
Attach = Callable[[DataFrame, DataFrame], DataFrame]

_LOW = "truck string, _timestamp timestamp, value double"
#: How long readings are kept behind the newest.
KEEP_SECONDS = 86_400
ALERT = "truck string, min_ts timestamp, min_value double, max_ts timestamp, max_value double"


def stateful_alert_writer(
    path: str, threshold: float, *, expire: str = "1 hour", lateness_seconds: int = 60,
    publish: BatchSink | None = None, attach: Attach = lookback.lookback_stats, run: str | None = None,
    keep_seconds: int = KEEP_SECONDS,
) -> BatchSink:
    """A batch sink that turns readings (truck, _timestamp, value) into stateful alerts below ``path``.

    Readings at or before the low of their series leave it alone, as in the fold over a table; readings
    without a usable time or value take no part.  ``publish`` gets each batch's alerts with what ``attach``
    makes of them and the stored history, by default the summary of each look-back.  A batch without alerts
    reads no history.  ``run`` labels the tables of one checkpoint; a single run needs none.
    """
    base = path

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = base if run is None else run_folder(spark, base, run)
        rows = batch.where(F.col("_timestamp").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).select(
            "truck", F.col("_timestamp").alias("time"), "value"
        )
        store = _store(spark, path)
        before = store.index(batch_id - 1).newest
        store.append(rows, batch_id, None if before is None else before - keep_seconds * 1_000_000)
        rows = store.batch(batch_id).select("truck", F.col("time").alias("_timestamp"), "value")

        lows = _lows(spark, path, batch_id - 1)
        before = lows.select(F.col("truck").alias("t"), F.col("_timestamp").alias("low"))
        new = rows.join(before, F.col("truck").eqNullSafe(F.col("t")), "left").where(
            F.col("low").isNull() | (F.col("_timestamp") > F.col("low"))
        )
        steps_path = f"{path}/steps/batch={batch_id}"
        rise_steps(
            new.select("truck", "_timestamp", "value").unionByName(lows), ["truck"],
            threshold=threshold, expire=expire, strict_time=True,
        ).write.mode("overwrite").parquet(steps_path)
        steps = spark.read.parquet(steps_path)

        newest = rows.agg(F.max("_timestamp")).first()[0]
        standing = steps.where("closing").select("truck", F.col("low_ts").alias("_timestamp"), F.col("low_value").alias("value"))
        if newest is not None:
            oldest = F.lit(newest) - F.expr(f"interval {expire}") - F.expr(f"interval {lateness_seconds} seconds")
            standing = standing.where(F.col("_timestamp") >= oldest)
        standing.write.mode("overwrite").parquet(f"{path}/lows/batch={batch_id}")

        found = steps.where("NOT closing").select(
            "truck", F.col("low_ts").alias("min_ts"), F.col("low_value").alias("min_value"), "max_ts", "max_value"
        )
        found.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        if publish is not None:
            publish(lookback_of(spark, path, batch_id, attach), batch_id)

    def adaptively(batch: DataFrame, batch_id: int) -> None:
        with adaptive(batch.sparkSession):
            write(batch, batch_id)

    return adaptively


def _lows(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], _LOW)
    return spark.read.schema(_LOW).parquet(f"{path}/lows/batch={batch_id}")


def _store(spark: SparkSession, path: str) -> ReadingStore:
    return ReadingStore(spark, f"{path}/history")


def latest_run(spark: SparkSession, path: str) -> str:
    """The folder of the run that started last; the path itself where runs have no labels."""
    numbers = [int(n.removeprefix("seq=")) for n in children(spark, path) if n.startswith("seq=")]
    if not numbers:
        return path
    folder = f"{path}/seq={max(numbers)}"
    return f"{folder}/{children(spark, folder)[0]}"


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts of the latest run, with their batch."""
    alerts = f"{latest_run(spark, path)}/alerts"
    return spark.read.schema(f"{ALERT}, batch bigint").option("basePath", alerts).parquet(alerts)


def history_until(spark: SparkSession, path: str, batch_id: int, earliest=None) -> DataFrame:
    """The stored readings up to a batch, ``truck, time, value``; of one instant the newest message.

    Only folders that reach to ``earliest`` (an instant) or beyond are listed.
    """
    store = _store(spark, path)
    first = None if earliest is None else spark.range(1).select(F.unix_micros(F.lit(earliest)).alias("us")).first()["us"]
    rows = store.between(store.index(batch_id), first)
    version = F.struct("batch", "value")  # equal times of one batch are ordered by value
    return rows.groupBy("truck", "time").agg(F.max(version).alias("last")).select("truck", "time", F.col("last.value").alias("value"))


def lookback_of(
    spark: SparkSession, path: str, batch_id: int, attach: Attach = lookback.lookback_stats
) -> DataFrame:
    """A batch's alerts with the readings of the hour before each, from the stored history.

    ``attach`` says how: a summary, all readings per alert, or each reading once.  Without alerts no history
    is listed or read.
    """
    alerts = spark.read.schema(ALERT).parquet(f"{path}/alerts/batch={batch_id}")
    first = alerts.agg(F.min("max_ts") - F.expr("interval 1 hour")).first()[0]
    if first is None:
        return attach(spark.createDataFrame([], ALERT), spark.createDataFrame([], "truck string, time timestamp, value double"))
    return attach(alerts, history_until(spark, path, batch_id, first))
