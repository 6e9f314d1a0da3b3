"""Window alerts across micro-batches, for windows of any size.

A window is not kept as a list of its readings.  What its fold has come to is a row of fixed size: the low
it stands at, its alerts, and the number and the first and last instant of its readings.  A batch whose
readings of a window are all later goes on from that row; a window that a late reading falls into is folded
anew from the stored readings.  Either way the batch operators do it, which cut a window with very many
readings over many tasks.  Kept below the path:

* ``readings/``: the readings of windows that can still change, see ``streaming.store``;
* ``windows/batch=<id>``: the rows of those windows;
* ``alerts/batch=<id>``: the windows with alerts that the batch changed.

A batch that Spark repeats reads what the batch before it left and replaces its own folders.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.operators.alerts import encode_window_alerts, window_alert_values, window_end, windowed
from risewatch.operators.ordering import written
from risewatch.operators.rises import rise_folds
from risewatch.operators.signals import newest
from risewatch.session import adaptive
from risewatch.streaming.run import BatchSink
from risewatch.streaming.sinks import run_folder
from risewatch.streaming.stateful import latest_run
from risewatch.streaming.store import ReadingStore

KEYS = ["truck", "window_start"]
_WINDOW = "truck string, window_start timestamp, low double, alerts int, n_values bigint, first_ts timestamp, last_ts timestamp"
_ALERT = "truck string, window_start timestamp, window_end timestamp, alerts int, n_values bigint, first_ts timestamp, last_ts timestamp"


def _microseconds(interval: str) -> int:
    return pd.Timedelta(interval).value // 1000


def _same(other: str, keys: list[str] = KEYS):
    """Equal keys, where a missing series name equals itself; the right side's are prefixed."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).eqNullSafe(F.col(f"{other}_{k}"))
    return found


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns))


def window_alert_writer(
    path: str, threshold: float, *, window: str = "60 minutes", slide: str | None = None,
    lateness: str | None = "60 minutes", mode: str = "update", publish: BatchSink | None = None, run: str | None = None,
) -> BatchSink:
    """A batch sink that turns readings (truck, _timestamp, value) into window alerts below ``path``.

    ``publish`` gets messages of window alerts, each window's readings in parts: with ``mode`` "update" of the
    windows that the batch changed, with "append" of those that no later batch can change, with "complete" of
    all windows.  A window that ended ``lateness`` before the newest reading of earlier batches is closed:
    readings of it are left out, as the watermark of a streaming aggregation does.  None, and complete mode,
    close none.  Readings without a usable time or value take no part.  ``run`` labels the tables of one
    checkpoint, as in ``streaming.stateful``; a single run needs none.
    """
    if mode not in ("update", "append", "complete"):
        raise ValueError(f"mode {mode!r} is none of update, append, complete")
    base = path

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = base if run is None else run_folder(spark, base, run)
        span = _microseconds(window)
        late = None if lateness is None or mode == "complete" else _microseconds(lateness)
        store = ReadingStore(spark, f"{path}/readings")
        before = store.index(batch_id - 1)
        open_after = None if late is None or before.newest is None else before.newest - late
        rows = batch.where(F.col("_timestamp").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).select(
            "truck", F.col("_timestamp").alias("time"), "value"
        )
        now = store.append(rows, batch_id, None if open_after is None else open_after - span)
        own = _open(_windowed(store.batch(batch_id), window, slide), window, open_after)
        at = F.col("_timestamp")
        touched = own.groupBy(*KEYS).agg(F.count(at).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
        known = _windows(spark, path, batch_id - 1)
        goes_on = F.col("k_last_ts").isNull() | (F.col("first") > F.col("k_last_ts"))
        late_at = [F.when(F.col("goes_on"), None).otherwise(F.unix_micros(c)) for c in (F.least("first", "k_first_ts"), F.greatest("last", "k_last_ts"))]
        touched, reach = _kept(
            touched.join(_prefixed(known, "k"), _same("k"), "left").withColumn("goes_on", goes_on),
            f"{path}/touched/batch={batch_id}", {"first": F.min(late_at[0]), "last": F.max(late_at[1])},
        )

        # Windows that go on: their low, then the batch's readings.  Others: all their stored readings.
        late_ones = touched.where("NOT goes_on")
        lows = touched.where("goes_on AND k_low IS NOT NULL").select(*KEYS, F.col("k_last_ts").alias("_timestamp"), F.col("k_low").alias("value"))
        if reach["first"] is None:
            parts = own.unionByName(lows)
        else:
            anew = _prefixed(late_ones.select(*KEYS), "w")
            stored = _windowed(store.between(now, reach["first"], reach["last"]), window, slide)
            parts = own.join(anew, _same("w"), "left_anti").unionByName(lows).unionByName(stored.join(anew, _same("w"), "left_semi"))
        folds = rise_folds(parts, KEYS, threshold=threshold)
        changed = touched.join(_prefixed(folds, "f"), _same("f"))
        on = F.col("goes_on")
        changed, _ = _kept(changed.select(
            *KEYS, F.col("f_low_value").alias("low"),
            F.when(on, F.coalesce("k_alerts", F.lit(0)) + F.col("f_alerts")).otherwise(F.col("f_alerts")).cast("int").alias("alerts"),
            F.when(on, F.coalesce("k_n_values", F.lit(0)) + F.col("n")).otherwise(F.col("f_n_values")).alias("n_values"),
            F.when(on, F.coalesce("k_first_ts", "first")).otherwise(F.col("f_first_ts")).alias("first_ts"),
            F.when(on, F.col("last")).otherwise(F.col("f_last_ts")).alias("last_ts"),
        ), f"{path}/changed/batch={batch_id}", {"n": F.count(F.lit(1))})

        untouched = known.join(_prefixed(touched.select(*KEYS), "t"), _same("t"), "left_anti")
        everything = untouched.unionByName(changed)
        closes = None if late is None or now.newest is None else now.newest - late
        _open(everything, window, closes).write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")

        shown = {"update": changed, "complete": everything}.get(mode)
        if shown is None:
            shown = everything.where(F.unix_micros(window_end(window)) <= F.lit(closes))
        found = shown.where("alerts > 0").select(*KEYS, window_end(window), "alerts", "n_values", "first_ts", "last_ts")
        found, reach = _kept(found, f"{path}/alerts/batch={batch_id}", {
            "first": F.min(F.unix_micros("first_ts")), "last": F.max(F.unix_micros("last_ts"))})
        if publish is not None:
            rows = store.between(now, reach["first"], reach["last"]) if reach["first"] is not None else store.batch(batch_id).limit(0)
            readings = rows.select("truck", F.col("time").alias("_timestamp"), "value")
            publish(encode_window_alerts(window_alert_values(found, readings, window, slide)), batch_id)

    def adaptively(batch: DataFrame, batch_id: int) -> None:
        with adaptive(batch.sparkSession):
            write(batch, batch_id)

    return adaptively


def _kept(rows: DataFrame, path: str, sums: dict) -> tuple[DataFrame, dict]:
    """Rows written out, so that what follows does not work them out again, and aggregates over them."""
    found = written(rows, path, sums)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), found


def _windowed(rows: DataFrame, window: str, slide: str | None) -> DataFrame:
    return windowed(rows.select("truck", F.col("time").alias("_timestamp"), "value"), window, slide).select(
        *KEYS, "_timestamp", "value"
    )


def _open(rows: DataFrame, window: str, after: int | None) -> DataFrame:
    """Rows of windows that end after an instant."""
    return rows if after is None else rows.where(F.unix_micros(window_end(window)) > F.lit(after))


def _windows(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], _WINDOW)
    return spark.read.schema(_WINDOW).parquet(f"{path}/windows/batch={batch_id}")


def read_window_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of every window with alerts of the latest run, ``truck, window_start, window_end, alerts, n_values,
    first_ts, last_ts``."""
    alerts = f"{latest_run(spark, path)}/alerts"
    rows = spark.read.schema(f"{_ALERT}, batch bigint").option("basePath", alerts).parquet(alerts)
    values = ["window_end", "alerts", "n_values", "first_ts", "last_ts"]
    return newest(rows, KEYS, "batch", values).drop("batch")
