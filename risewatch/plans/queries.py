"""The query catalogue over the event table.

Every query reads the whole table.  Instants leave as zone-less timestamps in UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from risewatch.functions.text import json_map, json_text
from risewatch.operators import alerts, lookback, parsing, partitioning, points, quality, signals
from risewatch.operators.ordering import stage
from risewatch.plans import jobs
from risewatch.plans.params import JobParams
from risewatch.schemas import WATCHED_CHANNEL
from risewatch.session import run_dir
from risewatch.sources import file_log, tables
from risewatch.sources.log import read_log, read_log_files, read_log_stream, to_log
from risewatch.streaming import sinks
from risewatch.streaming.run import finish, start_query
from risewatch.streaming.stateful import stateful_alert_writer

THRESHOLD = 10
SLIDE = "15 minutes"
SPIKE = 25
GAP_MS = 900_000


def _plain(column: str | Column, name: str | None = None) -> Column:
    named = F.col(column) if isinstance(column, str) else column
    return named.cast("timestamp_ntz").alias(name or column)


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings through the log: encoded, parsed again, and filtered by channel."""
    log = tables.reading_log(tables.events(spark, sf_dir))
    return parsing.watched_readings(parsing.parse_readings(log, keep=("offset",)))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_signals(tables.signal_log(tables.events(spark, sf_dir)), keep=("offset",))


# Parsing

def parse_signals(spark, sf_dir):
    return _signals(spark, sf_dir).drop("offset")


def parse_readings(spark, sf_dir):
    log = tables.reading_log(tables.events(spark, sf_dir), tables.event_channel())
    return parsing.parse_readings(log).select("truck", _plain("_timestamp", "at"), "channel", "value", "unit")


def json_roundtrip(spark, sf_dir):
    body = json_map(json_text("event_type", "value"))
    return (
        tables.events(spark, sf_dir)
        .select("event_id", body.alias("body"), json_map(F.col("props")).alias("props"))
        .select(
            "event_id",
            F.col("body")["event_type"].alias("event_type"),
            F.col("body")["value"].cast("double").alias("value"),
            F.col("props")["k"].cast("int").alias("k"),
        )
    )


def channel_filter(spark, sf_dir):
    log = tables.reading_log(tables.events(spark, sf_dir), tables.event_channel())
    rows = parsing.watched_readings(parsing.parse_readings(log))
    return rows.select("truck", _plain("_timestamp", "at"), "channel", "value")


# Signals

def dedup_signals(spark, sf_dir):
    sent_twice = F.explode(F.array(F.col("offset"), F.col("offset") + F.lit(10**12)))
    return signals.first_signals(_signals(spark, sf_dir).withColumn("offset", sent_twice))


def route_signals(spark, sf_dir):
    return signals.route_signals(signals.first_signals(_signals(spark, sf_dir)), keep=("id", "timestamp"))


def topic_counts(spark, sf_dir):
    return signals.topic_counts(tables.signal_log(tables.events(spark, sf_dir)))


def signal_stats_5m(spark, sf_dir):
    log = tables.signal_log(tables.events(spark, sf_dir))
    stats = signals.signal_stats(parsing.parse_untyped_signals(log))
    return stats.select("id", _plain("aggregate"), "count", F.round("avg", 6).alias("avg"), "min", "max", "sum")


def persist_signals(spark, sf_dir):
    rows = signals.signal_records(_signals(spark, sf_dir))
    return rows.select("id", _plain("timestamp"), "signalType", "value", "producerId")


def partition_by_index(spark, sf_dir):
    rows = tables.events(spark, sf_dir)
    number = partitioning.partition_number(16, index="event_id")
    return rows.groupBy(number.alias("number")).agg(F.count(F.lit(1)).alias("n"))


# Window alerts

def _window_alerts(spark, sf_dir, slide=None):
    found = alerts.window_alerts(_watched(spark, sf_dir), THRESHOLD, "60 minutes", slide)
    return found.select(
        "truck", _plain("window_start"), _plain("window_end"), "alerts", "n_values",
        _plain("first_ts"), _plain("last_ts"),
    )


def anomaly_windows(spark, sf_dir):
    return _window_alerts(spark, sf_dir)


def anomaly_windows_sliding(spark, sf_dir):
    return _window_alerts(spark, sf_dir, SLIDE)


def rising_prefix_alerts(spark, sf_dir):
    found = alerts.rising_prefix_alerts(_watched(spark, sf_dir), THRESHOLD, "1 day")
    return found.select("truck", _plain("window_start"), "alert", _plain("max_ts"), "max_value", "prefix_length")


def encode_window_alerts(spark, sf_dir):
    readings = _watched(spark, sf_dir)
    found = alerts.window_alerts(readings, THRESHOLD)
    messages = alerts.encode_window_alerts(
        alerts.window_alert_values(found, readings, spread_by=("_timestamp", "value", "offset"))
    )
    log = messages.select("value", F.lit(None).cast("timestamp").alias("timestamp"))
    body = parsing.parse_log(log, parsing.schemas.WINDOW_ALERT)
    total = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v["value"])
    return body.select(
        "truck", _plain("alert_time.start", "window_start"), _plain("alert_time.end", "window_end"), "alerts",
        "part", "parts", F.size("values").alias("n"),
        _plain(F.element_at("values", 1)["_timestamp"], "first_ts"),
        _plain(F.element_at("values", -1)["_timestamp"], "last_ts"), F.round(total, 2).alias("total"),
    )


# Stateful alerts

def _history(spark, sf_dir) -> DataFrame:
    """Stored readings: points at millisecond precision, the newest per key."""
    readings = tables.event_readings(tables.events(spark, sf_dir))
    stored = points.latest_points(points.reading_points(readings, keep=("event_id",)), "event_id")
    return points.history_of(stored, WATCHED_CHANNEL)


def stateful_alerts(spark, sf_dir):
    found = alerts.stateful_alerts(_watched(spark, sf_dir), THRESHOLD)
    return found.select("truck", _plain("min_ts"), "min_value", _plain("max_ts"), "max_value")


def stateful_alerts_lookback(spark, sf_dir):
    found = alerts.stateful_alerts(_watched(spark, sf_dir), THRESHOLD)
    stats = lookback.lookback_stats(found, _history(spark, sf_dir))
    return stats.select(
        "truck", _plain("max_ts"), "n", F.round("total", 2).alias("total"),
        _plain("first_time"), _plain("last_time"),
    )


def encode_stateful_alerts(spark, sf_dir):
    found = alerts.stateful_alerts(_watched(spark, sf_dir), THRESHOLD)
    log = alerts.encode_stateful_alerts(found).withColumn("timestamp", F.lit(None).cast("timestamp"))
    rows = parsing.parse_stateful_alerts(log, keep=("key",))
    return rows.select(
        F.col("key").alias("message_key"), "truck",
        _plain("min.timestamp", "min_ts"), F.col("min.value").alias("min_value"),
        _plain("max.timestamp", "max_ts"), F.col("max.value").alias("max_value"),
        F.size("measurements").alias("n"),
    )


def encode_stateful_alerts_full(spark, sf_dir):
    """Messages with the look-back readings that no earlier alert of the series has brought."""
    found = stage(alerts.stateful_alerts(_watched(spark, sf_dir), THRESHOLD), "alerts")
    full = lookback.with_new_measurements(found, _history(spark, sf_dir))
    log = alerts.encode_stateful_alerts(full).withColumn("timestamp", F.lit(None).cast("timestamp"))
    rows = parsing.parse_stateful_alerts(log, keep=("key",))
    total = F.aggregate("measurements", F.lit(0.0), lambda acc, m: acc + m["value"])
    return rows.select(
        F.col("key").alias("message_key"), _plain("max.timestamp", "max_ts"), "part", "parts",
        F.size("measurements").alias("n"), F.round(total, 2).alias("total"),
    )


# Points

def _flat(rows: DataFrame, *tag_names: str) -> DataFrame:
    tags = [F.col("tags")[name].alias(name) for name in tag_names]
    return rows.select("measurement", *tags, _plain("time"), F.round("value", 2).alias("value"))


def reading_points(spark, sf_dir):
    log = tables.reading_log(tables.events(spark, sf_dir), tables.event_channel())
    rows = parsing.parse_unitless_readings(log, keep=("offset",))
    stored = points.latest_points(points.reading_points(rows, "job", "cluster", keep=("offset",)), "offset")
    return _flat(stored, "truck", "jenkins_job", "cluster_id")


def window_alert_points(spark, sf_dir):
    found = alerts.window_alerts(_watched(spark, sf_dir), THRESHOLD)
    alert_time = F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"))
    log = to_log(found.withColumn("alert_time", alert_time), "truck", "alert_time", "alerts",
                 topic=F.lit("alerts"), offset=F.unix_micros("last_ts"), timestamp="last_ts")
    rows = points.window_alert_points(parsing.parse_window_alerts(log, keep=("offset",)), keep=("offset",))
    return _flat(points.latest_points(rows, "offset"), "truck")


def stateful_alert_points(spark, sf_dir):
    found = stage(alerts.stateful_alerts(_watched(spark, sf_dir), THRESHOLD), "alerts")
    recorded = lookback.recorded_readings(found, _history(spark, sf_dir))
    rows = points.alert_and_reading_points(found, recorded)
    stored = points.latest_points(rows.withColumn("version", F.lit(0)), "version")
    return _flat(stored, "truck", "alert_mode", "time_mode", "temp")


# Quality and history

def _direct(spark, sf_dir, channel=None) -> DataFrame:
    return tables.event_readings(tables.events(spark, sf_dir), channel)


def spike_filter(spark, sf_dir):
    rows = quality.without_spikes(_direct(spark, sf_dir), SPIKE)
    return rows.select("event_id", "truck", _plain("_timestamp", "at"), "value")


def series_gaps(spark, sf_dir):
    rows = quality.series_gaps(_direct(spark, sf_dir), GAP_MS)
    return rows.select("event_id", "truck", "gap_ms", "is_gap")


def channel_range_check(spark, sf_dir):
    rows = quality.channel_range_check(_direct(spark, sf_dir, tables.event_channel()))
    return rows.select("event_id", "channel", "value", "expected_unit", "range_status")


def history_range(spark, sf_dir):
    rows = tables.events(spark, sf_dir).select(F.col("event_type").alias("truck"), "ts", "value")
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 00:00:00", "2024-01-20 12:00:00"))
    return tables.history_range(rows, low, high, ts="ts")


# Streams: the jobs over the event table's files, into folders of the shared folder.  Without
# `files_per_trigger` one batch takes all files; with it, they come in the order they were written.

def _params(spark: SparkSession, **settings) -> JobParams:
    """Take what there is and stop.  State gets a few partitions per core rather than the batch default."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return JobParams(trigger=None, alert_threshold=THRESHOLD,
                     shuffle_partitions=min(most, 2 * spark.sparkContext.defaultParallelism), **settings)


def _run(spark: SparkSession, name: str, start: Callable[[str, str], StreamingQuery]) -> str:
    """Run a job to its end and give the folder it wrote to; `start` gets its checkpoint and that folder."""
    base = run_dir(spark, name)
    start(f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return f"{base}/out"


def _last_batch(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows that were written again by later batches, the last."""
    values = [c for c in rows.columns if c not in (*keys, "run", "batch")]
    return signals.newest(rows, list(keys), "batch", values).drop("batch")


def _reading_stream(spark, sf_dir, files_per_trigger, channel=None) -> DataFrame:
    return tables.reading_log(tables.event_stream(spark, sf_dir, files_per_trigger), channel)


def _signal_stream(spark, sf_dir, files_per_trigger) -> DataFrame:
    return tables.signal_log(tables.event_stream(spark, sf_dir, files_per_trigger))


def stream_anomaly_windows(spark, sf_dir, files_per_trigger=None):
    log = _reading_stream(spark, sf_dir, files_per_trigger)
    params = _params(spark, output_mode="update")
    path = _run(spark, "anomaly_windows", lambda checkpoint, out: jobs.start_truck_alerts(
        log, params, checkpoint, f"{out}/tables", sink=sinks.message_writer(f"{out}/messages")))
    messages = sinks.read_messages(spark, f"{path}/messages", "value string")
    parts = parsing.parse_log(messages, parsing.schemas.WINDOW_ALERT, keep=("batch",))
    rows = parts.groupBy("truck", "alert_time.start", "alert_time.end", "batch").agg(
        F.max("alerts").cast("int").alias("alerts"), F.sum(F.size("values")).cast("int").alias("n_values"))
    rows = _last_batch(rows, "truck", "start", "end")
    return rows.select("truck", _plain("start", "window_start"), _plain("end", "window_end"), "alerts", "n_values")


def stream_stateful_alerts(spark, sf_dir, files_per_trigger=None):
    log = _reading_stream(spark, sf_dir, files_per_trigger)
    path = _run(spark, "stateful_alerts", lambda checkpoint, out: start_query(
        parsing.watched_readings(parsing.parse_readings(log)), checkpoint=checkpoint, trigger=None,
        sink=stateful_alert_writer(out, THRESHOLD, publish=sinks.message_writer(f"{out}/summaries"))))
    rows = sinks.read_messages(
        spark, f"{path}/summaries",
        "truck string, min_ts timestamp, min_value double, max_ts timestamp, max_value double, n bigint, total double",
    )
    return rows.select("truck", _plain("min_ts"), "min_value", _plain("max_ts"), "max_value",
                       F.col("n").cast("int").alias("n"), F.round("total", 2).alias("total"))


def stream_stateful_messages(spark, sf_dir, files_per_trigger=None):
    log = _reading_stream(spark, sf_dir, files_per_trigger)
    params = _params(spark, output_mode="append")
    path = _run(spark, "stateful_messages", lambda checkpoint, out: jobs.start_stateful_truck_alerts(
        log, params, checkpoint, f"{out}/tables", sink=sinks.message_writer(f"{out}/messages")))
    messages = sinks.read_messages(spark, f"{path}/messages", "key string, value string")
    rows = parsing.parse_stateful_alerts(messages.withColumn("timestamp", F.lit(None).cast("timestamp")))
    return rows.where("part = 0").select(
        "truck", _plain("min.timestamp", "min_ts"), F.col("min.value").alias("min_value"),
        _plain("max.timestamp", "max_ts"), F.col("max.value").alias("max_value"))


def stream_dedup(spark, sf_dir, files_per_trigger=None):
    log = _signal_stream(spark, sf_dir, files_per_trigger)
    sent_twice = log.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).drop("copy")
    rows = signals.distinct_signals(parsing.parse_signals(sent_twice), watermark="1 hour").drop("event_time")
    path = _run(spark, "dedup", lambda checkpoint, out: start_query(
        rows, checkpoint=checkpoint, sink=sinks.message_writer(out), trigger=None,
        partitions=_params(spark).shuffle_partitions))
    columns = "id bigint, timestamp string, signalType string, value int, producerId string"
    return sinks.read_messages(spark, path, columns).drop("run", "batch")


def stream_route(spark, sf_dir, files_per_trigger=None):
    log = _signal_stream(spark, sf_dir, files_per_trigger)
    path = _run(spark, "route", lambda checkpoint, out: jobs.start_gateway(
        log, _params(spark), checkpoint, payload="json", sink=sinks.message_writer(out)))
    messages = sinks.read_messages(spark, path, "topic string, value string")
    return parsing.parse_signals(messages, keep=("topic",))


def stream_route_to_log(spark, sf_dir, files_per_trigger=None):
    """Routed signals through the log in files, whose sink commits whole batches, and back."""
    log = _signal_stream(spark, sf_dir, files_per_trigger)
    path = _run(spark, "route-log", lambda checkpoint, out: jobs.start_gateway(
        log, _params(spark, log_path=out, extra={"partitions": "3"}), checkpoint, payload="json"))
    routed = read_log(spark, JobParams(log_path=path, topics=".*", subscribe_mode="subscribePattern"))
    return parsing.parse_signals(routed, keep=("topic",))


#: Where a stream begins: one topic in the middle, one at its end, the others at their start.
START = '{"view": {"0": 120}, "error": {"0": -1}}'


def stream_from_offsets(spark, sf_dir):
    """Signals from the log in files, from stated offsets on and a few hundred messages at a time."""
    log = run_dir(spark, "log")
    messages = tables.signal_log(tables.events(spark, sf_dir)).orderBy("offset").select("topic", "key", "value", "timestamp")
    file_log.register(spark)
    messages.write.format(file_log.FORMAT).mode("append").option("path", log).save()
    most = max(100, tables.events(spark, sf_dir).count() // 4)
    params = JobParams(log_path=log, topics="view, click, signup, purchase, error", starting_offsets=START,
                       max_offsets_per_trigger=most, extra={"progress": f"{log}-progress/offsets.json"})

    def run(checkpoint: str, out: str) -> StreamingQuery:
        rows = parsing.parse_signals(read_log_stream(spark, params), keep=("topic", "offset"))
        query = start_query(rows, checkpoint=checkpoint, sink=sinks.message_writer(out), trigger="0 seconds")
        finish(query, log, {"subscribe": params.topics})
        return query

    path = _run(spark, "from-offsets", run)
    columns = "topic string, offset bigint, id bigint, timestamp string, signalType string, value int, producerId string"
    return sinks.read_messages(spark, path, columns).drop("run", "batch")


def stream_consume(spark, sf_dir, files_per_trigger=None):
    log = _signal_stream(spark, sf_dir, files_per_trigger)
    path = _run(spark, "consume", lambda checkpoint, out: jobs.start_gateway_consumer(
        log, _params(spark), checkpoint, out))
    return spark.read.schema(parsing.schemas.SIGNAL).parquet(path)


def stream_topic_counts(spark, sf_dir, files_per_trigger=None):
    log = _signal_stream(spark, sf_dir, files_per_trigger)
    path = _run(spark, "topic_counts", lambda checkpoint, out: jobs.start_cumulative_count(
        log, _params(spark), checkpoint, sink=sinks.message_writer(out)))
    return _last_batch(sinks.read_messages(spark, path, "topic string, count bigint"), "topic")


def stream_signal_stats(spark, sf_dir, files_per_trigger=None):
    log = _signal_stream(spark, sf_dir, files_per_trigger)
    path = _run(spark, "signal_stats", lambda checkpoint, out: jobs.start_signal_aggregation(
        log, _params(spark), checkpoint, out))
    rows = sinks.read_stats(spark, path)
    return rows.select("id", _plain("aggregate"), "count", F.round("avg", 6).alias("avg"), "min", "max", "sum")


def stream_persist_signals(spark, sf_dir, files_per_trigger=None):
    log = _signal_stream(spark, sf_dir, files_per_trigger)
    path = _run(spark, "persist_signals", lambda checkpoint, out: jobs.start_persister(
        log, _params(spark), checkpoint, out))
    return sinks.read_signals(spark, path).select("id", _plain("timestamp"), "signalType", "value", "producerId")


def stream_reading_points(spark, sf_dir, files_per_trigger=None):
    log = _reading_stream(spark, sf_dir, files_per_trigger, tables.event_channel())
    rows = points.reading_points(parsing.parse_unitless_readings(log, keep=("offset",)), "job", "cluster",
                                 keep=("offset",))
    path = _run(spark, "reading_points", lambda checkpoint, out: start_query(
        rows, checkpoint=checkpoint, sink=jobs.point_sink(out), trigger=None))
    return _flat(sinks.read_points(spark, path), "truck", "jenkins_job", "cluster_id")


def stream_truck_points(spark, sf_dir, files_per_trigger=None):
    log = _reading_stream(spark, sf_dir, files_per_trigger, tables.event_channel())
    path = _run(spark, "truck_points", lambda checkpoint, out: jobs.start_truck_topic_to_points(
        log, _params(spark), checkpoint, out, "job", "cluster"))
    return _flat(sinks.read_points(spark, path), "truck", "jenkins_job", "cluster_id")


def _alert_log(spark, messages: DataFrame, name: str, order: str) -> DataFrame:
    """Alert messages as a log of files, read as a stream."""
    path = run_dir(spark, name)
    rows = messages.select("value", order)
    to_files = rows.select(
        F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("alerts").alias("topic"),
        F.lit(0).alias("partition"), F.unix_micros(order).alias("offset"), F.col(order).alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )
    to_files.write.parquet(path)
    return read_log_files(spark, path, streaming=True)


def stream_window_alert_points(spark, sf_dir):
    found = stage(alerts.window_alerts(_watched(spark, sf_dir), THRESHOLD), "alerts")
    body = found.withColumn("alert_time", F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")))
    body = body.select(json_text("truck", "alert_time", "alerts").alias("value"), "last_ts")
    log = _alert_log(spark, body, "window-alerts", "last_ts")
    path = _run(spark, "window_alert_points", lambda checkpoint, out: jobs.start_truck_alerts_to_points(
        log, _params(spark), checkpoint, out))
    return _flat(sinks.read_points(spark, path), "truck")


def stream_stateful_alert_points(spark, sf_dir):
    found = stage(alerts.stateful_alerts(_watched(spark, sf_dir), THRESHOLD), "alerts")
    full = stage(lookback.with_new_measurements(found, _history(spark, sf_dir)), "alerts")
    messages = alerts.encode_stateful_alerts(full).select("value", F.current_timestamp().alias("at"))
    log = _alert_log(spark, messages, "stateful-alerts", "at")
    path = _run(spark, "stateful_alert_points", lambda checkpoint, out: jobs.start_stateful_truck_alerts_to_points(
        log, _params(spark), checkpoint, out))
    return _flat(sinks.read_points(spark, path), "truck", "alert_mode", "time_mode", "temp")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_signals, parse_readings, json_roundtrip, channel_filter,
        dedup_signals, route_signals, topic_counts, signal_stats_5m, persist_signals, partition_by_index,
        anomaly_windows, anomaly_windows_sliding, rising_prefix_alerts, encode_window_alerts,
        stateful_alerts, stateful_alerts_lookback, encode_stateful_alerts, encode_stateful_alerts_full,
        reading_points, window_alert_points, stateful_alert_points,
        spike_filter, series_gaps, channel_range_check, history_range,
        stream_anomaly_windows, stream_stateful_alerts, stream_stateful_messages, stream_dedup, stream_route,
        stream_route_to_log, stream_from_offsets,
        stream_consume, stream_topic_counts, stream_signal_stats, stream_persist_signals, stream_reading_points, stream_truck_points,
        stream_window_alert_points, stream_stateful_alert_points,
    )
}
