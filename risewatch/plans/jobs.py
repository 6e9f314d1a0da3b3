"""The ten jobs, each from message log to sink.

``log`` is the stream of ``sources.log.read_log_stream`` or any stand-in of the same shape.  A function
named like a job gives the job's rows, as a table or a stream; its ``start_`` twin runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from risewatch.operators import alerts, lookback, parsing, points, signals
from risewatch.plans.params import JobParams
from risewatch.streaming import sinks
from risewatch.streaming.run import BatchSink, fan_out, run_label, start_query, start_to_topic, topic_sink
from risewatch.streaming.stateful import stateful_alert_writer
from risewatch.streaming.windows import window_alert_writer

# How late a reading of the stateful job may be.
STATEFUL_LATENESS_SECONDS = 60
# How far behind duplicates and windows of statistics are remembered, unless a job asks for ever (None).
STATE_WATERMARK = "1 hour"


# Routing of signals to one topic per type.

def gateway(log: DataFrame, payload: str = "value", watermark: str | None = STATE_WATERMARK) -> DataFrame:
    parsed = parsing.parse_signals(log)
    return signals.route_signals(signals.distinct_signals(parsed, watermark), payload)


def start_gateway(log: DataFrame, params: JobParams, checkpoint: str, payload: str = "value",
                  watermark: str | None = STATE_WATERMARK, sink: BatchSink | None = None) -> StreamingQuery:
    """One query for all routes: the log is read and freed of duplicates once.

    ``watermark=None`` remembers every signal for ever.
    """
    return start_to_topic(gateway(log, payload, watermark), name="gateway", checkpoint=checkpoint, params=params,
                          sink=sink)


# Routed signals as a queryable table.

def gateway_consumer(log: DataFrame) -> DataFrame:
    return parsing.parse_signals(log)


def start_gateway_consumer(log: DataFrame, params: JobParams, checkpoint: str,
                           path: str | None, in_memory: bool = False) -> StreamingQuery:
    """Into a table of files at ``path``, or with ``in_memory`` into the table "gatewayConsumer", which
    holds its rows on the driver and so is for looking at a trickle."""
    rows = gateway_consumer(log)
    if (path is None) != in_memory:
        raise ValueError("give either a path or in_memory")
    if in_memory:
        return start_query(rows, name="gatewayConsumer", checkpoint=checkpoint, sink="memory",
                           output_mode=params.output_mode, trigger=params.trigger)
    return start_query(rows, name="gatewayConsumer", checkpoint=checkpoint, sink="parquet",
                       options={"path": path}, trigger=params.trigger)


# Running count per topic.

def cumulative_count(log: DataFrame) -> DataFrame:
    return signals.topic_counts(log)


def start_cumulative_count(log: DataFrame, params: JobParams, checkpoint: str,
                           sink="console") -> StreamingQuery:
    return start_query(cumulative_count(log), name="total_count", checkpoint=checkpoint, sink=sink,
                       output_mode="complete", trigger=params.trigger, partitions=params.shuffle_partitions)


# Signals into the signal table.

def persister(log: DataFrame) -> DataFrame:
    return parsing.parse_signals(log, keep=("offset",))


def start_persister(log: DataFrame, params: JobParams, checkpoint: str, path: str) -> StreamingQuery:
    def shape(batch: DataFrame) -> DataFrame:
        return signals.signal_records(batch).drop("offset")

    sink = sinks.batch_writer(path, "timestamp", shape, order=("id", "timestamp"))
    return start_query(persister(log), name="persister", checkpoint=checkpoint, sink=sink, trigger=params.trigger)


# Five-minute statistics into the statistics table.

def signal_aggregation(log: DataFrame, watermark: str | None = STATE_WATERMARK) -> DataFrame:
    return signals.signal_stats(parsing.parse_untyped_signals(log), "5 minutes", watermark)


def start_signal_aggregation(log: DataFrame, params: JobParams, checkpoint: str, path: str,
                             watermark: str | None = STATE_WATERMARK, output_mode: str = "update") -> StreamingQuery:
    """``update`` writes the windows that changed; ``complete`` all of them each time, to the same end."""
    sink = sinks.batch_writer(path, "aggregate", order=("id", "aggregate"))
    return start_query(signal_aggregation(log, watermark), name="signalAggregation", checkpoint=checkpoint,
                       sink=sink, output_mode=output_mode, trigger=params.trigger,
                       partitions=params.shuffle_partitions)


# Window alerts.

def _watched(log: DataFrame) -> DataFrame:
    return parsing.watched_readings(parsing.parse_readings(log)).select("truck", "_timestamp", "value")


def truck_alerts(log: DataFrame, params: JobParams) -> DataFrame:
    found = alerts.live_window_alerts(
        _watched(log), params.alert_threshold, params.window, params.slide, params.watermark
    )
    return alerts.encode_window_alerts(found)


def truck_alerts_table(log: DataFrame, params: JobParams) -> DataFrame:
    """The same messages from a bounded log, whatever the size of its windows."""
    readings = _watched(log)
    found = alerts.window_alerts(readings, params.alert_threshold, params.window, params.slide)
    return alerts.encode_window_alerts(alerts.window_alert_values(found, readings, params.window, params.slide))


def start_truck_alerts(log: DataFrame, params: JobParams, checkpoint: str, path: str,
                       sink: BatchSink | None = None) -> StreamingQuery:
    """Window alerts into the tables at ``path``, and their messages to the log or to ``sink``.

    What the output mode says holds for windows: "update" sends those that changed, "append" those that
    have ended, "complete" all of them each time.  A window's readings go out in parts.
    """
    mode = params.output_mode.lower()
    write = window_alert_writer(
        path, params.alert_threshold, window=params.window, slide=params.slide, lateness=params.watermark,
        mode=mode, publish=sink or topic_sink(params, f"truckAlerts-{run_label(checkpoint)}"), run=run_label(checkpoint),
    )
    return start_query(_watched(log), name="truckAlerts", checkpoint=checkpoint, sink=write, trigger=params.trigger,
                       partitions=params.shuffle_partitions)


# Stateful alerts.

def start_stateful_truck_alerts(log: DataFrame, params: JobParams, checkpoint: str, path: str,
                                sink: BatchSink | None = None) -> StreamingQuery:
    """Alerts into the tables at ``path``, and their messages to the log or to ``sink``.

    A message carries the look-back readings that no earlier alert of its batch has brought.  A new
    checkpoint is a new run, and starts from nothing.
    """
    if params.output_mode.lower() not in ("append", "update"):
        raise ValueError(f"output mode {params.output_mode!r}: alerts of a batch are only appended")
    messages = sink or topic_sink(params, f"statefulTruckAlerts-{run_label(checkpoint)}")

    def publish(found: DataFrame, batch_id: int) -> None:
        messages(alerts.encode_stateful_alerts(found), batch_id)

    write = stateful_alert_writer(
        path, params.alert_threshold, lateness_seconds=STATEFUL_LATENESS_SECONDS,
        publish=publish, attach=lookback.with_new_measurements, run=run_label(checkpoint),
    )
    rows = _watched(log).withWatermark("_timestamp", f"{STATEFUL_LATENESS_SECONDS} seconds")
    return start_query(rows, name="statefulTruckAlerts", checkpoint=checkpoint, sink=write, trigger=params.trigger)


# Loaders of the point table.

def truck_topic_to_points(log: DataFrame, job: str | None = None, cluster: str | None = None) -> DataFrame:
    readings = parsing.watched_readings(parsing.parse_unitless_readings(log, keep=("offset",)))
    return points.reading_points(readings, job, cluster, keep=("offset",))


def truck_alerts_to_points(log: DataFrame, job: str | None = None, cluster: str | None = None) -> DataFrame:
    found = parsing.parse_window_alerts(log, keep=("offset",))
    return points.window_alert_points(found, job, cluster, keep=("offset",))


def stateful_truck_alerts_to_points(log: DataFrame, job: str | None = None,
                                    cluster: str | None = None) -> DataFrame:
    found = parsing.parse_stateful_alerts(log, keep=("offset",))
    return points.stateful_alert_points(found, job, cluster, keep=("offset",))


def point_sink(path: str) -> BatchSink:
    return sinks.batch_writer(
        path, "time", lambda batch: points.latest_points(batch, "offset"), order=("measurement", "time")
    )


def start_truck_topic_to_points(log: DataFrame, params: JobParams, checkpoint: str, path: str,
                                job: str | None = None, cluster: str | None = None) -> StreamingQuery:
    return start_query(truck_topic_to_points(log, job, cluster), name="truckTopicToPoints", checkpoint=checkpoint,
                       sink=point_sink(path), trigger=params.trigger)


def start_truck_alerts_to_points(log: DataFrame, params: JobParams, checkpoint: str, path: str,
                                 job: str | None = None, cluster: str | None = None,
                                 show: bool = False) -> StreamingQuery:
    """Alerts into the point table and, with ``show``, onto the console: one query, each batch read once."""
    write = point_sink(path)

    def points_of(batch: DataFrame, batch_id: int) -> None:
        write(points.window_alert_points(batch, job, cluster, keep=("offset",)), batch_id)

    sink = fan_out(lambda batch, _: batch.show(), points_of) if show else points_of
    return start_query(parsing.parse_window_alerts(log, keep=("offset",)), name="truckAlertsToPoints",
                       checkpoint=checkpoint, sink=sink, trigger=params.trigger)


def start_stateful_truck_alerts_to_points(log: DataFrame, params: JobParams, checkpoint: str, path: str,
                                          job: str | None = None, cluster: str | None = None) -> StreamingQuery:
    return start_query(stateful_truck_alerts_to_points(log, job, cluster), name="statefulAlertsToPoints",
                       checkpoint=checkpoint, sink=point_sink(path), trigger=params.trigger)
