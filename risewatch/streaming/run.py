"""Starting streaming queries."""

from __future__ import annotations

import ast
import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from risewatch.plans.params import OUTPUT_MODES, JobParams
from risewatch.session import shuffle_partitions
from risewatch.sources import file_log

BatchSink = Callable[[DataFrame, int], None]


def start_query(
    stream: DataFrame,
    *,
    checkpoint: str,
    sink: BatchSink | str,
    name: str | None = None,
    options: dict[str, str] | None = None,
    output_mode: str = "append",
    trigger: str | None = "0 seconds",
    partitions: int | None = None,
) -> StreamingQuery:
    """Start a query with its own checkpoint.

    ``sink`` is a function of (batch, batch id) or a format such as "kafka", "console", "memory",
    "parquet".  ``trigger`` is a processing-time interval; None takes what is there and stops.
    ``partitions`` is the number of shuffle partitions, if not the session's.
    """
    if output_mode.lower() not in OUTPUT_MODES:
        raise ValueError(f"output mode {output_mode!r} is none of {', '.join(OUTPUT_MODES)}")
    writer = stream.writeStream.outputMode(output_mode.lower()).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    if callable(sink):
        writer = writer.foreachBatch(sink)
    else:
        writer = writer.format(sink).options(**(options or {}))
    with shuffle_partitions(stream.sparkSession, partitions):
        return writer.start()


def finish(query: StreamingQuery, path: str, options: dict[str, str]) -> None:
    """Let a query over a log in files come to what the log holds now, and stop it.

    With a limit per trigger that takes several batches, and Spark's own waiting ends after one of them.
    """
    goal = file_log.ends(path, options)
    while True:
        query.processAllAvailable()  # raises what has ended the query
        last = query.lastProgress
        at = last["sources"][0]["endOffset"] if last else None
        # Progress gives offsets as text, in Python's notation or in JSON, which are the same for these.
        if (ast.literal_eval(at) if isinstance(at, str) else at) == goal:
            break
        time.sleep(0.05)
    query.stop()


def run_label(checkpoint: str) -> str:
    """The run that a checkpoint stands for, in tables and logs whose batches have its numbers: a new
    checkpoint counts from 0 again, and its batches are not those of the old one."""
    return hashlib.sha1(checkpoint.encode()).hexdigest()[:12]


def start_to_topic(stream: DataFrame, *, name: str, checkpoint: str, params: JobParams,
                   output_mode: str = "append", sink: BatchSink | None = None) -> StreamingQuery:
    """Write ``value`` (and ``key``, ``topic`` where present) to the message log, or to ``sink`` in its place.

    Rows with a ``topic`` column each go to their own topic, all others to the job's output topic.
    """
    if sink is not None:
        return start_query(stream, name=name, checkpoint=checkpoint, sink=sink, output_mode=output_mode,
                           trigger=params.trigger, partitions=params.shuffle_partitions)
    if params.log_path is not None:
        file_log.register(stream.sparkSession)
        return start_query(stream, name=name, checkpoint=checkpoint, sink=file_log.FORMAT, output_mode=output_mode,
                           options={"path": params.log_path, "topic": params.output_topic, "run": f"{name}-{run_label(checkpoint)}", **params.extra},
                           trigger=params.trigger, partitions=params.shuffle_partitions)
    options = {"kafka.bootstrap.servers": params.bootstrap_servers, **params.extra}
    if "topic" not in stream.columns:
        options["topic"] = params.output_topic
    return start_query(stream, name=name, checkpoint=checkpoint, sink="kafka", options=options,
                       output_mode=output_mode, trigger=params.trigger,
                       partitions=params.shuffle_partitions)


def topic_sink(params: JobParams, run: str = "main") -> BatchSink:
    """Messages of a batch to the log, for queries that write them from inside a batch.  A log in files takes
    a batch of a run once; a broker takes a repeated one again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if params.log_path is not None:
            file_log.register(batch.sparkSession)
            options = {"path": params.log_path, "topic": params.output_topic, "run": run, "batch": str(batch_id), **params.extra}
            batch.write.format(file_log.FORMAT).mode("append").options(**options).save()
            return
        options = {"kafka.bootstrap.servers": params.bootstrap_servers, **params.extra}
        batch.write.format("kafka").options(topic=params.output_topic, **options).save()

    return write


def fan_out(*sinks: BatchSink) -> BatchSink:
    """Several sinks over one reading of each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write
