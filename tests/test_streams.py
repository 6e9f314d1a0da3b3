"""Streams over log-shaped files: one file is one micro-batch."""

import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from risewatch.operators import alerts, lookback, points, signals
from risewatch.plans import jobs, queries
from risewatch.plans.oracles import ORACLES
from risewatch.plans.params import JobParams
from risewatch.schemas import LOG
from risewatch.sources import tables
from risewatch.sources.log import read_log_files
from risewatch.streaming import sinks
from risewatch.streaming.run import start_query, start_to_topic
from risewatch.streaming.stateful import history_until, read_alerts, stateful_alert_writer
from tests.compare import compare, connect

T0 = datetime(2018, 1, 1, tzinfo=timezone.utc)


class Log:
    """A folder to which batches of messages are added one file at a time."""

    def __init__(self, spark, path):
        self.spark, self.path, self.offset = spark, str(path), 0
        os.makedirs(self.path)

    def add(self, bodies, topic="t"):
        rows = []
        for body in bodies:
            text = body if isinstance(body, str) else json.dumps(body)
            rows.append((None, bytearray(text.encode()), topic, 0, self.offset, T0 + timedelta(seconds=self.offset), 0))
            self.offset += 1
        self.add_frame(self.spark.createDataFrame(rows, LOG))

    def add_frame(self, df):
        df.coalesce(1).write.mode("append").parquet(self.path)
        time.sleep(0.01)

    def stream(self):
        return read_log_files(self.spark, self.path, streaming=True, files_per_trigger=1)

    def table(self):
        return read_log_files(self.spark, self.path)


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path / "log")


def reading(second, value, truck="H"):
    at = (T0 + timedelta(seconds=second)).isoformat()
    return {"truck": truck, "_timestamp": at, "channel": "T_motTemp_Lft", "value": value}


def signal(i, second, kind="SORTER", value=1):
    at = (T0 + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"id": i, "timestamp": at, "signalType": kind, "value": value, "producerId": "p"}


def run(stream, tmp_path, sink=None, mode="append", name="q"):
    out = str(tmp_path / name / "out")
    query = start_query(stream, checkpoint=str(tmp_path / name / "checkpoint"), sink=sink or sinks.message_writer(out),
                        output_mode=mode, trigger=None)
    query.awaitTermination()
    return out


def messages(spark, path):
    rows = sinks.read_messages(spark, path, "key string, value string").orderBy("batch").collect()
    return [(r.batch, json.loads(r.value)) for r in rows]


RISE = [reading(i, 5.0 + 5 * i) for i in range(7)]


def test_window_alerts_are_written_again_when_they_change(spark, log, tmp_path):
    params = JobParams(output_mode="update")
    log.add(RISE)
    out = run(jobs.truck_alerts(log.stream(), params), tmp_path, mode="update")
    log.add([reading(7, 5.0)])
    run(jobs.truck_alerts(log.stream(), params), tmp_path, mode="update")
    got = [(m["alerts"], len(m["values"])) for _, m in messages(spark, out)]
    assert got == [(2, 7), (2, 8)]
    table = [json.loads(r.value) for r in jobs.truck_alerts_table(log.table(), params).collect()]
    assert [(m["alerts"], len(m["values"])) for m in table] == [(2, 8)]


def stateful(log, tmp_path, params=None):
    """Run the stateful job over what is there; its folder of messages."""
    out = str(tmp_path / "messages")
    params = params or JobParams(output_mode="append", trigger=None)
    jobs.start_stateful_truck_alerts(
        log.stream(), params, str(tmp_path / "checkpoint"), str(tmp_path / "tables"), sinks.message_writer(out)
    ).awaitTermination()
    return out


def test_stateful_alerts_across_batches_and_a_restart(spark, log, tmp_path):
    log.add([reading(0, 5.0), reading(1, 20.0), reading(61 * 60, 50.0), reading(62 * 60, 70.0)])
    out = stateful(log, tmp_path)
    pairs = [(m["min"]["value"], m["max"]["value"]) for _, m in messages(spark, out)]
    assert sorted(pairs) == [(5.0, 20.0), (50.0, 70.0)]
    # A new query on the same checkpoint goes on from the stored low and history.
    log.add([reading(65 * 60, 100.0), reading(130 * 60, 200.0)])
    stateful(log, tmp_path)
    last = [m for _, m in messages(spark, out)][2:]
    assert [(m["min"]["value"], m["max"]["value"]) for m in last] == [(70.0, 100.0)]
    assert [m["value"] for m in last[0]["measurements"]] == [50.0, 70.0, 100.0]


def test_a_reading_at_or_before_the_low_changes_nothing(spark, log, tmp_path):
    log.add([reading(40, 30.0)])
    log.add([reading(20, 99.0), reading(30, 1.0)])  # older than the low
    log.add([reading(50, 41.0)])
    assert [(m["min"]["value"], m["max"]["value"]) for _, m in messages(spark, stateful(log, tmp_path))] == [(30.0, 41.0)]


def test_an_old_low_is_forgotten_and_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    write = stateful_alert_writer(path, 10)
    rows = [("A", T0, 5.0), ("A", T0 + timedelta(seconds=5), 50.0), ("B", T0, 1.0), (None, T0, 1.0), ("A", None, 1.0), ("A", T0, None)]
    batch = spark.createDataFrame(rows, "truck string, _timestamp timestamp, value double")
    write(batch, 0)
    later = [("A", T0 + timedelta(hours=2), 7.0), (None, T0 + timedelta(seconds=9), 30.0)]
    for _ in range(2):  # as after a failure
        write(spark.createDataFrame(later, batch.schema), 1)
    found = {(r.truck, r.min_value, r.max_value) for r in read_alerts(spark, path).collect()}
    assert found == {("A", 5.0, 50.0), (None, 1.0, 30.0)} and read_alerts(spark, path).count() == 2
    lows = spark.read.parquet(f"{path}/lows/batch=1").collect()
    assert [(r.truck, r.value) for r in lows] == [("A", 7.0)]
    assert history_until(spark, path, 1).count() == 6


@pytest.mark.parametrize("files", [1, 5])
def test_stateful_stream_equals_table_for_any_number_of_batches(spark, sf_dir, log, tmp_path, files):
    rows = tables.reading_log(tables.events(spark, sf_dir)).orderBy("offset").persist()
    size = rows.count() // files
    for n in range(files):
        log.add_frame(rows.where((F.col("offset") >= n * size) & (F.col("offset") < (n + 1) * size)))
    readings = jobs._watched(log.stream())
    out, path = str(tmp_path / "full"), str(tmp_path / "tables")
    write = stateful_alert_writer(path, 10, publish=sinks.message_writer(out), attach=lookback.with_measurements)
    start_query(readings, checkpoint=str(tmp_path / "c"), sink=write, trigger=None).awaitTermination()
    columns = "truck string, min_ts timestamp, max_ts timestamp, max_value double, " \
              "measurements array<struct<timestamp: timestamp, value: double>>"
    got = sinks.read_messages(spark, out, columns)
    readings = jobs._watched(log.table())
    found = alerts.stateful_alerts(readings, 10)
    history = readings.select("truck", F.col("_timestamp").alias("time"), "value")
    want = lookback.with_measurements(found, history).select(*got.columns[:5])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert read_alerts(spark, path).select("batch").distinct().count() == files
    rows.unpersist()


@pytest.fixture(scope="module")
def layouts(spark, sf_dir, tmp_path_factory):
    """The event table as a folder of unordered files, and as files in the order of time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    mixed, timed = (tmp_path_factory.mktemp(n) for n in ("mixed", "timed"))
    rows.repartition(4, F.xxhash64("event_id")).write.parquet(str(mixed / "events.parquet"))
    size = -(-rows.count() // 5)
    for n in range(5):
        part = rows.where((F.col("event_id") >= n * size) & (F.col("event_id") < (n + 1) * size))
        part.coalesce(1).write.mode("append").parquet(str(timed / "events.parquet"))
        time.sleep(0.02)
    return {"mixed": (str(mixed), None), "timed": (str(timed), 1)}


FROM_FILES = [n for n, f in queries.QUERIES.items() if n.startswith("stream_") and "files_per_trigger" in f.__code__.co_varnames]


@pytest.mark.parametrize("layout", ["mixed", "timed"])
@pytest.mark.parametrize("name", FROM_FILES)
def test_streams_do_not_depend_on_the_layout_of_files(spark, layouts, name, layout):
    path, files_per_trigger = layouts[layout]
    rows = spark.read.parquet(f"{path}/events.parquet")
    assert rows.count() == 1000 and len(rows.inputFiles()) in (4, 5)
    found = lambda spark, d: queries.QUERIES[name](spark, d, files_per_trigger)
    assert compare(spark, connect(path), found, ORACLES[name], path) is None


def test_complete_mode_is_refused_where_it_cannot_work(log):
    log.add(RISE)
    with pytest.raises(ValueError):
        jobs.start_stateful_truck_alerts(log.stream(), JobParams(output_mode="complete"), "unused", "unused")
    with pytest.raises(ValueError):
        start_query(log.stream(), checkpoint="unused", sink="console", output_mode="never")


def test_router_and_its_consumer(spark, log, tmp_path):
    ranges = {"SORTER": range(100, 111), "PICKER": range(120, 131), "DMS": range(140, 151)}
    sent = [signal(i, n, kind) for kind, ids in ranges.items() for i in ids for n in range(100)]
    log.add(sent)
    log.add(sent[:50])
    log.add([signal(1, 1, "OTHER")])
    for watermark in (None, "1 hour"):
        out = run(jobs.gateway(log.stream(), "json", watermark), tmp_path, name=f"route-{watermark}")
        routed = sinks.read_messages(spark, out, "topic string, value string")
        assert {r.topic: r["count"] for r in routed.groupBy("topic").count().collect()} == {
            "sorter": 1100, "picker": 1100, "dms": 1100}
    parsed = jobs.gateway_consumer(routed)
    assert parsed.where("id is null or timestamp is null").count() == 0
    query = jobs.start_gateway_consumer(log.stream(), JobParams(output_mode="append"), str(tmp_path / "m"), None, in_memory=True)
    query.processAllAvailable()
    query.stop()
    assert spark.table("gatewayConsumer").count() == 3351


def test_persister_job(spark, log, tmp_path):
    log.add([signal(i, n) for i in range(100, 111) for n in range(10)])
    log.add([signal(100, 0, "DMS", 77), signal(100, 0, "DMS", 78)])
    path = str(tmp_path / "signals")
    query = jobs.start_persister(log.stream(), JobParams(), str(tmp_path / "c"), path)
    query.processAllAvailable()
    query.stop()
    stored = sinks.read_signals(spark, path)
    assert stored.count() == 110
    assert [r["value"] for r in stored.where("signalType = 'DMS'").collect()] == [78]


@pytest.mark.parametrize("first, second", [("main", "backfill-2"), ("a", "b"), ("b", "a")])
def test_the_later_run_wins_whatever_its_name(spark, tmp_path, first, second):
    path = str(tmp_path / "t")
    for run, value in ((first, 5), (second, 6)):
        df = spark.createDataFrame([(1, T0, "A", value, "p")], sinks.SIGNAL_RECORD)
        for batch in range(3):
            sinks.batch_writer(path, "timestamp", run=run)(df, batch)
    assert [r["value"] for r in sinks.read_signals(spark, path).collect()] == [6]
    sinks.batch_writer(path, "timestamp", run=first)(df.withColumn("value", F.lit(7)), 9)  # an old run goes on
    assert [r["value"] for r in sinks.read_signals(spark, path).collect()] == [6]


def test_a_batch_has_few_files(spark, tmp_path):
    df = spark.range(20_000).select(
        F.col("id"), (F.lit(T0) + F.make_dt_interval(F.col("id") % 10)).alias("timestamp"), F.lit("A").alias("signalType"),
        F.lit(1).alias("value"), F.lit("p").alias("producerId")).repartition(8)
    sinks.batch_writer(str(tmp_path / "t"), "timestamp")(df, 0)
    files = len(list((tmp_path / "t").rglob("part-*")))
    assert files <= 10 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_repeated_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, T0, "A", 5, "p")], sinks.SIGNAL_RECORD)
    write = sinks.batch_writer(str(tmp_path / "t"), "timestamp", order=("id", "timestamp"))
    write(df, 0)
    write(df.withColumn("value", F.lit(6)), 1)
    write(df.withColumn("value", F.lit(6)), 1)
    rows = sinks.read_signals(spark, str(tmp_path / "t"))
    assert [r["value"] for r in rows.collect()] == [6]
    sinks.compact(rows, str(tmp_path / "small"), "timestamp")
    assert [r["value"] for r in sinks.read_signals(spark, str(tmp_path / "small")).collect()] == [6]


@pytest.mark.parametrize("mode, watermark", [("update", None), ("update", "10 minutes"), ("complete", None)])
def test_statistics_job(spark, log, tmp_path, mode, watermark):
    log.add([signal(i, n, value=n) for i in range(100, 201) for n in range(60)])
    log.add([signal(i, n, value=n) for i in range(100, 201) for n in range(60, 100)])
    path = str(tmp_path / "stats")
    query = jobs.start_signal_aggregation(
        log.stream(), JobParams(shuffle_partitions=4), str(tmp_path / "c"), path, watermark, mode)
    query.processAllAvailable()
    query.stop()
    stored = sinks.read_stats(spark, path).collect()
    assert {(r["count"], r.avg, r.min, r.max, r.sum) for r in stored} == {(100, 49.5, 0, 99, 4950)}
    assert len(stored) == 101


def test_counts_per_topic(spark, log, tmp_path):
    seen = []
    log.add(["x"] * 3, "a")
    log.add(["x"] * 2, "b")
    query = jobs.start_cumulative_count(
        log.stream(), JobParams(shuffle_partitions=4), str(tmp_path / "c"),
        sink=lambda b, i: seen.append({r.topic: r["count"] for r in b.collect()}))
    query.processAllAvailable()
    query.stop()
    assert seen[-1] == {"a": 3, "b": 2}


def test_point_loaders(spark, log, tmp_path):
    log.add([*RISE, reading(0, 6.0), {**reading(9, 1.0), "channel": "other"}, "bad"])
    params = JobParams(output_mode="update", shuffle_partitions=4)
    path = str(tmp_path / "points")
    jobs.start_truck_topic_to_points(log.stream(), params, str(tmp_path / "c1"), path, "j", "c").processAllAvailable()
    stored = sinks.read_points(spark, path)
    assert sorted(r["value"] for r in stored.collect()) == [6.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0]
    day = T0.date()
    assert sinks.read_points(spark, path, (day, day)).count() == 7
    assert sinks.read_points(spark, path, (day + timedelta(days=1), day + timedelta(days=2))).count() == 0

    # Alert messages in turn become points of their own.
    alert_log = Log(spark, tmp_path / "alert-log")
    for found in (jobs.truck_alerts(log.table(), params),):
        alert_log.add([r.value for r in found.collect()])
    path = str(tmp_path / "alert-points")
    jobs.start_truck_alerts_to_points(
        alert_log.stream(), params, str(tmp_path / "c2"), path, show=True).processAllAvailable()
    assert [(r.measurement, r["value"]) for r in sinks.read_points(spark, path).collect()] == [
        ("icd_alert_lift_motor_temp", 2.0)]

    history = points.history_of(stored, "T_motTemp_Lft")
    found = lookback.with_measurements(alerts.stateful_alerts(jobs._watched(log.table()), 10), history)
    stateful_log = Log(spark, tmp_path / "stateful-log")
    stateful_log.add([r.value for r in alerts.encode_stateful_alerts(found).collect()])
    path = str(tmp_path / "stateful-points")
    jobs.start_stateful_truck_alerts_to_points(
        stateful_log.stream(), params, str(tmp_path / "c3"), path).processAllAvailable()
    counts = {r.measurement: r["count"] for r in sinks.read_points(spark, path).groupBy("measurement").count().collect()}
    assert counts == {"icd_stateful_alert": 6, "icd_stateful_alert_time": 2, "icd_recorded_temp": 7}
    for query in spark.streams.active:
        query.stop()


def test_dedup_state_is_forgotten_behind_the_watermark(spark, log, tmp_path):
    log.add([signal(1, 0)])
    log.add([signal(1, 0), signal(2, 7200)])
    log.add([signal(3, 7201)])
    rows = signals.distinct_signals(jobs.gateway_consumer(log.stream()), "1 hour").drop("event_time")
    out = run(rows, tmp_path)
    assert sorted(r.id for r in sinks.read_messages(spark, out, "id bigint").collect()) == [1, 2, 3]


def test_topic_writer_needs_the_connector_only_when_started(log, tmp_path):
    """Without the Kafka connector the job still builds; starting it names what is missing."""
    log.add(RISE)
    stream = jobs.gateway(log.stream())
    try:
        start_to_topic(stream, name="gateway", checkpoint=str(tmp_path / "c"), params=JobParams(topics="a")).stop()
    except Exception as error:
        assert "kafka" in str(error).lower()
