from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from risewatch.functions.text import json_map, json_text, signal_timestamp
from risewatch.operators import partitioning, signals
from risewatch.operators.parsing import parse_readings, parse_signals
from risewatch.plans.params import JobParams
from risewatch.sources.log import kafka_options, read_log_files, to_log

T0 = datetime(2018, 1, 1, tzinfo=timezone.utc)
SIGNALS = "id bigint, timestamp string, signalType string, value int, producerId string, offset bigint"


def signal_rows(ranges, per_id):
    """Signals one second apart for every id of the ranges."""
    rows = []
    for signal_type, ids in ranges.items():
        for i in ids:
            for n in range(per_id):
                stamp = (T0 + timedelta(seconds=n)).strftime("%Y-%m-%dT%H:%M:%S.123Z")
                rows.append((i, stamp, signal_type, n, "p", len(rows)))
    return rows


RANGES = {"SORTER": range(100, 111), "PICKER": range(120, 131), "DMS": range(140, 151)}


def test_routes_get_eleven_hundred_each_and_duplicates_change_nothing(spark):
    rows = signal_rows(RANGES, 100)
    df = spark.createDataFrame(rows + rows + [(1, "t", "OTHER", 1, "p", 1)], SIGNALS)
    for once in (signals.distinct_signals(df), signals.first_signals(df)):
        counts = signals.route_signals(once).groupBy("topic").count().collect()
        assert {r.topic: r["count"] for r in counts} == {"sorter": 1100, "picker": 1100, "dms": 1100}


def test_first_signal_is_kept(spark):
    df = spark.createDataFrame([(1, "t", "A", 5, "x", 9), (1, "t", "A", 7, "y", 2)], SIGNALS)
    assert signals.first_signals(df).head()["value"] == 7


def test_payloads(spark):
    df = spark.createDataFrame([(1, "t", "DMS", 5, "x", 9)], SIGNALS)
    assert signals.route_signals(df).head()["value"] == "5"
    text = signals.route_signals(df, "json").head()["value"]
    assert text == '{"id":1,"timestamp":"t","signalType":"DMS","value":5,"producerId":"x"}'
    # The bare number is no signal, so a consumer of it gets nulls.
    log = spark.createDataFrame([(bytearray(b"5"),)], "value binary")
    assert set(parse_signals(log).head()) == {None}
    with pytest.raises(ValueError):
        signals.route_signals(df, "xml")


def test_persisted_rows(spark):
    df = spark.createDataFrame(signal_rows({"SORTER": range(100, 111)}, 10), SIGNALS)
    assert signals.signal_records(df).count() == 110


def test_same_second_of_an_id_keeps_the_last(spark):
    df = spark.createDataFrame(
        [(1, "2018-01-01T00:00:00.100Z", "SORTER", 1, "p", 1), (1, "2018-01-01 00:00:00.900", "DMS", 2, "q", 2),
         (2, "nonsense", "DMS", 3, "q", 3)], SIGNALS)
    got = signals.signal_records(df).collect()
    assert [(r.id, r.signalType, r["value"]) for r in got] == [(1, "DMS", 2)]


def test_stats_count_every_signal(spark):
    df = spark.createDataFrame(signal_rows({"SORTER": range(100, 201)}, 100), SIGNALS)
    stats = signals.signal_stats(df).collect()
    assert sum(r["count"] for r in stats) == 101 * 100
    one = [r for r in stats if r.id == 100]
    assert [(r["count"], r.avg, r.min, r.max, r.sum) for r in one] == [(100, 49.5, 0, 99, 4950)]


@pytest.mark.parametrize("text, second", [
    ("2018-01-01T00:00:00.123Z", 0), ("2018-01-01 00:00:09.9", 9), ("x", None), (None, None)])
def test_timestamp_text(spark, text, second):
    row = spark.createDataFrame([(text,)], "s string").select(signal_timestamp(F.col("s")).cast("long").alias("t")).head()
    assert row.t == (None if second is None else int(T0.timestamp()) + second)


def test_malformed_json_gives_nulls_and_keeps_the_row(spark):
    texts = ["bad", "123", '{"id": 1, "timestamp": "t", "value": "x", "producerId": "p", "more": 1}', None]
    log = spark.createDataFrame([(None if t is None else bytearray(t.encode()),) for t in texts], "value binary")
    got = [tuple(r) for r in parse_signals(log).collect()]
    nothing = (None,) * 5
    assert got == [nothing, nothing, (1, "t", None, None, "p"), nothing]


def test_reading_without_unit_and_with_zone(spark):
    text = '{"truck":"H","_timestamp":"2018-01-01T00:00:00.250-05:00","channel":"c","value":5.0}'
    log = spark.createDataFrame([(bytearray(text.encode()),)], "value binary")
    row = parse_readings(log).select("truck", F.unix_millis("_timestamp").alias("ms"), "value", "unit").head()
    assert tuple(row) == ("H", int((T0 + timedelta(hours=5)).timestamp() * 1000) + 250, 5.0, None)


def test_json_objects(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string").select(json_text("n", "s").alias("j"))
    assert df.select(json_map(F.col("j")).alias("m")).head().m == {"n": "1", "s": "a"}


def test_partition_numbers(spark):
    df = spark.range(-5, 5)
    by_index = df.select("id", partitioning.partition_number(4, index="id").alias("p")).collect()
    assert all(r.p == r.id % 4 for r in by_index)
    by_key = df.select(partitioning.partition_number(4, key="id").alias("p")).distinct().collect()
    assert {r.p for r in by_key} <= {0, 1, 2, 3}
    assert partitioning.evenly(df, 3).rdd.getNumPartitions() == 3
    spread = partitioning.by_key(df.withColumn("k", F.col("id") % 2), 4, "k")
    assert spread.select("k", F.spark_partition_id().alias("p")).distinct().count() == spread.select("k").distinct().count()
    with pytest.raises(ValueError):
        partitioning.partition_number(4)


def test_newest_first_within_key(spark):
    df = spark.createDataFrame([(i % 3, T0 + timedelta(seconds=i)) for i in range(50)], "id int, ts timestamp")
    rows = partitioning.newest_first(df, "id", "ts").withColumn("p", F.spark_partition_id()).collect()
    for a, b in zip(rows, rows[1:]):
        assert a.p != b.p or a.id < b.id or (a.id == b.id and a.ts >= b.ts)


def test_source_options():
    params = JobParams(topics="a,b", starting_offsets="latest", max_offsets_per_trigger=7, bootstrap_servers="h:1")
    assert kafka_options(params) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingOffsets": "latest", "maxOffsetsPerTrigger": "7"}
    pattern = JobParams(topics="t.*", subscribe_mode="subscribePattern", max_offsets_per_trigger=None)
    assert kafka_options(pattern) == {
        "kafka.bootstrap.servers": "localhost:9999", "subscribePattern": "t.*", "startingOffsets": "earliest"}
    with pytest.raises(ValueError):
        kafka_options(JobParams())


def test_parameters_are_checked():
    defaults = JobParams()
    assert (defaults.alert_threshold, defaults.output_mode, defaults.watermark) == (10, "complete", "60 minutes")
    assert (defaults.window, defaults.slide, defaults.trigger) == ("60 minutes", "60 minutes", "0 seconds")
    assert (defaults.max_offsets_per_trigger, defaults.output_topic, defaults.shuffle_partitions) == (
        50000, "default", 100)
    assert JobParams(extra={"database": "d"}).extra["database"] == "d"
    with pytest.raises(ValueError):
        JobParams(output_mode="sometimes")
    with pytest.raises(ValueError):
        JobParams(subscribe_mode="all")


def test_several_topics_are_one_log(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "n int, t string")
    log = to_log(df, "n", topic="t", offset="n", timestamp=F.current_timestamp())
    log.write.partitionBy("topic").parquet(str(tmp_path / "log"))
    counts = signals.topic_counts(read_log_files(spark, str(tmp_path / "log"))).collect()
    assert {r.topic: r["count"] for r in counts} == {"a": 5, "b": 5}
