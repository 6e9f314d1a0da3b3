"""The log in files: offsets, limits, restarts, and commits of whole batches."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from risewatch.plans.params import JobParams
from risewatch.sources import file_log
from risewatch.sources.file_log import Commits, advanced, unreferenced
from risewatch.sources.log import read_log
from risewatch.streaming.run import finish, start_to_topic, topic_sink

T0 = datetime(2018, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def log(spark, tmp_path):
    file_log.register(spark)
    return str(tmp_path / "log")


class Feed:
    """Batches of messages into a log, each through a stream over files."""

    def __init__(self, spark, tmp_path, log, **options):
        self.spark, self.base, self.log, self.options = spark, tmp_path, log, {"partitions": 2, **options}
        self.number = 0

    def add(self, rows, spoil=None):
        """rows: (topic, key, value)"""
        self.number += 1
        source = str(self.base / "source")
        self.spark.createDataFrame(rows, "topic string, key string, value string").coalesce(1).write.mode("append").parquet(source)
        stream = self.spark.readStream.schema("topic string, key string, value string").parquet(source)
        if spoil is not None:
            stream = stream.withColumn("value", spoil)
        write = stream.repartition(3, "value").writeStream.format("file_log").option("path", self.log).options(**self.options)
        write.option("checkpointLocation", str(self.base / "write")).trigger(availableNow=True).start().awaitTermination()


def read(spark, log, **options):
    return spark.read.format("file_log").option("path", log).options(**{"subscribePattern": ".*", **options}).load()


def values(df):
    return sorted(r.value.decode() for r in df.collect())


def test_offsets_are_gapless_and_topics_and_positions_are_chosen(spark, tmp_path, log):
    feed = Feed(spark, tmp_path, log)
    feed.add([("a", f"k{i % 5}", f"a{i}") for i in range(40)] + [("b", None, f"b{i}") for i in range(10)])
    feed.add([("a", f"k{i % 5}", f"a{i}") for i in range(40, 60)] + [("c", None, "c0")])
    rows = read(spark, log).collect()
    assert len(rows) == 71
    by: dict = {}
    for r in rows:
        by.setdefault((r.topic, r.partition), []).append(r.offset)
    assert all(sorted(o) == list(range(len(o))) for o in by.values())
    places = {}
    for r in rows:
        if r.key is not None:
            places.setdefault(bytes(r.key), set()).add(r.partition)
    assert all(len(p) == 1 for p in places.values())  # equal keys share a partition
    assert values(read(spark, log, subscribePattern=".*", startingOffsets="latest")) == []
    only = spark.read.format("file_log").option("path", log)
    assert len(values(only.option("subscribe", "b, c").load())) == 11
    assert {r.partition for r in spark.read.format("file_log").option("path", log).option("assign", '{"a": [1]}').load().collect()} == {1}
    start = {"a": {"0": 3, "1": file_log.LATEST}, "b": {"0": file_log.EARLIEST, "1": file_log.LATEST}}
    found = read(spark, log, startingOffsets=json.dumps(start), endingOffsets=json.dumps({"a": {"0": 5, "1": -1}, "b": {"0": 2, "1": -1}, "c": {"0": 0, "1": 0}})).collect()
    assert sorted((r.topic, r.partition, r.offset) for r in found) == [("a", 0, 3), ("a", 0, 4), ("b", 0, 0), ("b", 0, 1)]
    with pytest.raises(Exception, match="give one of"):
        spark.read.format("file_log").option("path", log).load().count()


def consume(spark, log, base, **options):
    """Read what is there in batches; the batches' sizes."""
    sizes = []
    stream = spark.readStream.format("file_log").option("path", log).options(
        **{"subscribePattern": ".*", "progress": f"{base}/progress.json", **options}).load()
    out = str(base / "out")

    def write(batch, batch_id):
        batch.select("topic", "partition", "offset", F.col("value").cast("string").alias("value")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        sizes.append(batch.count())

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(base / "read")).trigger(processingTime="0 seconds").start()
    finish(query, log, {"subscribePattern": ".*"})
    return sizes, spark.read.parquet(out)


def test_streams_keep_to_the_limit_and_go_on_after_a_restart(spark, tmp_path, log):
    feed = Feed(spark, tmp_path, log)
    feed.add([("a", f"k{i}", f"a{i}") for i in range(90)] + [("b", f"k{i}", f"b{i}") for i in range(30)])
    sizes, got = consume(spark, log, tmp_path, maxOffsetsPerTrigger=50)
    assert sizes == [50, 50, 20] and got.select("topic", "partition", "offset").distinct().count() == 120
    feed.add([("a", f"k{i}", f"a{i}") for i in range(90, 160)])
    sizes, got = consume(spark, log, tmp_path, maxOffsetsPerTrigger=50)
    assert sizes == [50, 20]
    assert sorted(r["value"] for r in got.collect()) == sorted([f"a{i}" for i in range(160)] + [f"b{i}" for i in range(30)])


def test_a_limit_counts_from_where_a_stream_starts(spark, tmp_path, log):
    feed = Feed(spark, tmp_path, log, partitions=1)
    feed.add([("a", None, f"a{i}") for i in range(60)] + [("b", None, f"b{i}") for i in range(60)])
    sizes, got = consume(spark, log, tmp_path, startingOffsets='{"a": {"0": 20}, "b": {"0": -1}}', maxOffsetsPerTrigger=25)
    assert sizes == [25, 15] and sorted(r["offset"] for r in got.collect()) == list(range(20, 60))
    with pytest.raises(Exception, match="progress file"):
        stream = spark.readStream.format("file_log").option("path", log).option("subscribe", "a").option("maxOffsetsPerTrigger", 5).load()
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()


def test_a_stream_starts_in_the_middle_and_sees_new_partitions(spark, tmp_path, log):
    feed = Feed(spark, tmp_path, log, partitions=1)
    feed.add([("a", None, f"a{i}") for i in range(10)])
    start = json.dumps({"a": {"0": 7}})
    sizes, got = consume(spark, log, tmp_path, startingOffsets=start)
    assert sizes == [3]
    feed.add([("new", None, "n0")])
    sizes, got = consume(spark, log, tmp_path, startingOffsets=start)
    assert sorted(r["offset"] for r in got.where("topic = 'a'").collect()) == [7, 8, 9]
    assert got.where("topic = 'new'").count() == 1


def test_a_failing_task_leaves_no_message(spark, tmp_path, log):
    feed = Feed(spark, tmp_path, log)
    feed.add([("a", None, f"a{i}") for i in range(30)])
    broken = F.when(F.col("value") == "x7", F.raise_error(F.lit("broken"))).otherwise(F.col("value"))
    with pytest.raises(Exception, match="broken"):
        feed.add([("a", None, f"x{i}") for i in range(30)], spoil=broken)
    assert len(values(read(spark, log))) == 30
    feed.add([("a", None, "y0")])  # the batch that failed runs again, whole
    got = values(read(spark, log))
    assert got == sorted([f"a{i}" for i in range(30)] + [f"x{i}" for i in range(30)] + ["y0"])


def test_a_batch_that_is_committed_again_counts_once(spark, tmp_path, log):
    feed = Feed(spark, tmp_path, log)
    feed.add([("a", None, f"a{i}") for i in range(30)])
    (tmp_path / "write" / "commits" / "0").unlink()  # as if the query had ended between the two commits
    for crc in (tmp_path / "write" / "commits").glob(".0*"):
        crc.unlink()
    feed.add([("a", None, "z")])
    assert values(read(spark, log)) == sorted([*(f"a{i}" for i in range(30)), "z"])
    assert unreferenced(log) == []


def test_jobs_write_whole_batches_and_a_new_checkpoint_is_a_new_run(spark, tmp_path, log):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "1"), ("b", "2")], "topic string, value string").coalesce(1).write.parquet(source)
    params = JobParams(log_path=log, topics="a,b", trigger=None)
    for name in ("one", "two"):
        stream = spark.readStream.schema("topic string, value string").parquet(source)
        start_to_topic(stream, name="job", checkpoint=str(tmp_path / name), params=params).awaitTermination()
    assert values(read_log(spark, params)) == ["1", "1", "2", "2"]
    for batch_id in (0, 0, 1):
        topic_sink(params, "own")(spark.createDataFrame([("a", "3")], "topic string, value string"), batch_id)
    assert values(read_log(spark, params)) == ["1", "1", "2", "2", "3", "3"]


def test_shares_of_a_limit():
    ends = {"a": {"0": 100, "1": 10}, "b": {"0": 5}}
    now = {"a": {"0": 0, "1": 10}, "b": {"0": 0}}
    for _ in range(3):
        after = advanced(now, ends, 40)
        assert sum(after[t][p] - now[t][p] for t in ends for p in ends[t]) == min(40, sum(ends[t][p] - now[t][p] for t in ends for p in ends[t]))
        now = after
    assert now == ends and advanced(now, ends, 5) == ends and advanced({}, ends, None) == ends
    assert Commits("/nowhere").refresh().ends == {}
