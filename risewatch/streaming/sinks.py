"""Batch sinks for ``foreachBatch``: keyed tables in which the last write wins, and message files.

A keyed table is a folder of batches, ``seq=<number>/run=<label>/batch=<id>``, each written whole: a batch
that Spark repeats after a failure replaces itself, so every batch counts once.  Reading takes the newest
row per key.  Batch ids belong to a checkpoint; a query that starts with a new checkpoint takes a new
label, and the first write of a label gives it the next number, so later runs win whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risewatch.operators.points import latest_points
from risewatch.operators.signals import newest
from risewatch.streaming.run import BatchSink

SIGNAL_RECORD = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("signalType", T.StringType()),
    T.StructField("value", T.IntegerType()),
    T.StructField("producerId", T.StringType()),
])

STATS_RECORD = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("aggregate", T.TimestampType()),
    T.StructField("count", T.LongType()),
    T.StructField("avg", T.DoubleType()),
    T.StructField("min", T.IntegerType()),
    T.StructField("max", T.IntegerType()),
    T.StructField("sum", T.LongType()),
])

POINT_RECORD = T.StructType([
    T.StructField("measurement", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("time", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

_LABELS = [T.StructField("seq", T.LongType()), T.StructField("run", T.StringType()),
           T.StructField("batch", T.LongType()), T.StructField("date", T.DateType())]


def run_folder(spark: SparkSession, path: str, run: str) -> str:
    """The folder of a run; a label that is new to the table gets the number after the highest.

    Runs that write one table start one after another.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    highest = 0
    if files.exists(root):
        for folder in files.listStatus(root):
            name = folder.getPath().getName()
            if name.startswith("seq="):
                if files.exists(jvm.org.apache.hadoop.fs.Path(folder.getPath(), f"run={run}")):
                    return f"{path}/{name}/run={run}"
                highest = max(highest, int(name.removeprefix("seq=")))
    made = f"{path}/seq={highest + 1}/run={run}"
    files.mkdirs(jvm.org.apache.hadoop.fs.Path(made))
    return made


def batch_writer(
    path: str, time: str, shape: Callable[[DataFrame], DataFrame] | None = None, run: str = "main",
    order: tuple[str, ...] = (),
) -> BatchSink:
    """Write each batch, shaped, under its id and partitioned by the date of ``time``.

    Rows are clustered by date and then by ``order`` (key, then time), newest first, so a batch has about
    one file per range and date boundary rather than one per task and date.  Ranges are found by sampling,
    which would run the batch's own work, state included, a second time; so the batch is kept meanwhile.
    """
    order = order or (time,)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = (shape(batch) if shape else batch).withColumn("date", F.to_date(time))
        target = f"{run_folder(batch.sparkSession, path, run)}/batch={batch_id}"
        by = [F.col("date"), *[F.col(c) for c in order[:-1]], F.col(order[-1]).desc()]
        rows = rows.persist()
        try:
            ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
            ordered.write.mode("overwrite").partitionBy("date").parquet(target)
        finally:
            rows.unpersist()

    return write


def _read(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    schema = T.StructType([*record.fields, *_LABELS])
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    return rows.withColumn("version", F.struct("seq", "batch"))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """The signal table, one row per (id, timestamp)."""
    keys = ["id", "timestamp"]
    return newest(_read(spark, path, SIGNAL_RECORD), keys, "version", ["signalType", "value", "producerId"]).drop(
        "version"
    )


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics table, one row per (id, aggregate)."""
    values = ["count", "avg", "min", "max", "sum"]
    return newest(_read(spark, path, STATS_RECORD), ["id", "aggregate"], "version", values).drop("version")


def read_points(spark: SparkSession, path: str, dates: tuple | None = None) -> DataFrame:
    """The point table, one row per (measurement, tags, time); ``dates`` (first, last) skips other folders."""
    rows = _read(spark, path, POINT_RECORD)
    if dates is not None:
        rows = rows.where(F.col("date").between(*[F.lit(d) for d in dates]))
    return latest_points(rows, "version")


def compact(rows: DataFrame, path: str, time: str, order: tuple[str, ...] = (), run: str = "compacted") -> None:
    """Write a table that has been read as a single batch of a new folder, which then takes its place:
    one version per key, and files that number with the rows and not with the batches there were."""
    batch_writer(path, time, run=run, order=order)(rows, 0)


def message_writer(path: str, run: str = "main") -> BatchSink:
    """Messages as files, for where no broker is: ``value``, and ``key`` and ``topic`` where present."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return write


def read_messages(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What ``message_writer`` wrote, with its batch number."""
    return spark.read.schema(f"{columns}, run string, batch bigint").option("basePath", path).parquet(path)
