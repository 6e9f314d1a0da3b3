"""The message log: Kafka where its connector is installed, or files of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.functions.text import json_text
from risewatch.plans.params import JobParams
from risewatch.schemas import LOG
from risewatch.sources import file_log


def kafka_options(params: JobParams) -> dict[str, str]:
    if not params.topics:
        raise ValueError("topics must be set")
    options = {
        "kafka.bootstrap.servers": params.bootstrap_servers,
        params.subscribe_mode: params.topics,
        "startingOffsets": params.starting_offsets,
        **params.extra,
    }
    if params.max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(params.max_offsets_per_trigger)
    return options


def file_log_options(params: JobParams) -> dict[str, str]:
    """The same settings for a log in files, which knows them by the same names."""
    options = {k: v for k, v in kafka_options(params).items() if not k.startswith("kafka.")}
    return {**options, "path": params.log_path}


def read_log_stream(spark: SparkSession, params: JobParams) -> DataFrame:
    """One unbounded stream over all subscribed topics, of the broker or of the files at ``params.log_path``."""
    if params.log_path is not None:
        file_log.register(spark)
        return spark.readStream.format(file_log.FORMAT).options(**file_log_options(params)).load()
    return spark.readStream.format("kafka").options(**kafka_options(params)).load()


def read_log(spark: SparkSession, params: JobParams, ending_offsets: str = "latest") -> DataFrame:
    """The same messages as a bounded table, for replays, up to the newest or to ``ending_offsets``."""
    options = kafka_options(params) if params.log_path is None else file_log_options(params)
    options.pop("maxOffsetsPerTrigger", None)
    if options["startingOffsets"] == "latest":
        raise ValueError("a bounded read cannot start at the latest offset")
    options["endingOffsets"] = ending_offsets
    if params.log_path is not None:
        file_log.register(spark)
        return spark.read.format(file_log.FORMAT).options(**options).load()
    return spark.read.format("kafka").options(**options).load()


def read_log_files(
    spark: SparkSession, path: str, *, streaming: bool = False, files_per_trigger: int | None = None
) -> DataFrame:
    """Log-shaped parquet, possibly laid out as ``topic=`` folders (one folder per topic)."""
    if not streaming:
        return spark.read.schema(LOG).parquet(path)
    reader = spark.readStream.schema(LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def to_log(
    rows: DataFrame,
    *body: Column | str,
    topic: Column | str,
    offset: Column | str,
    timestamp: Column | str,
    key: Column | None = None,
) -> DataFrame:
    """Rows as log messages whose value is the JSON of ``body``."""
    return rows.select(
        (F.lit(None) if key is None else key).cast("string").cast("binary").alias("key"),
        json_text(*body).cast("binary").alias("value"),
        F.col(topic).alias("topic") if isinstance(topic, str) else topic.alias("topic"),
        F.lit(0).alias("partition"),
        (F.col(offset) if isinstance(offset, str) else offset).cast("bigint").alias("offset"),
        (F.col(timestamp) if isinstance(timestamp, str) else timestamp).cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )
