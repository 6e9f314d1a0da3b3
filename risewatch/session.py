"""Session settings the library relies on, and the shared folder it writes work files to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings that results depend on; everything else stays as the cluster set it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    ship_package(spark)
    return spark


def on_one_machine(spark: SparkSession) -> bool:
    """Whether the driver runs all tasks itself."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """Send this package to a cluster's Python workers, once per Spark context.

    Tasks import the modules their functions come from, which on a cluster need not be installed.
    """
    context = spark.sparkContext
    if on_one_machine(spark) or getattr(context, "_risewatch_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="risewatch-"), "risewatch"), "zip",
        os.path.dirname(package), os.path.basename(package),
    )
    context.addPyFile(archive)  # Spark's own file server hands it out
    context._risewatch_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and work tables, which all executors must see.

    A cluster names it in ``spark.checkpoint.dir``; without that setting and a checkpoint directory a
    cluster is refused.  Where the driver runs all tasks itself a local one is made and kept for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="risewatch-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def shuffle_partitions(spark: SparkSession, number: int | None) -> Iterator[None]:
    """Plan what is started inside with this many shuffle partitions.

    A streaming query keeps the number it was first started with, one state store per partition.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    if number is not None:
        spark.conf.set(setting, number)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Plan what runs inside adaptively.

    A streaming query's session has that switched off for the sake of its state; the batch work of a sink
    without state upstream has no reason to go without.
    """
    setting = "spark.sql.adaptive.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
