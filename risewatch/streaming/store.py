"""Readings kept from batch to batch, with a small index of which folder holds what time.

A store is a folder with ``data/batch=<id>/date=…`` and ``index/<id>.json``.  The index of a batch names the
folders that are still live, with the least and the greatest time in each, and the newest time seen by then.
Reading a stretch of time therefore lists the folders that reach into it and no others, however many batches
there have been.  A batch that Spark repeats reads the index before its own, and replaces its own folder and index.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.operators.ordering import written


@dataclass(frozen=True)
class Folder:
    """One batch's readings; times in microseconds."""

    batch: int
    first: int
    last: int
    rows: int


@dataclass(frozen=True)
class Index:
    folders: tuple[Folder, ...] = ()
    newest: int | None = None


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system, which may be any that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, files = _hadoop(spark, path)
    out = files.create(place, True)
    out.write(bytearray(text, "utf8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    place, files = _hadoop(spark, path)
    if not files.exists(place):
        return None
    source = files.open(place)
    data = source.readAllBytes()
    source.close()
    return bytes(data).decode("utf8")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    place, files = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


class ReadingStore:
    """``truck, time, value`` of the last batches."""

    SCHEMA = "truck string, time timestamp, value double, batch bigint, date date"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def index(self, batch_id: int) -> Index:
        """What was live once a batch was stored; nothing before the first."""
        text = None if batch_id < 0 else read_text(self.spark, f"{self.path}/index/{batch_id}.json")
        if text is None:
            return Index()
        found = json.loads(text)
        return Index(tuple(Folder(**f) for f in found["folders"]), found["newest"])

    def append(self, rows: DataFrame, batch_id: int, horizon: int | None = None) -> Index:
        """Store a batch's readings.  Folders of readings before ``horizon`` only (microseconds; None: none) leave
        the index, and are deleted one batch later, when no repeated batch can ask for them any more."""
        folder = f"{self.path}/data/batch={batch_id}"
        dated = rows.select("truck", "time", "value", F.to_date("time").alias("date"))
        us = F.unix_micros("time")
        own = written(dated, folder, {"first": F.min(us), "last": F.max(us), "rows": F.count(us)}, partitionBy="date")
        before = self.index(batch_id - 1)
        newest = max((t for t in (before.newest, own["last"]) if t is not None), default=None)
        folders = [f for f in before.folders if f.batch != batch_id]
        if own["rows"]:
            folders.append(Folder(batch_id, own["first"], own["last"], own["rows"]))
        if horizon is not None:
            folders = [f for f in folders if f.last >= horizon]
        now = Index(tuple(folders), newest)
        body = {"folders": [asdict(f) for f in now.folders], "newest": now.newest}
        write_text(self.spark, f"{self.path}/index/{batch_id}.json", json.dumps(body))
        live = {f.batch for f in before.folders} | {batch_id}
        for gone in {f.batch for f in self.index(batch_id - 2).folders} - live:
            remove(self.spark, f"{self.path}/data/batch={gone}")
        remove(self.spark, f"{self.path}/index/{batch_id - 3}.json")
        return now

    def _read(self, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.SCHEMA)
        reader = self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.path}/data")
        return reader.parquet(*(f"{self.path}/data/batch={b}" for b in batches))

    def batch(self, batch_id: int) -> DataFrame:
        return self._read([batch_id])

    def between(self, index: Index, first: int | None = None, last: int | None = None) -> DataFrame:
        """The readings of an index's folders between two times (microseconds, both inclusive)."""
        reach = [f.batch for f in index.folders
                 if (first is None or f.last >= first) and (last is None or f.first <= last)]
        rows = self._read(reach)
        for bound, keeps in ((first, lambda c, b: c >= b), (last, lambda c, b: c <= b)):
            if bound is not None:
                instant = F.timestamp_micros(F.lit(bound))
                rows = rows.where(keeps(F.col("time"), instant) & keeps(F.col("date"), F.to_date(instant)))
        return rows
