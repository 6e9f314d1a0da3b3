"""A message log of its own in files: a source with offsets and a transactional sink.

For where no broker is.  A log is a folder:

* ``data/…`` holds one Parquet file per task, topic and partition, with ``key, value, timestamp``;
* ``commits/<number>.json`` says which of them belong to the log.  A commit lists its files, each with its
  topic, partition, first offset and number of messages, where every partition ends after it, and the last
  batch of every run.

A message's offset is its file's first offset and its place in the file, so offsets are given out when a batch
is committed, gapless per partition.  Files of failed or repeated tasks are in no commit and so in no log.  A batch that
is committed again finds its number under its run's label and leaves nothing behind.  One query at a time writes a
log; any number read it.

``register`` makes the format "file_log" known to a session.  Options: ``path``; for reading ``subscribe`` (topics,
by comma), ``subscribePattern`` or ``assign`` (JSON, topic to partitions); ``startingOffsets`` "earliest", "latest" or
JSON (topic to partition to offset, -2 the earliest and -1 the latest; what it leaves out is read from the
earliest); for streams ``maxOffsetsPerTrigger`` and with it ``progress``, a file in which the source notes how far
it has gone, so that a restarted query keeps to the limit; for batches ``endingOffsets``; for writing ``partitions``
per topic, ``topic`` for rows without one, and ``run``, a label that a new checkpoint needs anew, as its batches
count from 0 again; a batch may give its number as ``batch``.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from risewatch.schemas import LOG
from risewatch.session import ship_package

FORMAT = "file_log"
EARLIEST, LATEST = -2, -1
#: Messages of one file that a task reads.
PER_TASK = 500_000

_MESSAGE = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC"))])
_ROW = pa.schema([
    ("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()),
    ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC")), ("timestampType", pa.int32()),
])

#: topic -> partition (as text, for JSON) -> offset
Offsets = dict[str, dict[str, int]]


@dataclass(frozen=True)
class Segment:
    """Messages of one partition in one file."""

    topic: str
    partition: int
    first: int
    count: int
    file: str


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")


class Commits:
    """The commits of a log, read as they come: a reader that goes on lists only what is new to it."""

    def __init__(self, path: str):
        self.files, self.path = _open(path)
        self.number = -1
        self.segments: dict[tuple[str, int], list[Segment]] = {}
        self.ends: Offsets = {}
        self.batches: dict[str, int] = {}

    def refresh(self) -> Commits:
        while True:
            place = f"{self.path}/commits/{self.number + 1:010d}.json"
            if self.files.get_file_info(place).type != pyarrow.fs.FileType.File:
                return self
            with self.files.open_input_stream(place) as source:
                body = json.loads(source.read())
            self.number += 1
            self.ends, self.batches = body["ends"], body["batches"]
            for segment in body["segments"]:
                found = Segment(**segment)
                self.segments.setdefault((found.topic, found.partition), []).append(found)

    def add(self, segments: list[Segment], run: str, batch: int) -> None:
        """Put a batch's files into the log, all at once: the commit appears under its name when it is whole."""
        ends = {t: dict(p) for t, p in self.ends.items()}
        for s in segments:
            ends.setdefault(s.topic, {})[str(s.partition)] = s.first + s.count
        body = {"segments": [asdict(s) for s in segments], "ends": ends, "batches": {**self.batches, run: batch}}
        self.files.create_dir(f"{self.path}/commits", recursive=True)
        draft = f"{self.path}/commits/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as out:
            out.write(json.dumps(body).encode())
        self.files.move(draft, f"{self.path}/commits/{self.number + 1:010d}.json")

    def between(self, start: Offsets, end: Offsets) -> list[Segment]:
        """The parts of files between two offsets."""
        found = []
        for topic, partitions in end.items():
            for partition, stop in partitions.items():
                low = start.get(topic, {}).get(partition, 0)
                for s in self.segments.get((topic, int(partition)), []):
                    first, last = max(low, s.first), min(stop, s.first + s.count)
                    found += [Piece(s, at, min(at + PER_TASK, last)) for at in range(first, last, PER_TASK)]
        return found


@dataclass(frozen=True)
class Piece(InputPartition):
    """Messages of a file from one offset to another."""

    segment: Segment
    start: int
    stop: int


def _chosen(options: dict, ends: Offsets) -> Offsets:
    """The topics and partitions asked for, with where they end."""
    modes = [m for m in ("subscribe", "subscribePattern", "assign") if options.get(m)]
    if len(modes) != 1:
        raise ValueError("give one of subscribe, subscribePattern, assign")
    asked = options[modes[0]]
    if modes[0] == "subscribe":
        names = {t.strip() for t in asked.split(",")}
        return {t: p for t, p in ends.items() if t in names}
    if modes[0] == "subscribePattern":
        return {t: p for t, p in ends.items() if re.fullmatch(asked, t)}
    wanted = {t: set(map(str, p)) for t, p in json.loads(asked).items()}
    return {t: {k: v for k, v in p.items() if k in wanted[t]} for t, p in ends.items() if t in wanted}


def _resolved(position: str, ends: Offsets) -> Offsets:
    """Offsets of a position: a word, or JSON in which -2 and -1 stand for the words."""
    if position in ("earliest", "latest"):
        return {t: {p: (0 if position == "earliest" else e) for p, e in of.items()} for t, of in ends.items()}
    given = json.loads(position)
    words = {EARLIEST: lambda e: 0, LATEST: lambda e: e}
    out: Offsets = {}
    for topic, of in ends.items():
        for partition, end in of.items():
            at = given.get(topic, {}).get(partition, EARLIEST)
            out.setdefault(topic, {})[partition] = words[at](end) if at in words else min(at, end)
    return out


def advanced(start: Offsets, end: Offsets, most: int | None) -> Offsets:
    """Where a batch of at most ``most`` messages ends: every partition's share is its part of all that waits."""
    lags = {(t, p): max(0, e - start.get(t, {}).get(p, 0)) for t, of in end.items() for p, e in of.items()}
    total = sum(lags.values())
    if most is None or total <= most:
        return end
    shares = {k: lag * most // total for k, lag in lags.items()}
    left = most - sum(shares.values())
    for k in sorted(lags, key=lambda k: (-lags[k], k)):  # what rounding left over goes to the largest
        more = min(left, lags[k] - shares[k])
        shares[k], left = shares[k] + more, left - more
    return {t: {p: start.get(t, {}).get(p, 0) + shares[t, p] for p in of} for t, of in end.items()}


def _rows(path: str, piece: Piece | None) -> Iterator[pa.RecordBatch]:
    if piece is None:  # what Spark asks for where there is nothing to read
        return
    files, base = _open(path)
    s = piece.segment
    at = s.first
    with pq.ParquetFile(files.open_input_file(f"{base}/{s.file}")) as source:
        for batch in source.iter_batches(10_000):
            low, high = max(piece.start - at, 0), min(piece.stop - at, batch.num_rows)
            if low < high:
                part, n = batch.slice(low, high - low), high - low
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("value"), pa.array([s.topic] * n), pa.array([s.partition] * n, pa.int32()),
                    pa.array(range(at + low, at + high), pa.int64()), part.column("timestamp").cast(_ROW.field("timestamp").type),
                    pa.array([0] * n, pa.int32()),
                ], schema=_ROW)
            at += batch.num_rows


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.commits = Commits(self.path)
        self.most = int(options["maxoffsetspertrigger"]) if "maxoffsetspertrigger" in options else None
        if self.most is not None and "progress" not in options:
            raise ValueError("a limit per trigger needs a progress file, without which a restarted query could not keep to it")
        self.start: Offsets | None = None
        self.at: Offsets | None = None

    def _ends(self) -> Offsets:
        return _chosen(_named(self.options), self.commits.refresh().ends)

    def _start(self, ends: Offsets) -> Offsets:
        """Where a new query begins; settled once, as Spark may ask for the end of its first batch before."""
        if self.start is None:
            self.start = _resolved(self.options.get("startingoffsets", "earliest"), ends)
        return self.start

    def initialOffset(self) -> dict:
        return self._start(self._ends())

    def latestOffset(self) -> dict:
        ends = self._ends()
        if self.most is None:
            return ends
        if self.at is None:
            self.at = self._noted() or self._start(ends)
        self.at = advanced(self.at, ends, self.most)
        self._note()
        return self.at

    def _noted(self) -> Offsets | None:
        """How far an earlier run of the query had gone; it is noted before Spark hears of it."""
        files, place = _open(self.options["progress"])
        if files.get_file_info(place).type != pyarrow.fs.FileType.File:
            return None
        with files.open_input_stream(place) as source:
            return json.loads(source.read())

    def _note(self) -> None:
        files, place = _open(self.options["progress"])
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(place) as out:
            out.write(json.dumps(self.at).encode())

    def partitions(self, start: dict, end: dict) -> list:
        self.commits.refresh()
        return self.commits.between(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)

    def __getstate__(self) -> dict:
        return {"options": self.options, "path": self.path}  # tasks only read


class _Table(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]

    def partitions(self) -> list:
        commits = Commits(self.path).refresh()
        ends = _chosen(_named(self.options), commits.ends)
        start = _resolved(self.options.get("startingoffsets", "earliest"), ends)
        return commits.between(start, _resolved(self.options.get("endingoffsets", "latest"), ends))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)


@dataclass
class _Written(WriterCommitMessage):
    """What a task wrote: (topic, partition, messages, file)."""

    files: list[tuple[str, int, int, str]]


class _Writer(DataSourceStreamArrowWriter):
    """Files from tasks, and a commit of all of them from the driver."""

    def __init__(self, options: dict):
        self.path, self.run = options["path"], options.get("run", "main")
        self.number, self.topic = int(options.get("partitions", 1)), options.get("topic")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """One file for each topic and partition that the task's messages go to, in their order."""
        files, base = _open(self.path)
        files.create_dir(f"{base}/data", recursive=True)
        open_: dict = {}
        turn = 0
        for batch in iterator:
            names = batch.schema.names
            count = batch.num_rows
            values = batch.column("value").cast(pa.binary())
            keys = batch.column("key").cast(pa.binary()) if "key" in names else pa.nulls(count, pa.binary())
            topics = batch.column("topic").to_pylist() if "topic" in names else [self.topic] * count
            now = pa.array([_now()] * count, _MESSAGE.field("timestamp").type)
            times = batch.column("timestamp").cast(now.type) if "timestamp" in names else now
            rows: dict = {}
            for i, (topic, key) in enumerate(zip(topics, keys.to_pylist())):
                if topic is None and self.topic is None:
                    raise ValueError("a message has no topic")
                # Equal keys share a partition; messages without a key take turns.
                turn += key is None
                partition = (zlib.crc32(key) if key is not None else turn) % self.number
                rows.setdefault((topic or self.topic, partition), []).append(i)
            table = pa.RecordBatch.from_arrays([keys, values, times], schema=_MESSAGE)
            for to, places in rows.items():
                if to not in open_:
                    name = f"data/{uuid.uuid4().hex}.parquet"
                    open_[to] = [pq.ParquetWriter(files.open_output_stream(f"{base}/{name}"), _MESSAGE), 0, name]
                open_[to][0].write_batch(table.take(pa.array(places)))
                open_[to][1] += len(places)
        for writer, _, _ in open_.values():
            writer.close()
        return _Written([(topic, partition, n, name) for (topic, partition), (_, n, name) in open_.items()])

    def commit(self, messages: list, batchId: int) -> None:
        commits = Commits(self.path).refresh()
        if commits.batches.get(self.run, -1) >= batchId:  # committed before a failure
            self.abort(messages, batchId)
            return
        ends = {(t, int(p)): e for t, of in commits.ends.items() for p, e in of.items()}
        segments = []
        for message in messages:
            for topic, partition, n, name in message.files if message else []:
                first = ends.get((topic, partition), 0)
                segments.append(Segment(topic, partition, first, n, name))
                ends[topic, partition] = first + n
        commits.add(segments, self.run, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        files, base = _open(self.path)
        for message in messages:
            for _, _, _, name in message.files if message else []:
                files.delete_file(f"{base}/{name}")


class _BatchWriter(DataSourceArrowWriter):
    """The same for one batch.  With the option ``batch``, its number, a repeated one counts once."""

    def __init__(self, options: dict):
        self.writer, self.batch = _Writer(options), options.get("batch")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return self.writer.write(iterator)

    def commit(self, messages: list) -> None:
        number = int(self.batch) if self.batch is not None else Commits(self.writer.path).refresh().batches.get(self.writer.run, -1) + 1
        self.writer.commit(messages, number)

    def abort(self, messages: list) -> None:
        self.writer.abort(messages, -1)


def _now():
    from datetime import datetime, timezone

    return datetime.now(timezone.utc)


def _named(options: dict) -> dict:
    """Subscription options under their names; Spark hands options on in lower case."""
    lower = {k.lower(): v for k, v in options.items()}
    return {m: lower[m.lower()] for m in ("subscribe", "subscribePattern", "assign") if m.lower() in lower}


class FileLog(DataSource):
    """The data source of the format."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _lower(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def schema(self):
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return _Table(self._lower())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._lower())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self._lower())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Writer(self._lower())


def ends(path: str, options: dict) -> Offsets:
    """Where the topics and partitions that options ask for end now."""
    return _chosen(_named(options), Commits(path).refresh().ends)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(FileLog)


def unreferenced(path: str) -> list[str]:
    """Files that failed or repeated tasks have left; no commit names them.  For use while no query writes."""
    commits = Commits(path).refresh()
    known = {s.file for of in commits.segments.values() for s in of}
    files, base = commits.files, commits.path
    found = files.get_file_info(pyarrow.fs.FileSelector(f"{base}/data", allow_not_found=True))
    return sorted(f"data/{f.base_name}" for f in found if f"data/{f.base_name}" not in known)
