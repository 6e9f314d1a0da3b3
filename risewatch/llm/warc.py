"""Web archives as seekable Zstandard bundles.

A bundle is one WARC file.  Its records are grouped into frames of about `frame_bytes`, each compressed on
its own, and a seek table of the frames' sizes ends the file in a skippable frame (the published seekable
format: any Zstandard reader sees plain WARC).  An index table maps every record identifier to its bundle,
its frame, and its offset inside the frame, so one record costs the reading of one frame.

Tasks write their bundles straight to the shared folder under names of their own and report them in the
index.  Spark commits the index, so a bundle of a lost or repeated task is in no index and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import slices, small, stage, utf8

# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = (
    "page_id bigint, record_id string, bundle string, frame int, frame_start bigint, frame_size bigint, "
    "offset bigint, length bigint"
)
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    """Identifier of a page's record; without a page_id it follows the payload."""
    name = f"page {page_id}" if page_id is not None else f"payload {payload_digest}"
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """(identifier, record) of one page: a response, or a revisit of the page `refers_to`."""
    mark = digest(payload)
    name = record_id(page_id, mark)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {uri}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{mark}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to, mark)}>", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of one frame: headers by lower-case name, `payload_bytes`, and `payload` of responses."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = data[end + 4 : end + 4 + int(fields["content-length"])]
        at = end + 4 + len(block) + 4
        head, _, payload = block.partition(b"\r\n\r\n")
        fields["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", head)[1])
        fields["payload"] = payload if fields["warc-type"] == "response" else None
        yield fields


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle, from (compressed, whole) sizes."""
    entries = b"".join(struct.pack("<II", *x) for x in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(file) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the end of a random-access file."""
    size = file.size()
    number, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    entries = struct.iter_unpack("<II", file.read_at(8 * number, size - 9 - 8 * number))
    starts, at = [], 0
    for packed, _ in entries:
        starts.append((at, packed))
        at += packed
    return starts


def write(pages: DataFrame, out: str, least_bytes: int = 0, frame_bytes: int = 1 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of (page_id, url, html) below `out`; returns the committed index.

    The payload is the html in UTF-8, empty for null.  Of records with equal payloads of `least_bytes` or
    more, that with the largest page_id is the response and the others revisit it; smaller payloads are all
    responses.  Repeated rows of the largest page_id are all responses.  A row without page_id may revisit
    but is not revisited.  Other columns are left out.  A payload is held once at a time and lies in
    one frame, however long it is.
    """
    rows = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("mark", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("mark").agg(
        F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")
    )
    tops = stage(groups.where("n > 1 AND top IS NOT NULL").select("mark", "top"), "warc-groups")
    rows = rows.join(small(tops), "mark", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))
    folder = f"{out}/bundles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        bundle = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
        frames: list[tuple[int, int]] = []
        packer, start = zstandard.ZstdCompressor(level=3), 0
        held: list[tuple] = []
        data = bytearray()

        def flush() -> pa.RecordBatch:
            nonlocal start
            packed = packer.compress(bytes(data))
            file.write(packed)
            rows = [(p, r, bundle, len(frames), start, len(packed), at, n) for p, r, at, n in held]
            frames.append((len(packed), len(data)))
            start += len(packed)
            held.clear()
            data.clear()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["page_id", "record_id", "bundle", "frame", "frame_start", "frame_size", "offset", "length"],
            )

        file = None
        for batch in slices(batches, "payload"):
            if file is None:
                file = store.open_output_stream(f"{path}/{bundle}", compression=None)
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                name, text = record(page_id, url, payload, refers_to, date)
                held.append((page_id, name, len(data), len(text)))
                data += text
                if len(data) >= frame_bytes:
                    yield flush()
        if file is not None:
            if data:
                yield flush()
            file.write(seek_table(frames))
            file.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{out}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{out}/index")


def read(index: DataFrame, out: str) -> DataFrame:
    """All records of the bundles of an index: page_id, payload_bytes, payload_digest, record_type,
    refers_to.  The bundles' seek tables give the frames, which are then read independently."""
    folder = f"{out}/bundles"

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = []
            for bundle in batch.column("bundle").to_pylist():
                with store.open_input_file(f"{path}/{bundle}") as file:
                    found += [(bundle, start, size) for start, size in read_seek_table(file)]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                ["bundle", "start", "size"],
            )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, start, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(
                        zip(*map(_row, parse(_frame(store, f"{path}/{bundle}", start, size)))),
                        [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()],
                    )],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    frames = index.select("bundle", "frame_start").distinct().count()
    bundles = _over_tasks(index.select("bundle").distinct(), frames)
    found = bundles.mapInArrow(tables, "bundle string, start bigint, size bigint")
    return _over_tasks(found, frames).mapInArrow(records, RECORDS)


#: Frames that a task reads one after another, where there are more than cores.
FRAMES_PER_TASK = 32


def _over_tasks(rows: DataFrame, frames: int) -> DataFrame:
    """Small rows that stand for much work, in turn over as many tasks as the work wants.  A stated number is
    not made smaller by adaptive execution, which would go by the rows' bytes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(frames, cores), -(-frames // FRAMES_PER_TASK)))


def _frame(store, path: str, start: int, size: int) -> bytes:
    import zstandard

    with store.open_input_file(path) as file:
        return zstandard.ZstdDecompressor().decompress(file.read_at(size, start))


def _row(fields: dict) -> tuple:
    payload, mark = fields["payload"], fields["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and (digest(payload) != mark or len(payload) != fields["payload_bytes"]):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("x-page-id"), fields["payload_bytes"], mark, fields["warc-type"], number("x-refers-to-page")


def read_records(index: DataFrame, out: str, wanted: DataFrame) -> DataFrame:
    """(record_id, record binary) of the identifiers in `wanted` (record_id): each frame that holds one
    is read once, and the records are cut out of it by their offsets."""
    folder = f"{out}/bundles"
    places = index.join(wanted.select("record_id").distinct(), "record_id").select(
        "bundle", "frame_start", "frame_size", "offset", "length", "record_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        now, data = None, b""
        for batch in batches:
            found = []
            for bundle, start, size, offset, length, name in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (bundle, start) != now:
                    now, data = (bundle, start), _frame(store, f"{path}/{bundle}", start, size)
                found.append((name, data[offset : offset + length]))
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], ["record_id", "record"])

    places = stage(places, "warc-places")
    frames = places.groupBy("bundle", "frame_start").agg(F.collect_list(F.struct("frame_size", "offset", "length", "record_id")).alias("records"))
    frames = stage(frames, "warc-frames")
    places = _over_tasks(frames, frames.count()).select("bundle", "frame_start", F.inline("records")).select(
        "bundle", "frame_start", "frame_size", "offset", "length", "record_id"
    )
    return places.mapInArrow(run, "record_id string, record binary")
