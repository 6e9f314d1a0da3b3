"""Token ids as Parquet list columns that can be read selectively.

Files hold documents in ascending doc_id order, one ordered range of documents per file:

    doc_id long, n_tokens long (end id included), shard_start long, ids array<int>

`shard_start` counts the ids of the documents before it in the same file.  Integers are delta-encoded
(Parquet version 2 pages; token ids get a dictionary first as long as it pays), row groups and pages have
set sizes, and pages carry an index: a reader that filters on doc_id takes only the pages it needs, and
one that asks for the counts never touches the ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.llm.chunks import ChunkEncoder
from risewatch.llm.common import give_back, running_starts, slices

#: Chunks that a worker keeps from one task to the next: what the library need not encode again.
BETWEEN_TASKS = 150_000

FILE_SCHEMA = "doc_id bigint, n_tokens bigint, shard_start bigint, ids array<int>"


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """Encoder of a tokenizer file with a byte-level split, with the chunks this worker has seen."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    whole, tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
    for each in (whole, tokenizer):
        each.no_truncation()
        each.no_padding()
    tokenizer.encode_special_tokens = True  # chunks hold no control string; texts with one go to `whole`
    of_byte = _byte_letters()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        lengths[i] = len(token) if all(c in of_byte for c in token) else len(token.encode())

    def encode_new(firsts: list[str], rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Chunks behind a space follow each other in texts of some KB; the ids' byte lengths tell the
        # chunks apart again.  A text's first chunk stands alone.
        texts = [*firsts, *("".join(rests[i : i + 500]) for i in range(0, len(rests), 500))]
        found = [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, np.int32)
        upto = np.concatenate(([0], np.cumsum(lengths[ids])))
        sizes = np.cumsum(pc.binary_length(pa.array([*firsts, *rests], pa.string())).to_numpy(zero_copy_only=False).astype(np.int64))
        last = np.searchsorted(upto, sizes)
        return ids, np.diff(last, prepend=0)

    marks = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    return ChunkEncoder(
        encode_new, marks=marks, encode_whole=lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.int32)
    )


def _byte_letters() -> set[str]:
    """The 256 letters that stand for bytes in byte-level vocabularies: printable bytes stand for
    themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in plain} | {chr(256 + i) for i in range(256 - len(plain))}


def write(
    docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0,
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 500,
) -> None:
    """Encode every whole text of (doc_id, text), append the end id, and write the files to `out`.

    Control strings of the tokenizer inside a text get their own ids, as the library's plain call gives them.
    A null or empty text has the end id only; rows with equal doc_id (and null ids, which come first)
    are ordered by text; other columns are left out.  One range shuffle; tasks stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = encoder(tokenizer_path), 0
        for batch in slices(batches, "text", 8 << 20):
            flat, counts = encode.encode(batch.column("text"))
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype(np.int32)
            counts = counts + 1
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(start + ends - counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "n_tokens", "shard_start", "ids"],
            )
            start += int(ends[-1])
        encode.shrink(BETWEEN_TASKS)
        give_back()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # Ranges of doc_id alone: the keys are sampled on the driver, and texts have no place there.
    ordered = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    (
        ordered.mapInArrow(run, FILE_SCHEMA)
        .write.option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(out)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files; filters on doc_id reach the page index, unread columns stay unread."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_starts(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """Rows of the files with `start`, the number of ids of all documents before it.

    The files' totals come from the narrow columns alone and number one per file.  Files are ordered by
    their task number, which follows the ranges.
    """
    shard = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    totals = (
        read(spark, path).groupBy(shard.alias("_shard"))
        .agg(F.sum("n_tokens").alias("_n"))
    )
    starts = running_starts(totals, "_shard", "_n")
    rows = read(spark, path) if rows is None else rows
    return (
        rows.withColumn("_shard", shard)
        .join(F.broadcast(starts), "_shard")
        .withColumn("start", F.col("_start") + F.col("shard_start"))
        .drop("_shard", "_start")
    )


def digests(files: DataFrame) -> DataFrame:
    """Per document read from the files: doc_id, start, n_tokens, and the CRC-32 of its ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4", copy=False)
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = files.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
