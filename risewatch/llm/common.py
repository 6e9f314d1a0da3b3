"""Bounded broadcasts, components and batch sizes: what several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.operators.ordering import ranked, running_starts, stage  # noqa: F401

#: Rows up to which a side of narrow rows (a few numbers each, some tens of MB) is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast of narrow rows if there are few of them, else leave the join to a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """The text's bytes; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): for every node of an edge the smallest node reachable from it.

    `edges` has two columns of numbers.  Alternates large and small stars until nothing changes:
    every node passes the smallest of its neighbours on to the others, so paths shrink by halves and
    a hub with very many edges is only ever aggregated.  Each round is written to the shared folder.
    """
    a, b = (F.col(c) for c in edges.columns)
    now = stage(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name
    )
    mark = _fingerprint(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small_star = large.join(lows, "u").select(
            F.explode(F.array(F.struct(linked.alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
            .alias("e")
        )
        now = stage(small_star.select("e.u", "e.v").where("u <> v").distinct(), name)
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.pmod(mixed, F.lit(1 << 20)))).first())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the strings of `column` in each piece hold about `most` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return a finished task's memory to the system: Python workers live on and keep what they grew to."""
    import ctypes
    import gc
    import sys

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):  # not every C library has it
            libc.malloc_trim(0)


def spanning(pairs_a, pairs_b, size: int):
    """For each of `size` positions the smallest position reachable over the pairs (a, b), or itself."""
    import numpy as np

    low = np.arange(size)
    while True:
        before = low.copy()
        np.minimum.at(low, pairs_a, before[pairs_b])
        np.minimum.at(low, pairs_b, before[pairs_a])
        low = low[low]
        if (low == before).all():
            return low


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by integer keys as tables of whole groups; only the last group met is held back."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        starts = group_starts(rows, keys)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield held


def group_starts(rows: pa.Table, keys: list[str]):
    """Where the groups of a table sorted by integer keys begin."""
    import numpy as np

    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for key in keys:
        change[1:] |= np.diff(rows.column(key).to_numpy()) != 0
    return np.flatnonzero(change)
