"""Work tables and positions in a global order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from risewatch.session import run_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: cuts the lineage, survives lost executors."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, sums: dict[str, Column], **options) -> dict:
    """Write rows as parquet, replacing what is there, and give aggregates over them taken on the way."""
    seen = Observation()
    rows = df.observe(seen, *(c.alias(n) for n, c in sums.items()))
    rows.write.mode("overwrite").parquet(path, **options)
    return seen.get


def stage_counting(df: DataFrame, name: str, sums: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``stage``, and aggregates over the rows taken on the way."""
    path = run_dir(df.sparkSession, name)
    found = written(df, path, sums)
    return df.sparkSession.read.schema(df.schema).parquet(path), found


def estimated_bytes(df: DataFrame) -> int:
    """How large Spark's optimizer takes a table to be, which also decides its broadcasts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add `rank`, the gapless position from 0 in the given order, over one range shuffle.

    Rows are range-partitioned and sorted, their places within the partitions are written out with
    them, and the partitions' sizes, one row each, are summed up.  No task sees more than one range.
    Rows that tie in `order` get their ranks in any order, so the order should be total.
    """
    place = F.monotonically_increasing_id()  # partition number << 33 | place in the partition
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), name)
    part = F.shiftrightunsigned("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = running_starts(sizes, "_part", "_n")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_place", "_start")
    )


def running_starts(sizes: DataFrame, key: str, number: str) -> DataFrame:
    """(key, _start): the sum of `number` over smaller keys.  For one row per partition or file only:
    that many rows, bounded by the partition count, pass the driver."""
    spark = sizes.sparkSession
    start, rows = 0, []
    for k, n in sorted((row[key], row[number]) for row in sizes.collect()):
        rows.append((k, start))
        start += n
    return spark.createDataFrame(rows, f"`{key}` bigint, _start bigint")


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add `position`, the place from 0 of each row within its group, whatever the group's size.

    All groups are ranked in one global order, so a group that holds most rows is spread over many tasks;
    the first rank of each group is found by an aggregation.  Missing keys equal each other.
    """
    rows = ranked(df, [*(F.col(g).asc_nulls_first() for g in group), *order], name)
    firsts = rows.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.min("rank").alias("_first"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    placed = rows.join(firsts, same).withColumn("position", F.col("rank") - F.col("_first"))
    return placed.drop("rank", "_first", *(f"_{g}" for g in group))
