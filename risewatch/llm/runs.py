"""Places and running sums within groups of any size, and joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import stage

#: A key with more than this share of the rows is hot: there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 4096


@dataclass(frozen=True)
class Placed:
    """Rows with `_t` (the group's number from 0 in the order of groups), `_i` (the place in the group from 0),
    `_run` (the sum of the value over the earlier rows of the group) and `_last` (no later row in the group)."""

    rows: DataFrame
    groups: int


def placed(df: DataFrame, group: str | None, group_order: Column | None, order: Sequence[Column], value: str | None, name: str) -> Placed:
    """Number groups and the rows in them, with running sums, over one range shuffle and without a window.

    Rows are range-partitioned by group and order, so a group that holds most rows lies in many tasks.  Each
    range is scanned once in order; of each range one row (its first and last group, what the last one holds so
    far) passes the driver, which tells every range what came before it.  Missing groups equal each other;
    missing values count 0.  Rows equal in `order` get their places in any order, so it should be total.
    """
    keys = [] if group is None else [group_order]
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    local = "_part int, _t bigint, _i bigint, _run bigint, _end boolean"
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    scanned = stage(spread.mapInArrow(_scan(group, value), f"{kinds}, {local}"), name)

    at = F.struct("_t", "_i")
    key = F.struct(F.col(group).alias("key")) if group else F.struct(F.lit(0).alias("key"))
    own = F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(0)
    found = scanned.groupBy("_part").agg(
        F.max("_t").alias("top"), F.min_by(key, at).alias("first"), F.max_by(key, at).alias("last"),
        F.max_by(F.struct((F.col("_i") + 1).alias("n"), (F.col("_run") + own).alias("sum")), at).alias("open"),
    )
    parts = sorted(found.collect(), key=lambda row: row["_part"])  # one row a partition
    carried, base, before, n, total = [], -1, None, 0, 0
    for k, part in enumerate(parts):
        goes_on = before is not None and part["first"] == before
        if not goes_on:
            base, n, total = base + 1, 0, 0
        closes = k + 1 == len(parts) or parts[k + 1]["first"] != part["last"]
        carried.append((part["_part"], base, n, total, part["top"], closes))
        n, total = (n, total) if part["top"] == 0 else (0, 0)
        n, total = n + part["open"]["n"], total + part["open"]["sum"]
        base, before = base + part["top"], part["last"]
    carry = df.sparkSession.createDataFrame(
        carried, "_part int, _base bigint, _n bigint, _sum bigint, _top bigint, _closes boolean"
    )
    first = F.col("_t") == 0
    rows = scanned.join(F.broadcast(carry), "_part").withColumns({
        "_i": F.col("_i") + F.when(first, F.col("_n")).otherwise(0),
        "_run": F.col("_run") + F.when(first, F.col("_sum")).otherwise(0),
        "_last": F.col("_end") & ((F.col("_t") < F.col("_top")) | F.col("_closes")),
        "_t": F.col("_t") + F.col("_base"),
    })
    return Placed(rows.select(*df.columns, "_t", "_i", "_run", "_last"), base + 1)


def _scan(group: str | None, value: str | None):
    """A pass over one sorted range that numbers its groups and rows; one row is held back to see a group's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        held, t, i, total = None, 0, 0, 0  # what the row before `held` left
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if group is None:
                change = np.zeros(rows.num_rows, bool)
            else:
                codes = rows.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                change = np.concatenate([[False], np.diff(codes) != 0])
            if value is None:
                values = np.zeros(rows.num_rows, np.int64)
            else:
                values = pc.fill_null(rows.column(value).cast(pa.int64()), 0).to_numpy()
            # The held row's own state is (t, i, total); all others follow from it.
            places = np.arange(rows.num_rows)
            starts = np.maximum.accumulate(np.where(change, places, 0))
            sums = np.concatenate([[0], np.cumsum(values)])
            in_first = starts == 0
            now_t = t + np.cumsum(change)
            now_i = places - starts + np.where(in_first, i, 0)
            now_run = sums[:-1] - sums[starts] + np.where(in_first, total, 0)
            ends = np.append(change[1:], True)
            t, i, total = int(now_t[-1]), int(now_i[-1]), int(now_run[-1])
            done = rows.num_rows - 1
            held = rows.slice(done)
            if done:
                yield from _with(rows.slice(0, done), now_t[:-1], now_i[:-1], now_run[:-1], ends[:-1])
        if held is not None:
            yield from _with(held, np.array([t]), np.array([i]), np.array([total]), np.array([True]))

    return run


def _with(rows: pa.Table, t, i, run, end) -> list[pa.RecordBatch]:
    for name, column in (("_t", t), ("_i", i), ("_run", run), ("_end", end)):
        rows = rows.append_column(name, pa.array(column))
    return rows.combine_chunks().to_batches()


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on `key`, unique on the right, where a key may hold most rows of the left.

    Keys with over 1 in 4,096 of the left's rows, hence at most 4,096 of them, meet a broadcast; the others
    are joined by a shuffle in which no key is large.  `how` is inner or left.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    least = max(1, int(left.count() * HOT_SHARE))
    hot = counts.where(F.col("count") > least).select(key)
    marked = right.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    of_hot = F.broadcast(marked.where("_hot").drop("_hot"))
    others = marked.where("_hot IS NULL").drop("_hot")
    split = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    return split.where("_hot").drop("_hot").join(of_hot, key, how).unionByName(
        split.where("_hot IS NULL").drop("_hot").join(others, key, how)
    )
