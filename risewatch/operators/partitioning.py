"""How output rows are placed, and how a table is laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(rows: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """All rows of a key in one partition, keys spread by hash."""
    return rows.repartition(partitions, *keys)


def evenly(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows in turn to every partition."""
    return rows.repartition(partitions)


def partition_number(partitions: int, *, key: str | None = None, index: str | None = None) -> Column:
    """An explicit partition number: by key hash, or by an index that may be negative."""
    if (key is None) == (index is None):
        raise ValueError("give either key or index")
    return F.pmod(F.hash(key) if key else F.col(index), F.lit(partitions)).cast("int")


def newest_first(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows clustered by key, newest first, for writing.

    Ranges over (key, ts) rather than a hash of the key: the files are just as well clustered, and a key
    with very many rows becomes many files.
    """
    order = [F.col(key), F.col(ts).desc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
