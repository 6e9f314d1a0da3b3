"""Rise alerts as Column functions over one time-ordered array.

They stay in the JVM (higher-order functions) and work in batch and streaming aggregations.  The array
is one group, so these suit bounded groups such as a streaming window; for batch tables whose groups
may be of any size use ``operators.rises``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_values(ts: str, value: str) -> Column:
    """Aggregate: all (ts, value) pairs of the group in time order; ties by value."""
    return F.sort_array(F.collect_list(F.struct(F.col(ts), F.col(value))))


def rise_count(values: Column, threshold: float, value: str = "value") -> Column:
    """How often the series rises by more than ``threshold`` above its running low.

    The low starts at the first value, follows the series down, and is lifted to the value that alerts.
    """
    limit = F.lit(float(threshold))

    def step(acc: Column, row: Column) -> Column:
        v = row[value]
        rose = v - acc["low"] > limit
        return F.struct(
            (acc["n"] + rose.cast("int")).alias("n"),
            F.when(rose, v).otherwise(F.least(acc["low"], v)).alias("low"),
        )

    start = F.struct(F.lit(0).alias("n"), F.element_at(values, 1)[value].alias("low"))
    return F.aggregate(values, start, step, lambda acc: acc["n"])


def rising_prefix_lengths(values: Column, threshold: float, value: str = "value") -> Column:
    """Positions (1-based) at which the series stands ``threshold`` or more above the level of the
    previous alert; the first level is the lowest value of the whole group, and levels never fall."""
    limit = F.lit(float(threshold))
    start = F.struct(
        F.array_min(F.transform(values, lambda r: r[value])).alias("level"),
        F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("hits"),
    )

    def step(acc: Column, row: Column) -> Column:
        hit = row[value] - acc["level"] >= limit
        i = acc["i"] + 1
        return F.struct(
            F.when(hit, row[value]).otherwise(acc["level"]).alias("level"),
            i.alias("i"),
            F.when(hit, F.array_append(acc["hits"], i)).otherwise(acc["hits"]).alias("hits"),
        )

    return F.aggregate(values, start, step, lambda acc: acc["hits"])


def rising_prefixes(values: Column, threshold: float, value: str = "value") -> Column:
    """For each rising alert the time-ordered values up to and including the one that raised it."""
    return F.transform(rising_prefix_lengths(values, threshold, value), lambda n: F.slice(values, 1, n))
