"""Mixing sources to target weights that change over training time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import stage
from risewatch.llm.runs import join_hot, placed

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Schedule:
    """A source's weight over training time, linear between knots (time, weight) from time 0 to 1."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        times = [t for t, _ in self.knots]
        if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in self.knots) < 0:
            raise ValueError("knots must run from time 0 to time 1, ascending, with weights of at least 0")
        if not self.weight:
            raise ValueError("a weight must not be 0 all the time")

    def _pieces(self) -> list[tuple[Fraction, Fraction, Fraction, Fraction]]:
        """(start, length, weight at the start, weight at the end) of every linear piece."""
        exact = [(Fraction(t), Fraction(w)) for t, w in self.knots]
        return [(a, b - a, v, w) for (a, v), (b, w) in zip(exact, exact[1:])]

    @property
    def weight(self) -> Fraction:
        """The integral over all of training: the source's weight in the whole mix."""
        return sum(h * (v + w) / 2 for _, h, v, w in self._pieces())

    def time_of(self, share: Column) -> Column:
        """The training time by which `share` (from 0 to 1) of the source's tokens have been asked for."""
        asked = share * F.lit(float(self.weight))
        done, pieces = Fraction(0), []
        for start, length, v, w in self._pieces():
            left = asked - F.lit(float(done)) if done else asked
            slope = F.lit(float((w - v) / length))
            root = F.sqrt(F.lit(float(v * v)) + F.lit(2.0) * left * slope)
            # The smaller root of slope / 2 x^2 + v x = left, in the form that loses no digits.
            x = F.when(left <= 0, 0.0).otherwise(F.lit(2.0) * left / (F.lit(float(v)) + root))
            done += length * (v + w) / 2
            pieces.append((float(done), F.lit(float(start)) + x if start else x))
        time = pieces[-1][1]
        for end, piece in reversed(pieces[:-1]):
            time = F.when(asked < end, piece).otherwise(time)
        return time


def targets(sources: DataFrame, schedules: Sequence[Schedule], budget: Fraction, most: int) -> DataFrame:
    """Add to sources (_t, source_size) their target and demand, the target's whole words.

    Sources share `budget` of all words by weight; no source gets more than `most` times its size, and
    what exceeds that is shared among the others by weight, until none is above.  Numbers are whole, so
    reruns agree.  A round passes two sums through the driver; every round but the last caps a source.
    """
    weights = [s.weight for s in schedules]
    unit = math.lcm(*(w.denominator for w in weights))
    exact = "decimal(38,0)"
    weight = F.element_at(F.array(*(F.lit(int(w * unit)) for w in weights)), (F.col("_t") % len(weights) + 1).cast("int")).cast("long")
    # Words times the budget's denominator.
    rows = sources.withColumns({"_w": weight, "_cap": (F.col("source_size") * (most * budget.denominator)).cast("long")})
    total = rows.agg(F.sum(F.col("source_size").cast(exact))).first()[0]
    share, over, capped = int(total or 0) * budget.numerator, 0, -1
    while True:
        above = F.lit(False) if capped < 0 else F.lit(share).cast(exact) * F.col("_w") > F.lit(over).cast(exact) * F.col("_cap")
        found = rows.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, F.col("_cap").cast(exact)).otherwise(0)).alias("capped"),
            F.sum(F.when(above, 0).otherwise(F.col("_w")).cast(exact)).alias("left"),
        ).first()
        if found["n"] == capped:
            break
        capped, share, over = found["n"], int(total or 0) * budget.numerator - int(found["capped"] or 0), int(found["left"] or 0)
    scaled = F.lit(share).cast(exact) * F.col("_w")
    divisor = max(over, 1) * budget.denominator
    target = F.when(above, F.col("_cap").cast("double") / float(budget.denominator)).otherwise(scaled.cast("double") / float(divisor))
    # A quotient of decimals could be rounded up; DIV is exact.
    rows = rows.withColumns({"_scaled": scaled, "target": target, "_above": above})
    demand = F.when(F.col("_above"), F.expr(f"_cap DIV {budget.denominator}")).otherwise(F.expr(f"_scaled DIV CAST({divisor} AS {exact})"))
    return rows.select("_t", "source_size", "target", demand.cast("long").alias("demand"))


def mix(docs: DataFrame, schedules: Sequence[Schedule], budget: Fraction = Fraction(3, 2), most: int = 2,
        carry: Sequence[str] = (), name: str = "mix") -> DataFrame:
    """Documents in training order: one row for each time that a document is taken.

    Columns: doc_id, the columns in `carry`, row_source and row_place (numbers that tell rows apart), size,
    source_size, target, turn (from 0), words, time, place and token_start (in training order).  Sources
    by code point, a missing one last, use the schedules in turn.  A source's documents are taken in a fixed
    random order by doc_id, again from the first one after the last, until its target is met; the document
    at which it is met is taken in part, so the words taken miss the target by less than one.  The document
    that starts at a share of the source's demand is trained at the time by which that share is asked for.

    A document never taken has one row with words 0 and neither time nor token_start, after all others;
    documents of no words (null or empty text) are never taken.  Repeated rows are documents of their own;
    a missing doc_id comes first in its source's order.  Other columns are left out.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id"), *(F.col(c).alias(f"c_{c}") for c in carry), F.col("source").alias("_source"), size.alias("size"),
        F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_mark"), F.xxhash64("text").alias("_tie"),
    )
    rows = stage(rows, f"{name}-sizes")
    order = [F.col("_mark").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("_tie").asc()]
    found = placed(rows, "_source", F.col("_source").asc_nulls_last(), order, "size", f"{name}-sources")
    rows = stage(found.rows.drop("_source", "_mark", "_tie", "_last"), f"{name}-placed")
    sources = stage(rows.groupBy("_t").agg(F.sum("size").alias("source_size")), f"{name}-sizes-of-sources")
    rows = join_hot(rows, targets(sources, schedules, budget, most), "_t")

    turns = F.sequence(F.lit(0), F.lit(most - 1))
    before = F.col("turn").cast("long") * F.col("source_size") + F.col("_run")
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - before))
    taken = rows.withColumn("turn", F.explode(turns)).withColumn("words", words).where("words > 0 OR turn = 0")
    share = before.cast("double") / F.col("demand").cast("double")
    time = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        time = F.when(F.col("_t") % len(schedules) == k, schedule.time_of(share)).otherwise(time)
    timed = taken.withColumn("time", F.when(F.col("words") > 0, time)).select(
        "doc_id", *(f"c_{c}" for c in carry), F.col("_t").alias("row_source"), F.col("_i").alias("row_place"),
        "size", "source_size", "target", "turn", "words", "time",
    )
    timed = stage(timed, f"{name}-times")
    order = [F.col("time").asc_nulls_last(), *(F.col(c).asc() for c in ("row_source", "row_place", "turn"))]
    done = placed(timed, None, None, order, "words", f"{name}-order").rows
    return done.select(
        "doc_id", *(F.col(f"c_{c}").alias(c) for c in carry), "row_source", "row_place", "size", "source_size", "target",
        "turn", "words", "time", F.col("_i").alias("place"), F.when(F.col("words") > 0, F.col("_run")).alias("token_start"),
    )


def write(mixed: DataFrame, path: str) -> None:
    """Files in training order: names ascend with the places of their rows."""
    mixed.where("words > 0").repartitionByRange("place").sortWithinPartitions("place").write.parquet(path)


def per_document(mixed: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words over all turns), first_token (where in the
    mix it is taken first, null if never)."""
    return mixed.groupBy("row_source", "row_place").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("words").alias("taken"), F.min("token_start").alias("first_token"),
    ).drop("row_source", "row_place")
