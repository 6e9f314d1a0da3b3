"""Near-duplicate vectors by randomly rotated binary codes.

Unit vectors are turned by one random rotation and stored as the signs of their components, with a
correction factor: the inner product of the vector and its code.  The inner product of a code and another
rotated vector, divided by the factor, is an unbiased estimate of the cosine, and the factor bounds its
error.  Pairs whose estimate plus bound reaches the threshold are computed again in double precision; at
the width of the bound used here a link is missed with a probability of about 1e-8.

Equal vectors are one class.  The vectors of a label fall into blocks by hash and every two blocks meet in
one group of bounded size, so a label that holds a third of all rows is spread over many tasks.  A group
gives numbers of links and components, never its pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import components, small, spanning, stage

#: Vectors of one block.
BLOCK = 1024
#: Width of the confidence bound, in standard errors of the estimate.
ERRORS = 6.0
SEED = 20_240_601
#: Pairs computed again at once.
EXACT = 1 << 16


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))[0]


def units(vectors: list) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    rows = np.array(vectors, np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def encode(vectors: list) -> tuple[list[bytes], np.ndarray]:
    """Codes and correction factors."""
    turned = units(vectors) @ rotation(len(vectors[0]))
    codes = [x.tobytes() for x in np.packbits(turned >= 0, axis=1)]
    return codes, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def candidates(codes: list[bytes], factors: np.ndarray, queries: np.ndarray, cosine: float) -> np.ndarray:
    """Which (code, query) pairs may have the cosine: estimate plus confidence bound.  `queries` are units."""
    size = queries.shape[1]
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    signs = np.unpackbits(packed, axis=1, count=size).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(size)).astype(np.float32)
    factors = np.minimum(factors, 1.0).astype(np.float32)[:, None]
    estimate = (signs @ turned.T) / np.float32(math.sqrt(size)) / factors
    # What the code misses is orthogonal to the vector; at the threshold a query has this much of it.
    across = math.sqrt(max(0.0, 1 - cosine * cosine))
    bound = ERRORS * across * np.sqrt(1 - factors**2) / factors / math.sqrt(max(1, size - 1))
    return estimate >= cosine - bound - 1e-5


def links(codes: list[bytes], factors: np.ndarray, rows: np.ndarray, queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked (row, query) pairs."""
    a, b = np.nonzero(candidates(codes, factors, queries, cosine))
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), EXACT):
        part = slice(i, i + EXACT)
        keep[part] = np.einsum("ij,ij->i", rows[a[part]], queries[b[part]]) >= cosine
    return a[keep], b[keep]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and their
    cosine in double precision is `cosine` or more.  n_links counts the other vectors linked directly,
    component_id is the smallest vec_id reachable, kept says that it is the vector's own.  Vectors that
    are null, empty or zero or hold a null or non-finite component are linked with nothing.  Repeated rows
    are one vector.  Where a vec_id has several vectors, each row counts the links of its own and all are
    one node of the components.  A row without vec_id takes no part: component_id null, kept true.  Other
    columns are left out.
    """
    value = F.col("embedding").cast("array<double>")
    sound = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(sound, F.lit(False)).alias("sound"))
    # Equal vectors by 128 bits of hash, label and length.
    marks = ["label", "size", "h1", "h2"]
    marked = rows.withColumns({
        "size": F.size("embedding"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.reverse("embedding")),
    }).withColumn("class", F.xxhash64(*marks))
    marks = [*marks, "class"]
    classes = marked.where("sound").groupBy(*marks).agg(
        F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding")
    )
    classes = stage(_coded(classes, marks), "vector-codes")
    met = stage(_compared(classes, cosine), "vector-links")
    counts = met.groupBy("class").agg(F.sum("n").alias("n"))
    of_class = marked.where("sound").select("vec_id", "class").distinct().join(classes.select("class", "rep"), "class")
    several = of_class.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    same = of_class.join(small(several.select("vec_id")), "vec_id", "left_semi").select("vec_id", "rep")
    found = components(met.select("rep", "low").where("rep <> low").union(same), "vector-components")
    of = classes.select(*marks, "rep", "copies").join(small(counts), "class", "left").join(
        small(found.withColumnRenamed("node", "rep")), "rep", "left"
    )
    out = marked.select("vec_id", "sound", *marks).join(of, marks, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.when(F.col("sound"), F.coalesce("component", "rep")).otherwise(F.col("vec_id")))
    links_of = F.when(F.col("sound"), F.col("copies") - 1 + F.coalesce("n", F.lit(0))).otherwise(0)
    return out.select(
        "vec_id", links_of.cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _coded(classes: DataFrame, marks: list[str]) -> DataFrame:
    """Add the code and the correction factor of each class's vector."""

    def run(batches):
        for frame in batches:
            for _, part in frame.groupby("size", sort=False):
                codes, factors = encode(part["embedding"].tolist())
                yield part.assign(code=codes, factor=factors)

    kinds = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*marks, "rep", "copies", "embedding"])
    return classes.mapInPandas(run, f"{schema}, code binary, factor double")


def _compared(classes: DataFrame, cosine: float) -> DataFrame:
    """(class, rep, n, low) for each class and group that it has links in: how many vectors it is linked with
    there, and the smallest member of its component among the group's links."""
    sizes = classes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    met = classes.join(small(sizes), ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "class", "rep", "copies", "embedding", "code", "factor",
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", ignore_index=True)
        reps, copies = frame["rep"].to_numpy(), frame["copies"].to_numpy()
        whole, factors, codes = units(frame["embedding"].tolist()), frame["factor"].to_numpy(), frame["code"].to_numpy()
        left = np.flatnonzero(frame["block"] == frame["i"])
        right = np.flatnonzero(frame["block"] == frame["j"])
        a, b = links(codes[left].tolist(), factors[left], whole[left], whole[right], cosine)
        a, b = left[a], right[b]
        if frame["i"].iloc[0] == frame["j"].iloc[0]:  # every pair is met from both sides; either may find it
            pairs = np.unique(np.minimum(a, b)[a != b] * len(reps) + np.maximum(a, b)[a != b])
            a, b = pairs // len(reps), pairs % len(reps)
        number = np.bincount(a, copies[b], len(reps)) + np.bincount(b, copies[a], len(reps))
        low = spanning(a, b, len(reps))
        met = number > 0
        return pd.DataFrame({"class": frame["class"].to_numpy()[met], "rep": reps[met], "n": number[met].astype(np.int64), "low": reps[low[met]]})

    return met.groupBy("label", "size", "i", "j").applyInPandas(run, "class bigint, rep bigint, n bigint, low bigint")
