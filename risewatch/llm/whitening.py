"""Whitening of embeddings on their leading principal components, found by spectrum slicing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import stage

#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries from here on count as not finite; sums of products of smaller ones fit 38 digits for 10^11 vectors.
TOO_LARGE = float(1 << 33)
#: Numbers that a Python task works on at a time.
BLOCK = 1 << 20
EXACT = 1 << 53
EPS = float(np.finfo(np.float64).eps)


# Spectrum slicing: plain numpy on one matrix of the vectors' dimension.

def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed `shift`.

    By Sylvester's law these are the positive eigenvalues of D in P (A - shift I) P' = L D L', whose blocks are
    of size 1 or, where no diagonal entry is a stable pivot, of size 2 and then indefinite.
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio = (1 + math.sqrt(17)) / 8
    positive = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        off = np.abs(np.tril(a, -1))
        r, q = divmod(int(off.argmax()), len(a))
        if diagonal[p] >= ratio * off[r, q]:
            pivot = a[p, p]
            if pivot == 0:  # nothing but zeros is left
                break
            positive += pivot > 0
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:
            positive += 1
            rest = np.delete(np.arange(len(a)), [q, r])
            columns = a[np.ix_(rest, [q, r])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_([q, r], [q, r])], columns.T)
    return int(positive)


@dataclass(frozen=True)
class Component:
    value: float
    vector: np.ndarray
    certified: bool  # inertia counts on both sides of the value give its number


def leading(matrix: np.ndarray, number: int) -> list[Component]:
    """The eigenpairs of the `number` largest positive eigenvalues of a symmetric matrix, largest first.

    The positive axis is cut in halves until a slice holds one eigenvalue; Rayleigh quotient iteration
    starts from the slice's middle.  If it leaves the slice, the slice is cut further.  Eigenvalues that
    rounding cannot tell apart share a slice and get orthonormal vectors of their common space.
    """
    size = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    fuzz = 2 * size * EPS * bound  # eigenvalues are known no better
    least = 8 * fuzz  # smaller ones are no variance
    if bound == 0:
        return []
    found: list[Component] = []
    high = bound * (1 + 4 * EPS)
    slices = [(least, high, above(matrix, least), above(matrix, high))]
    while slices and len(found) < number:
        low, high, at_low, at_high = slices.pop()
        held = at_low - at_high
        if held <= 0:
            continue
        middle = (low + high) / 2
        finest = high - low <= fuzz
        if held == 1 or high - low <= least:
            pairs: list[Component] = []
            for k in range(held):
                known = [c.vector for c in [*found, *pairs]]
                value, vector = _quotient_iteration(matrix, middle, known, k)
                pair = Component(value, vector, _certified(matrix, value, vector, fuzz, at_high, at_low))
                if finest or low - fuzz <= value <= high + fuzz and pair.certified:
                    pairs.append(pair)
            if len(pairs) == held:
                found += sorted(pairs, key=lambda c: -c.value)
                continue
        at = above(matrix, middle)
        slices += [(low, middle, at_low, at), (middle, high, at, at_high)]
    found = found[:number]
    return [Component(c.value, c.vector * (1 if c.vector[np.abs(c.vector).argmax()] > 0 else -1), c.certified) for c in found]


def _quotient_iteration(matrix: np.ndarray, shift: float, known: list[np.ndarray], k: int) -> tuple[float, np.ndarray]:
    """An eigenpair near `shift`, its vector orthogonal to the known ones."""
    size = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    basis = np.array(known).reshape(len(known), size)
    vector = np.random.default_rng(size + k).standard_normal(size)
    vector -= basis.T @ (basis @ vector)
    vector /= np.linalg.norm(vector)
    value = shift
    for step in range(40):
        try:
            ahead = np.linalg.solve(matrix - value * np.eye(size), vector)
        except np.linalg.LinAlgError:  # the shift is the eigenvalue to the last digit
            ahead = np.linalg.solve(matrix - (value + EPS * norm) * np.eye(size), vector)
        ahead -= basis.T @ (basis @ ahead)
        length = np.linalg.norm(ahead)
        if not np.isfinite(length) or length == 0:
            break
        vector = ahead / length
        if step >= 2:  # the first steps keep the shift, so that they turn to what lies nearest to it
            value = float(vector @ matrix @ vector)
            if np.linalg.norm(matrix @ vector - value * vector) <= 2 * EPS * norm:
                break
    return float(vector @ matrix @ vector), vector


def _certified(matrix, value, vector, fuzz, at_high, at_low) -> bool:
    """Whether counts just above and below the value agree with the numbers that its slice holds."""
    error = max(fuzz, 2 * float(np.linalg.norm(matrix @ vector - value * vector)))
    return above(matrix, value + error) <= at_low - 1 and above(matrix, value - error) >= at_high + 1


# Spark: exact sums over all vectors.

@dataclass(frozen=True)
class Whitening:
    """What is fitted: the number of vectors, the sums of their whole numbers, and the components."""

    n: int
    sums: list[int]
    trace: float
    components: list[Component]
    size: int


def sound(vectors: DataFrame) -> DataFrame:
    """The rows whose vector is not null or empty and holds finite entries below 2^33 only."""
    value = F.col("embedding").cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches and their vectors as whole numbers, one row each."""
    rows = max(1, BLOCK // max(1, size))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            entries = piece.column(piece.schema.get_field_index("embedding")).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield piece, np.floor(entries * SCALE).astype(np.int64).reshape(-1, size) + OFFSET


def gram(rows: np.ndarray) -> np.ndarray:
    """rows' rows in exact whole numbers."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * len(rows) < EXACT:
        doubles = rows.astype(np.float64)
        return np.rint(doubles.T @ doubles).astype(np.int64).astype(object)
    return rows.astype(object).T @ rows.astype(object)


def _summed(vectors: DataFrame, size: int, part, names: str) -> DataFrame:
    """Sums, over all tasks, of the whole numbers in the array that `part` makes of each block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, rows in _blocks(batches, size):
            total = part(rows) if total is None else total + part(rows)
        if total is not None:
            flat = total.ravel().tolist()
            places = pa.array(np.arange(len(flat), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([places, pa.array([int(x) for x in flat], pa.decimal128(38, 0))], ["at", "s"])

    return vectors.select("embedding").mapInArrow(run, "at bigint, s decimal(38,0)").groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("at")


def fit(vectors: DataFrame, number: int = 8) -> Whitening:
    """The leading components of all sound vectors of the most frequent length (of the longest such one).

    Two passes: sums, then products of the numbers less their rounded means.  All sums are of whole numbers,
    so the covariance does not depend on the order of rows; what rounding the means left is taken out exactly.
    One number per pair of dimensions passes the driver.
    """
    sizes = sound(vectors).groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return Whitening(0, [], 0.0, [], 0)
    size, n = most["size"], most["count"]
    fitted = sound(vectors).where(F.size("embedding") == size)
    sums = [int(r["s"]) for r in _summed(fitted, size, lambda rows: rows.sum(axis=0).astype(object), "sums").collect()]
    means = [(2 * s + n) // (2 * n) for s in sums]
    about = np.array(means, np.int64)
    found = _summed(fitted, size, lambda rows: gram(rows - about), "products").collect()
    products = [int(r["s"]) for r in found]
    left = [s - n * m for s, m in zip(sums, means)]
    covariance = np.array(
        [[(n * products[i * size + j] - left[i] * left[j]) / (n * n) for j in range(size)] for i in range(size)]
    ).reshape(size, size)
    return Whitening(n, sums, float(np.trace(covariance)), leading(covariance, number), size)


def apply(vectors: DataFrame, model: Whitening, number: int = 8, name: str = "whitened") -> DataFrame:
    """Per sound vector of the fitted length: vec_id, deviation, whitened (array over components).

    deviation is the exact sum of (n x - S)^2, null beyond 38 digits.  A component without variance is null.
    """
    size, n, kept = model.size, model.n, min(number, model.size)
    means = [(2 * s + n) // (2 * n) for s in model.sums] if n else []
    left = np.array([(s - n * m) / n for s, m in zip(model.sums, means)])
    offsets = [s - n * m for s, m in zip(model.sums, means)]  # n x - S = n (x - mean) - offset
    turn = np.array([c.vector / math.sqrt(c.value) for c in model.components]).reshape(len(model.components), size).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows in _blocks(batches, size):
            near = rows - np.array(means, np.int64)
            most = n * (int(np.abs(near).max(initial=0)) + 1)
            if size * most * most < 1 << 63:
                deviation = pa.array(((n * near - np.array(offsets, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = ((n * near.astype(object) - np.array(offsets, object)) ** 2).sum(axis=1).tolist()
                deviation = pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            found = (near - left) @ turn
            white = np.full((len(rows), kept), np.nan)
            white[:, : found.shape[1]] = found
            flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * kept), flat)
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    kind = dict(vectors.dtypes)["vec_id"]
    rows = sound(vectors).where(F.size("embedding") == size).select("vec_id", "embedding")
    return stage(rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"), name)


def identity_error(whitened: DataFrame, number: int) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over the first
    `number` components; null for none."""
    if not number:
        return None
    w = [F.get("whitened", F.lit(k)) for k in range(number)]
    means = whitened.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(w))).first()
    pairs = [(a, b) for a in range(number) for b in range(a, number)]
    found = whitened.agg(*(F.avg((w[a] - means[a]) * (w[b] - means[b])).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(c - (a == b)) for (a, b), c in zip(pairs, found))


def whiten(vectors: DataFrame, number: int = 8) -> DataFrame:
    """Per sound vector and component up to `number`: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Left out are vectors that are null, empty, or hold a null, a non-finite entry or one of 2^33 or more, and
    those of another length than most.  Rows without vec_id and repeated rows are vectors like any other, other
    columns are left out.  A component without variance is null in `whitened` and explains 0 (null where
    nothing varies).  No vectors give no rows.
    """
    model = fit(vectors, number)
    rows = apply(vectors, model, number)
    error = identity_error(rows, len(model.components))
    shares = [c.value / model.trace for c in model.components]
    shares += [0.0 if model.trace else None] * (min(number, model.size) - len(shares))
    explained = F.array(*(F.lit(s).cast("double") for s in shares)) if shares else F.array().cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
