"""Whitening against plain linear algebra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from risewatch.llm import whitening
from risewatch.llm.queries import op11_whitening
from risewatch.llm.whitening import above, gram, leading

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def turned(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    full = q @ np.diag(values) @ q.T
    return (full + full.T) / 2


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1.0], [2, 2, 2, 2], [7] * 4 + [3] * 4 + [1e-3] * 20, [5, 5 - 1e-13, 5 - 1e-9, 4, 3, 2, 1, 0],
    [1e12, 1e6, 1e-3], [0, 0, 3], list(range(1, 41)), [1 + 1e-7 * k for k in range(12)], [4, -9, 2, -1],
])
@pytest.mark.parametrize("seed", [0, 1])
def test_slices_find_the_leading_eigenpairs(values, seed):
    matrix = turned(values, seed)
    scale = max(map(abs, values))
    found = leading(matrix, 8)
    want = [v for v in sorted(values, reverse=True) if v > 1e-11 * scale][:8]
    assert len(found) == len(want)
    assert np.allclose([c.value for c in found], want, rtol=0, atol=1e-13 * scale)
    assert all(c.certified for c in found)
    vectors = np.array([c.vector for c in found])
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
    for c in found:
        assert np.linalg.norm(matrix @ c.vector - c.value * c.vector) < 1e-13 * scale


def test_inertia_counts_eigenvalues_above_a_shift():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 10, 40):
        half = rng.standard_normal((size, size))
        matrix = half + half.T
        values = np.linalg.eigvalsh(matrix)
        for shift in rng.uniform(values[0] - 1, values[-1] + 1, 20):
            assert above(matrix, shift) == (values > shift).sum()
    assert above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1 and above(np.zeros((4, 4)), 0) == 0


def test_products_are_exact():
    for scale in (10, 1 << 30, 1 << 43):
        rows = np.random.default_rng(1).integers(-scale, scale, (50, 6))
        plain = [[sum(int(r[i]) * int(r[j]) for r in rows) for j in range(6)] for i in range(6)]
        assert gram(rows).tolist() == plain


def plain(vectors, number=8):
    """(vec_id, component) to deviation, whitened and explained, from numpy's own eigenvectors."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in vectors]
    n, size = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(size)]
    centred = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(size)] for r in x])
    covariance = centred.T @ centred / n
    values, turn = np.linalg.eigh(covariance)
    values, turn = values[::-1], turn[:, ::-1]
    out = []
    for k in range(min(number, size)):
        white = centred @ turn[:, k] / math.sqrt(values[k]) if values[k] > 1e-10 else None
        for i, (vec_id, _) in enumerate(vectors):
            deviation = sum((n * x[i][j] - sums[j]) ** 2 for j in range(size))
            out.append((vec_id, k + 1, n, deviation, None if white is None else white[i], values[k] / covariance.trace()))
    return out


def agrees(got, want):
    """Equal up to rounding and the sign of each component."""
    assert len(got) == len(want)
    got, want = sorted(map(tuple, got), key=lambda r: r[:4]), sorted(want, key=lambda r: r[:4])
    for k in {r[1] for r in want}:
        a, b = [r for r in got if r[1] == k], [r for r in want if r[1] == k]
        assert [r[:4] for r in a] == [r[:4] for r in b]
        if b[0][4] is None:
            assert all(r[4] is None for r in a)
            continue
        x, y = np.array([r[4] for r in a]), np.array([r[4] for r in b])
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-8
        assert np.allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-9)
    errors = {r[6] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whole_table_equals_plain_eigenvectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    agrees(op11_whitening(spark, sf_dir).collect(), plain([tuple(r) for r in rows]))


def test_unsound_repeated_and_missing(spark, tmp_path):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(5).astype(np.float32).tolist(), 1) for i in range(40)]
    good += [good[0], good[0], (None, good[3][1], None), (90, [0.0] * 5, 1), (91, [1e6, 0.5, 0.0, 0.0, 0.0], 1)]
    bad = [(50, None, 1), (51, [], 1), (52, [1.0, None, 1.0, 1.0, 1.0], 1), (53, [float("nan")] * 5, 1), (54, [1.0, float("-inf"), 1.0, 1.0, 1.0], 1),
           (55, [1e30] * 5, 1), (56, [1.0] * 4, 1)]
    given = spark.createDataFrame(good + bad, SCHEMA).withColumns({"whitened": F.lit(1), "at": F.lit(2), "size": F.lit(3)})
    given.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_whitening(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    number = {k: i for i, k in enumerate(sorted({r[0] for r in good}, key=lambda v: (v is None, v or 0)))}
    agrees([(number[r[0]], *r[1:]) for r in got], [(number[r[0]], *r[1:]) for r in plain([r[:2] for r in sorted(good, key=key)])])


@pytest.mark.parametrize("rows,components", [
    ([], 0), ([(1, None, 1)], 0), ([(1, [1.0, 2.0], 1)], 2), ([(1, [1.0], 1), (2, [2.0], 1)], 1), ([(i, [float(i), 2.0 * i, 1.0], 1) for i in range(9)], 3),
])
def test_few_vectors_and_no_variance(spark, rows, components):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    sound = [r for r in rows if r[1] is not None]
    assert len(got) == components * len(sound)
    assert {r.component for r in got if r.whitened is not None} <= {1}
    if len(sound) > 1:
        agrees(got, [r if r[1] == 1 else (*r[:4], None, 0.0) for r in plain([r[:2] for r in sound])])
    else:
        assert all(r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


def test_result_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(7)
    given = spark.createDataFrame([(i, rng.standard_normal(12).tolist(), 0) for i in range(300)], SCHEMA)
    first, again = whitening.fit(given.repartition(3)), whitening.fit(given.repartition(7).orderBy(F.desc("vec_id")))
    assert first.sums == again.sums and [c.value for c in first.components] == [c.value for c in again.components]
