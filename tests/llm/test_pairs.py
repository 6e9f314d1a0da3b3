"""Near-duplicate documents and vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risewatch.llm import common, embdup, neardup
from risewatch.llm.queries import op4_near_duplicates
from tests.llm.helpers import docs


def smallest_reachable(nodes, links):
    """Union of pairs, one after another."""
    of = {n: n for n in nodes}
    for a, b in links:
        low, high = sorted((of[a], of[b]))
        if low != high:
            of = {n: low if c == high else c for n, c in of.items()}
    return of


def shingles(text, size):
    words = bytes(text or "", "utf8").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = smallest_reachable(texts, links)
    return sorted((i, len(sets[i]), of[i], of[i] == i) for i in texts)


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(5, 5), (7, 9), (9, 8), (8, 20), (3, 20), (9, 7)],
])
def test_components(spark, edges):
    found = common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test")
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert dict(map(tuple, found.collect())) == smallest_reachable(nodes, [e for e in edges if e[0] != e[1]])


def test_ranks_are_gapless(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(7)))
    found = common.ranked(rows, [F.col("k"), F.desc("id")], "test").collect()
    assert [r["id"] for r in sorted(found, key=lambda r: r["rank"])] == [r["id"] for r in sorted(found, key=lambda r: (r["k"], -r["id"]))]
    assert sorted(r["rank"] for r in found) == list(range(1000))


def test_sketch_estimates_similarity_and_margin_holds():
    rng = np.random.default_rng(1)
    for n in (5, 40, 400, 5000):
        found = []
        for _ in range(60):
            common_part = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a = np.unique(np.concatenate([common_part, rng.integers(0, 1 << 63, max(1, n // 14), dtype=np.uint64)]) * np.uint64(0x9E3779B97F4A7C15))
            b = np.unique(np.concatenate([common_part, rng.integers(0, 1 << 63, max(1, n // 14), dtype=np.uint64)]) * np.uint64(0x9E3779B97F4A7C15))
            if neardup.similar(a, b, 80):
                x, y = neardup.sketch(a)[None], neardup.sketch(b)[None]
                assert neardup.may_link(x, y, np.array([len(a)]), np.array([len(b)]), 80).all()
            other = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            found.append(bool(neardup.may_link(neardup.sketch(a)[None], neardup.sketch(other)[None], np.array([len(a)]), np.array([len(other)]), 80)[0]))
        assert n < 400 or not any(found)


def test_bands_miss_nothing_at_the_threshold():
    for percent in (70, 80, 85, 95):
        rows = neardup.rows_per_band(percent)
        assert (1 - (percent / 100) ** rows) ** math.floor(neardup.REGISTERS / rows) < 1e-8


def near_copies(seed):
    """Unrelated texts, families of near copies, chains, short texts, copies and awkward rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO  words", "a b a b a", "b a b a b a b", "x " * 30_000]
    for size in (8, 30, 120, 600):
        base = [r.choice(vocabulary) for _ in range(size)]
        now = list(base)
        for k in range(25):
            copy = list(base)
            for _ in range(r.randint(0, max(1, size // 25))):
                copy[r.randrange(size)] = r.choice(vocabulary)
            texts += [" ".join(copy), " ".join(copy).upper() if k % 5 == 0 else " ".join(copy[: -1 - size // 20])]
            now[r.randrange(size)] = r.choice(vocabulary)
            texts.append("\n".join(now))  # a chain that drifts away
        texts += [" ".join(r.choice(vocabulary) for _ in range(size)) for _ in range(10)]
    return texts


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    texts = dict(enumerate(near_copies(size)))
    given = docs(spark, list(texts.values())).withColumn("sketch", F.lit("clash"))
    found = neardup.near_duplicates(given, size, percent)
    assert sorted(map(tuple, found.collect())) == brute(texts, size, percent)


def test_blocks_alone_find_all_families(spark, monkeypatch):
    """Without the pivots, and with blocks so small that every group is cut."""
    texts = dict(enumerate(near_copies(9)))
    monkeypatch.setattr(neardup, "_to_first", lambda shared: shared.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0))
    for name, size in (("BLOCK", 8), ("EXACT_BLOCK", 5), ("EXACT_SHINGLES", 900), ("CELLS", 64)):
        monkeypatch.setattr(neardup, name, size)
    found = neardup.near_duplicates(docs(spark, list(texts.values())), 3, 85)
    assert sorted(map(tuple, found.collect())) == brute(texts, 3, 85)


def test_products_of_sets_equal_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(60)]
    a, b = neardup.similar_pairs(sets, 50)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if neardup.similar(sets[i], sets[j], 50)}
    assert set(zip(a.tolist(), b.tolist())) == want and want


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(map(tuple, op4_near_duplicates(spark, sf_dir).collect())) == brute(texts, 3, 85)


def test_repeated_rows_null_ids_and_keeping_one(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (1, long), (1, "other words of one"), (2, "other words of one"), (3, long + " tail"), (None, long), (None, None), (4, None), (4, None)]
    given = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id bigint, text string, kept string")
    found = sorted((tuple(r) for r in neardup.near_duplicates(given).collect()), key=str)
    assert {(r[0], r[2], r[3]) for r in found} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)}
    kept = neardup.keep_one(given)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, None, None] and kept.columns == given.columns
    assert neardup.keep_one(given.limit(0)).count() == 0


def brute_vectors(rows, cosine):
    sound = {}
    for vec_id, vector, label in rows:
        if label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            sound[vec_id] = (np.array(vector, np.float64), label)
    links = []
    for a, (x, la) in sound.items():
        for b, (y, lb) in sound.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
    of = smallest_reachable([r[0] for r in rows], links)
    number = {n: 0 for n in of}
    for a, b in links:
        number[a] += 1
        number[b] += 1
    return sorted((n, number[n], of[n], of[n] == n) for n in of)


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdup, "BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(64)
            for _ in range(rng.integers(1, 20)):
                vector = base + rng.standard_normal(64) * rng.choice([0, 0.1, 0.2, 0.3])
                rows.append((len(rows), (vector * rng.choice([1, 1, 3])).astype(np.float32).tolist(), label))
    odd = [None, [], [0.0] * 64, [1.0, None] * 32, [float("nan")] * 64, [float("inf")] * 64, [1.0] * 3, [2.0] * 3, [1e30, 1e30], [1e38, 1e38]]
    rows += [(len(rows) + i, v, 0) for i, v in enumerate(odd)]
    given = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int")
    found = sorted(map(tuple, embdup.near_duplicates(given).collect()))
    assert found == brute_vectors(rows, 0.98)
    again = given.unionByName(given.where("vec_id = 3")).unionByName(given.limit(1).withColumn("vec_id", F.lit(None).cast("bigint")))
    rest = [tuple(r) for r in embdup.near_duplicates(again).where("vec_id IS NOT NULL").distinct().collect()]
    assert sorted(rest) == found
    assert embdup.near_duplicates(given.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((2000, 64))
    b = a + rng.standard_normal((2000, 64)) * 0.2
    codes, factors = embdup.encode(a.tolist())
    x, y = embdup.units(a.tolist()), embdup.units(b.tolist())
    signs = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(2000, -1), axis=1) * 2.0 - 1
    estimate = (signs * (y @ embdup.rotation(64))).sum(axis=1) / 8 / factors
    exact = (x * y).sum(axis=1)
    assert abs((estimate - exact).mean()) < 0.003
    linked = exact >= 0.98
    assert linked.any() and embdup.candidates(codes, factors, y, 0.98)[np.arange(2000), np.arange(2000)][linked].all()


def test_texts_that_share_an_id_are_decided_on_one_by_one(spark):
    long = " ".join(f"word{i}" for i in range(60))
    clean = " ".join(f"other{i}" for i in range(60))
    rows = [(1, clean, "b"), (1, clean, "a"), (1, long, "c"), (0, long, "d"), (None, long, "e"), (2, None, "f"), (2, "", "g"), (3, long + " more", "h")]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    found = neardup.keep_one(given)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, clean, "a"), (0, long, "d"), (None, long, "e"), (2, None, "f"), (2, "", "g")], key=str)
    assert found.columns == given.columns
