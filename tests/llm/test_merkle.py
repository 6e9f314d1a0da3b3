"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from risewatch.llm import merkle, runs
from risewatch.llm.queries import op13_merkle_manifest
from tests.llm.helpers import DOCS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    parts = []
    for value in (doc_id, source, lang, n_chars, text):
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha("".join(parts))


def lower_ascii(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(digests, fan):
    """All levels of a tree, and for each leaf the siblings of every level."""
    every = [digests]
    while len(every[-1]) > 1:
        now = every[-1]
        every.append([sha("".join(now[i : i + fan])) for i in range(0, len(now), fan)])
    steps = []
    for i in range(len(digests)):
        path = []
        for level in every[:-1]:
            start = i // fan * fan
            path.append((level[start:i], level[i + 1 : start + fan]))
            i //= fan
        steps.append(path)
    return every[-1][0], steps


def brute(rows, fan=16):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    sources = sorted(by, key=lambda s: b"" if s is None else b"\1" + s.encode())
    subroots, steps_of = [], []
    for source in sources:
        by[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroot, steps = levels([leaf_of(r) for r in by[source]], fan)
        subroots.append(subroot)
        steps_of.append(steps)
    if not subroots:
        return []
    root, tops = levels(subroots, fan)
    out = []
    for k, source in enumerate(sources):
        for row, steps in zip(by[source], steps_of[k]):
            held = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                held = (row[0], lower_ascii(row[1]), *row[2:])
            now, proof = leaf_of(held), ""
            for before, after in steps + tops[k]:
                now = sha("".join(before) + now + "".join(after))
                proof += "".join(before + after)
            out.append((row[0], leaf_of(row), subroots[k], root, sha(proof), now, now == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(spark, rows, tmp_path, extra=False):
    given = spark.createDataFrame(rows, DOCS)
    if extra:
        given = given.withColumns({"leaf": F.lit("x"), "_t": F.lit(1), "kids": F.lit(2), "_group": F.lit(3)})
    given.write.parquet(str(tmp_path / "documents.parquet"))
    result = op13_merkle_manifest(spark, str(tmp_path))
    return sorted((tuple(r) for r in result.select(COLUMNS).collect()), key=str)


def test_whole_table_equals_plain_tree(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    result = op13_merkle_manifest(spark, sf_dir)
    assert sorted((tuple(r) for r in result.select(COLUMNS).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("sizes", [[], [1], [2], [16], [17], [1, 1], [1, 300, 2], [257, 16, 16, 5], [1] * 40])
def test_trees_of_all_shapes(spark, tmp_path, sizes):
    rows = [(s * 1000 + i, f"Text {i}", "en", f"s{s:03}", 7) for s, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(i, t, None, s, n) for s in (None, "", "é", "z", "\U0001F600", "ü") for i, t, n in (
        (None, None, None), (None, "A", 1), (7, "Q É", 2), (7, "Q É", 2), (7, "", 0), (-3, "Ab" * 5000, 10000), (10, "-", 1))]
    assert found(spark, rows, tmp_path, extra=True) == brute(rows)


def test_deep_trees_by_shuffled_joins(spark, monkeypatch):
    """A fan of two gives many levels; no ancestor counts as hot."""
    monkeypatch.setattr(runs, "HOT_SHARE", 1.0)
    rows = [(i, "t", "en", "a" if i < 700 else f"b{i}", 1) for i in range(760)]
    docs = spark.createDataFrame(rows, DOCS)
    result = merkle.checked(merkle.manifest(docs, F.lower("text"), fan=2))
    got = sorted((tuple(r) for r in result.select(COLUMNS).collect()), key=str)
    assert got == brute(rows, 2) and all(r[-1] for r in got)


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_and_sums(spark, partitions):
    """Groups that span ranges, that end with one, and that are missing."""
    sizes = {None: 3, "a": 1, "b": 500, "c": 2, "d": 40}
    rows = [(g, i, (i * 7) % 5 if i % 3 else None) for g, n in sizes.items() for i in range(n)]
    random.Random(2).shuffle(rows)
    given = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        done = runs.placed(given, "g", F.col("g").asc_nulls_last(), [F.col("i")], "v", "test")
        got = {(r.g, r.i): (r["_t"], r["_i"], r["_run"], r["_last"]) for r in done.rows.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for t, g in enumerate(["a", "b", "c", "d", None]):
        total = 0
        for i in range(sizes[g]):
            want[g, i] = (t, i, total, i == sizes[g] - 1)
            total += (i * 7) % 5 if i % 3 else 0
    assert got == want and done.groups == 5


def test_hot_and_other_keys_join_alike(spark):
    left = spark.createDataFrame([(1, i) for i in range(9000)] + [(k, k) for k in range(2, 50)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(1, 40)], "k int, n string")
    for how in ("inner", "left"):
        got = sorted(map(str, runs.join_hot(left, right, "k", how).select("k", "v", "n").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "v", "n").collect()))
