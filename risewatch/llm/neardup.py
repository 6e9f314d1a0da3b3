"""Near-duplicate documents by HyperMinHash sketches.

A document's word shingles are hashed once.  The hash picks one of 256 buckets; the bucket keeps the
smallest remainder, compressed to 16 bits: its count of leading zeros and ten bits of mantissa behind
them.  Equal registers of two sketches estimate their Jaccard similarity after a correction for registers
that agree by chance.

* Documents with equal word sequences are one class, represented by its smallest id.
* Bands of registers make buckets of classes.  Each bucket proposes its members to its first one, a line of
  pairs and not all of them, and those whose estimate is hopeless, many standard errors below the
  threshold, are dropped.  What is left connects *families*.
* Members of one bucket that are in different families are compared sketch by sketch, in blocks of bounded
  size; of the pairs that are not hopeless only a spanning forest leaves a block.  So every pair that
  shares a band and is not hopeless is within one family.
* The families' members meet in blocks again, now with their texts, and every pair is confirmed on the full
  shingle sets.  Of the links again only a spanning forest leaves a block.

A family of n members takes n * n / 2 comparisons inside blocks, but rows in proportion to n times its number
of blocks, however many of its pairs are links.

The bands are cut so that a pair at the threshold shares none with a probability under 1e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import components, give_back, group_starts, ranked, slices, small, sorted_groups, spanning, stage
from risewatch.llm.runs import join_hot

REGISTERS = 256
MANTISSA = 10
#: Members of one side of a block comparison by sketches (half a MB of them), and by full sets.
BLOCK = 1024
EXACT_BLOCK = 128
#: Shingles of one side of a block of full sets; longer documents make smaller blocks.
EXACT_SHINGLES = 400_000
#: Cells of a 0/1 matrix of documents and shingles.
CELLS = 4 << 20
#: Standard errors that an estimate may lie below the threshold.
ERRORS = 5.5

_GROUP = ["key", "i", "j"]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


# Shingles and sketches

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, separated by the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], size: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than `size` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(each))
    n = len(each) - size + 1
    mixed = each[:n] + np.uint64(size)
    for j in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[2] + each[j : n + j]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[1]
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted shingle set; 0 is an empty register."""
    registers = np.zeros(REGISTERS, np.uint16)
    buckets = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(buckets, prepend=-1))  # the smallest of each bucket, as the set is sorted
    rest = (shingles[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)
    fraction, bits = np.frexp(rest.astype(np.float64))
    mantissa = np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    registers[buckets[first]] = ((52 - bits + 1) << MANTISSA) | mantissa
    return registers


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of different shingles agree, for sets of these sizes."""
    zeros = np.arange(53)[:, None]

    def spread(n):
        per = n[None, :] / REGISTERS
        return (np.exp(-per * 0.5 ** (zeros + 1)) - np.exp(-per * 0.5**zeros)) / -np.expm1(-per)

    return (spread(n_a) * spread(n_b)).sum(axis=0) / (1 << MANTISSA)


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches, row by row, may reach the similarity: by size, then by the corrected
    estimate with a margin of `ERRORS` standard errors."""
    goal = percent / 100
    found = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    by_chance = chance(n_a, n_b)
    estimate = (same / np.maximum(used, 1) - by_chance) / (1 - by_chance)
    return found & (estimate >= goal - ERRORS * np.sqrt(goal * (1 - goal) / np.maximum(used, 1)))


def rows_per_band(percent: int) -> int:
    """The widest bands at which a pair at the threshold shares none with a probability under 1e-8."""
    goal = percent / 100
    return max(r for r in range(1, 17) if r == 1 or (1 - goal**r) ** math.floor(REGISTERS / r) < 1e-8)


# Plan

def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles.
    component_id is the smallest doc_id reachable over links, kept says that it is the document's own.
    Documents without a word are linked with nothing.  Rows of one doc_id are one document: links of any
    of them count for all.  A row without doc_id takes no part: component_id null, kept true.  Other
    columns are left out; an empty table gives an empty result.  Texts are read whole.
    """
    texts = docs.select("doc_id", "text")
    sketched = stage(_sketches(texts, words), "sketches")
    known = sketched.where("doc_id IS NOT NULL AND mark IS NOT NULL")
    classes = stage(
        known.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )
    of_class = known.select("doc_id", "mark").distinct().join(classes.select("mark", F.col("doc_id").alias("rep")), "mark")
    repeated = of_class.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    edges = of_class.join(small(repeated.select("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = _links(texts, classes.drop("mark"), edges, words, percent)
    reps = classes.select("mark", F.col("doc_id").alias("rep"))
    out = sketched.join(reps, "mark", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _WordHashes()
        for batch in slices(batches, "text"):
            numbers, marks, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                found = words_of(text)
                shingles = shingle_set(found, size, hashes)
                numbers.append(len(shingles))
                marks.append(xxhash.xxh3_128_digest(b" ".join(found)) if found else None)
                sketches.append(sketch(shingles).tobytes() if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(numbers, pa.int64()), pa.array(marks, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "mark", "sketch"],
            )
        del hashes
        give_back()

    return texts.mapInArrow(run, "doc_id bigint, n_shingles bigint, mark binary, sketch binary")


def _links(texts: DataFrame, classes: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of all classes that are linked."""
    banded = _bands(classes, rows_per_band(percent))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    shared = stage(banded.join(buckets.select("key", F.col("lo").alias("first")), "key"), "bands")
    near = stage(_estimated(_to_first(shared), classes, percent), "pairs")
    families = components(near, "families")
    across = stage(_blocks(_labelled(shared, families), classes, percent), "pairs")
    if not across.isEmpty():
        families = components(near.unionByName(across), "families")
    found = _confirmed(families, classes, texts, words, percent)
    return components(edges.unionByName(found), "components")


def _bands(classes: DataFrame, rows: int) -> DataFrame:
    empty = F.lit(bytes(2 * rows))
    keys = []
    for i in range(math.floor(REGISTERS / rows)):
        band = F.substring("sketch", 1 + 2 * rows * i, 2 * rows)
        keys.append(F.when(band != empty, F.xxhash64(F.lit(i), band)))
    if REGISTERS % rows:  # the registers left over are a band of their own
        start = REGISTERS - REGISTERS % rows
        band = F.substring("sketch", 1 + 2 * start, 2 * (REGISTERS - start))
        keys.append(F.when(band != F.lit(bytes(2 * (REGISTERS - start))), F.xxhash64(F.lit(-1), band)))
    return classes.select("doc_id", "n", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    of = labels.select(F.col("node").alias("doc_id"), "component")
    return rows.join(small(of), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def _to_first(shared: DataFrame) -> DataFrame:
    """Each bucket's members with its first: distinct (a, b)."""
    return shared.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b")
            ]
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            yield batch.filter(pa.array(may_link(*sides, *sizes, percent))).select(["a", "b"])

    for side in "ab":
        of = classes.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(of, side)
    return pairs.mapInArrow(run, "a bigint, b bigint")


def _confirmed(families: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between members of a family by their full shingle sets, a spanning forest of each block."""
    members = families.select(F.col("node").alias("doc_id"), F.col("component").alias("key")).join(
        classes.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"
    )
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / EXACT_BLOCK, F.sum("n") / EXACT_SHINGLES)).alias("blocks")
    roles = stage(_dealt(members, members.groupBy("key").agg(blocks)).select("doc_id", *_GROUP, "block"), "roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for rows in sorted_groups(slices(batches, "text"), _GROUP):
            ids, block = rows.column("doc_id").to_numpy(), rows.column("block").to_numpy()
            across = rows.column("i").to_numpy() != rows.column("j").to_numpy()
            starts = np.append(group_starts(rows, _GROUP), rows.num_rows)
            for lo, hi in zip(starts, starts[1:]):
                sets = [shingle_set(words_of(t), words, hashes) for t in rows.column("text").slice(lo, hi - lo).to_pylist()]
                a, b = similar_pairs(sets, percent)
                if across[lo]:
                    meet = block[lo + a] != block[lo + b]
                    a, b = a[meet], b[meet]
                yield _forest(ids[lo:hi], a, b)
        del hashes
        give_back()

    rows = texts.where("doc_id IS NOT NULL AND text IS NOT NULL").join(small(roles), "doc_id").select("doc_id", *_GROUP, "block", "text")
    rows = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "doc_id")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of a key fall into its blocks by hash, and every two blocks meet in one group (key, i, j)."""
    met = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Every linked member of a group with the smallest position it is connected to there."""
    low = spanning(a, b, len(ids))
    linked = np.flatnonzero(low != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[linked], pa.int64()), pa.array(ids[low[linked]], pa.int64())], ["a", "b"])


def similar_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all similar pairs of sets, from the products of 0/1 matrices of sets and shingles."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[which] > 1  # what only one set has is in no intersection
    owner, which = owner[shared], (np.cumsum(times > 1) - 1)[which[shared]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, CELLS // max(1, len(sets)))
    for start in range(0, int(which[-1]) + 1 if len(which) else 0, step):
        lo, hi = np.searchsorted(which, [start, start + step])
        cells = np.zeros((len(sets), min(step, int(which[hi - 1]) - start + 1)), np.float32)
        cells[owner[lo:hi], which[lo:hi] - start] = 1
        common += cells @ cells.T
    common = common.astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu((common > 0) & (100 * common >= percent * either), 1))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _blocks(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members of one bucket that are in different families and not hopeless, a spanning
    forest of each block."""
    several = rows.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")
    ).where("lo < hi").select("key", "blocks")
    met = _dealt(rows.select("key", "doc_id", "label"), several)
    met = met.join(classes, "doc_id").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, _GROUP):
            yield _compare(rows, percent)

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _compare(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """The forests of all groups of a sorted table."""
    columns = {c: rows.column(c).to_numpy() for c in ("i", "j", "block", "doc_id", "label", "n")}
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    starts = np.append(group_starts(rows, _GROUP), rows.num_rows)
    ids, labels, blocks, sizes = columns["doc_id"], columns["label"], columns["block"], columns["n"].astype(float)
    found = []
    for lo, hi in zip(starts, starts[1:]):
        across = columns["i"][lo] != columns["j"][lo]
        pairs = []
        for r in range(lo, hi - 1):
            rest = np.arange(r + 1, hi)
            rest = rest[(labels[rest] != labels[r]) & (not across or blocks[rest] != blocks[r])]
            # By size first, which is cheap.
            rest = rest[100 * np.minimum(sizes[rest], sizes[r]) >= percent * np.maximum(sizes[rest], sizes[r])]
            if len(rest):
                one = np.broadcast_to(sizes[r], len(rest))
                rest = rest[may_link(sketches[rest], sketches[r][None, :], sizes[rest], one, percent)]
                pairs.append(np.stack([np.full(len(rest), r - lo), rest - lo]))
        if pairs:
            a, b = np.concatenate(pairs, axis=1)
            found.append(_forest(ids[lo:hi], a, b))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return pa.Table.from_batches(found, schema).combine_chunks().to_batches()[0] if any(x.num_rows for x in found) else pa.RecordBatch.from_pylist([], schema)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents table with one row of each near-duplicate component; columns stay.

    What is decided on is a text under a doc_id: different texts that share a doc_id are documents of their
    own, so a clean one stays whatever becomes of the others.  Of rows equal in doc_id and text the one
    with the least other columns, in their order, stays.  Rows without doc_id stay.
    """
    mark = F.coalesce(F.md5("text"), F.lit("-"))
    known = docs.where("doc_id IS NOT NULL").select("doc_id", mark.alias("_mark"))
    repeated = stage(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        found = near_duplicates(docs, words, percent).where("NOT kept").select("doc_id")
        dropped = stage(found, "near-duplicates")
        return docs.join(small(dropped), "doc_id", "left_anti").select(docs.columns)
    texts = ranked(known.distinct(), [F.col("doc_id"), F.col("_mark")], "texts").select(F.struct("doc_id", "_mark").alias("_key"), F.col("rank").alias("_node"))
    of_docs = docs.where("doc_id IS NOT NULL").withColumn("_key", F.struct("doc_id", mark.alias("_mark")))
    rows = stage(join_hot(of_docs, texts, "_key").drop("_key"), "texts")
    found = near_duplicates(rows.select(F.col("_node").alias("doc_id"), "text"), words, percent)
    dropped = stage(found.where("NOT kept").select(F.col("doc_id").alias("_node")).distinct(), "near-duplicates")
    rest = rows.join(small(dropped), "_node", "left_anti")
    several = small(stage(rest.groupBy("_node").count().where("count > 1").select("_node"), "repeated"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = rest.join(several, "_node", "left_semi").groupBy("_node").agg(F.min(F.struct("doc_id", "text", *others)).alias("row"))
    once = rest.join(several, "_node", "left_anti").select(docs.columns)
    kept = once.unionByName(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
    return kept.unionByName(docs.where("doc_id IS NULL"))
