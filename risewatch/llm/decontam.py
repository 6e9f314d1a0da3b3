"""Benchmark decontamination by containment search, with DataFrame operations only.

Test items are partitioned by size, their number of distinct shingles.  Each partition has a MinHash
sketch of its own width: the smallest hashes of an item's shingles.  A document's shingles are looked up
in the sketches' table, so a short item is found in a document of any length, where comparing whole
sketches would drown it.  Enough hits make a candidate, and its containment is then computed over the
exact shingles, as text.  The hits asked for are so few that an item with the containment asked for has
them with a probability above 1 - 1e-9; partitions whose sketches hold all shingles lose nothing at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import BROADCAST_ROWS, small, stage

#: Width of the sketches of partitions with more shingles than this.
SKETCH = 24
RISK = 1e-9


def words_of(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hits_needed(width: int, containment: float) -> int:
    """Most hits that an item of this containment has with a probability of 1 - RISK or more."""
    tail = 0.0
    for hits in range(width + 1):
        tail += math.comb(width, hits) * containment**hits * (1 - containment) ** (width - hits)
        if tail > RISK:
            return max(1, hits)
    return max(1, width)


def _shingles(words: Column, size: Column, most: int) -> Column:
    """Distinct shingles as text.  Elements are taken one by one, as a slice would copy the whole array."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
    texts = F.transform(
        places, lambda i: F.concat_ws(" ", *(F.when(size > j, F.get(words, i + j)) for j in range(most)))
    )
    return F.array_distinct(F.coalesce(texts, F.array().cast("array<string>")))


def _hashes(words: Column, size: int) -> Column:
    """Hash of the shingle at each place, null behind the last."""
    last = F.size(words) - size
    return F.transform(
        words, lambda w, i: F.when(i <= last, F.xxhash64(w, *(F.get(words, i + j) for j in range(1, size))))
    )


def find(docs: DataFrame, items: DataFrame, words: int = 5, containment: float = 0.8) -> DataFrame:
    """Pairs of a document (doc_id, text) and an item (item_id, text) whose share of the item's distinct
    `words`-word shingles that the document has is `containment` or more:
    doc_id, text_key, item_id, n_shingles, n_found, containment.

    Words are lower-case runs of letters and digits.  An item of fewer words is one shingle of all of
    them; an item without words, or a null text, is found nowhere.  A document is known by its doc_id and
    text_key, the hash of its text, so repeated rows give one row, rows that share a doc_id each give
    their own, and null ids of either side are kept as they are.  Equal items under several ids all show.
    Other columns are left out; empty tables give no pairs.  Texts are read whole.
    """
    size = F.least(F.size("words"), F.lit(words))
    known = (
        items.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
        .withColumn("size", size).withColumn("shingles", _shingles(F.col("words"), F.col("size"), words))
        .select("item_id", "size", "shingles", F.xxhash64(F.coalesce("item_id", F.lit(-1)), F.array_join("words", " ")).alias("item"))
        .dropDuplicates(["item", "item_id"])
    )
    known = stage(known, "items")
    table = stage(_sketched(known, words, containment), "item-sketches")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of("text").alias("words"))
    hits = None
    for n in sorted(r["size"] for r in known.select("size").distinct().collect()):  # `words` sizes at most
        of_size = small(table.where(F.col("size") == n).select("hash", "item"))
        # The outer form: the plain one lets Spark infer a filter over the whole expression below the words'
        # projection, which would split the text again for every word.
        places = keyed.select("doc_id", "text_key", F.explode_outer(_hashes(F.col("words"), n)).alias("hash"))
        places = places.where("hash IS NOT NULL")
        found = places.join(of_size, "hash").groupBy("doc_id", "text_key", "item").agg(F.count_distinct("hash").alias("hits"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return _nothing(docs, items)
    needed = small(table.select("item", "needed").distinct())
    candidates = stage(hits.join(needed, "item").where("hits >= needed").drop("hits", "needed"), "candidates")
    return _verified(docs, known, candidates, words, containment)


def _sketched(known: DataFrame, words: int, containment: float) -> DataFrame:
    """(size, item, needed, hash): the sketch of every item, by partition of its number of shingles.

    Partitions hold the numbers from a power of two up to the next; those up to SKETCH keep everything.
    """
    number = F.size("shingles")
    floor = F.pow(F.lit(2), F.floor(F.log2(number))).cast("int")  # the partition
    width = F.when(number <= SKETCH, number).otherwise(SKETCH)
    # The smallest need of a partition's items, so that one rule holds for the whole partition.
    complete = F.ceil(F.lit(containment) * floor - 1e-9).cast("int")
    needed = F.when(floor * 2 - 1 <= SKETCH, F.greatest(F.lit(1), complete)).when(
        floor > SKETCH, hits_needed(SKETCH, containment)
    ).otherwise(F.least(complete, F.lit(hits_needed(SKETCH, containment))))
    # Hash a shingle as a document's words are hashed: word by word.
    hashes = F.array_sort(F.transform("shingles", lambda s: _hash_words(F.split(s, " "), words)))
    return known.select("size", "item", needed.alias("needed"), F.explode(F.slice(hashes, F.lit(1), width)).alias("hash"))


def _hash_words(parts: Column, words: int) -> Column:
    """A null leaves a hash as it is, so a shingle of fewer words hashes as its own words do."""
    return F.xxhash64(*(F.get(parts, F.lit(i)) for i in range(words)))


def _verified(docs: DataFrame, known: DataFrame, candidates: DataFrame, words: int, containment: float) -> DataFrame:
    """Exact containment of the candidates; their documents' texts are read once more."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    rows = candidates.count()
    wanted = candidates.withColumnRenamed("doc_id", "of").withColumnRenamed("text_key", "of_key")
    met = texts.join(small(wanted, rows), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")))
    met = met.join(small(known, BROADCAST_ROWS + 1), "item").select(
        "doc_id", "text_key", "item_id", "size", "shingles", words_of("text").alias("words")
    )
    found = F.size(F.array_intersect("shingles", _shingles(F.col("words"), F.col("size"), words)))
    counted = met.select("doc_id", "text_key", "item_id", F.size("shingles").alias("n_shingles"), found.alias("n_found"))
    counted = stage(counted, "containments")  # likewise, no filter may go below the words
    share = F.col("n_found") / F.col("n_shingles")
    return counted.withColumn("containment", share).where(share >= containment).distinct()


def _nothing(docs: DataFrame, items: DataFrame) -> DataFrame:
    doc_id, item_id = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {doc_id}, text_key bigint, item_id {item_id}, n_shingles int, n_found int, containment double"
    return docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, words: int = 5, containment: float = 0.8) -> DataFrame:
    """The rows of `docs` in which no item is found; columns stay."""
    dirty = stage(find(docs, items, words, containment).select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).distinct(), "dirty")
    dirty = small(dirty)
    # By frame, as `docs` may have columns of any name.
    same = docs["doc_id"].eqNullSafe(dirty["of"]) & (F.xxhash64(docs["text"]) == dirty["of_key"])
    return docs.join(dirty, same, "left_anti")
