"""The pipeline against plain versions of its stages."""

import base64
import hashlib
import struct

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from risewatch.llm.queries import RANKS
from tests.llm.helpers import docs
from tests.llm.test_pairs import brute, near_copies
from tests.llm.test_rows import brute_leaks


def tables(spark, tmp_path, texts, items):
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "encode"]


def test_whole_pipeline_equals_plain_stages(spark, tmp_path):
    item = " ".join(f"question{i} word" for i in range(12))
    texts = [*near_copies(5), "before it " + item + " after it", item.upper(), "123 456", "...", "clean text of its own"]
    sf_dir = tables(spark, tmp_path, texts, [(0, item), (1, None)])
    letters = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    one_each = [i for i, _, _, kept in brute(letters, 5, 80) if kept]
    dirty = {d for d, *_ in brute_leaks([(i, letters[i]) for i in one_each], [(0, item)])}
    assert dirty
    with open(P.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i in one_each:
        if i not in dirty:
            ids = tik.encode_ordinary(letters[i])
            digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            want.append((i, len(ids), digest, hashlib.sha256(letters[i].encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want


def test_nulls_repeats_and_nothing(spark, tmp_path):
    texts = ["some text", None, "some text", ""]
    given = docs(spark, texts, None)
    given = given.unionByName(given.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage_docs in (given, given.limit(0)):
        now = stage_docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
        # No label teaches a language, so no document is in a recognised one.
        assert now.count() == 0
    taught = docs(spark, ["some text", "some text", "other words"])
    now = taught.unionByName(taught.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert sorted((r.doc_id for r in now.collect()), key=str) == [0, 2, None]
