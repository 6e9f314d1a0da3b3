"""BPE and token files against the tokenizer libraries."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from risewatch.llm import bpe, chunks, token_files
from risewatch.llm.queries import RANKS, TOKENIZER, op1_bpe, op2_token_files
from tests.llm.helpers import docs

ODD = [
    "", " ", "  ", "\n", "a  b", "a \n b", "\n \nfoo", "x\x1c y", "don't  won't\t\tstop ", "日本語 テキスト", "🎉🎉 émoji",
    "a" * 3000, " " * 5000 + "b", "ab" * 2000, "  x 　y", "1234567 89 ½²", "<|endoftext|> x", "a  <|endoftext|>  b <|endoftext|>\n", "\\ \\\x00 ﻿",
    "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(20_000)), "==== ----\r\n\r\n  x",
]


@pytest.fixture(scope="module")
def tik():
    with open(P.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hub():
    return Tokenizer.from_file(P.path(TOKENIZER))


def texts():
    r = random.Random(1)
    letters = " \n\t\x1c\x85a bé'sd1.!_ñ½　<|"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]


def parts(flat, counts):
    at = 0
    for n in counts:
        yield flat[at : at + n].tolist()
        at += n


def test_chunks_join_to_the_text():
    for text in texts():
        assert " ".join(chunks.split(pa.array([text]))[0].as_py()) == text


def test_both_encoders_equal_their_library(tik, hub):
    found = bpe.encoder(P.path(RANKS), P.PATTERN).encode(texts())
    assert list(parts(*found)) == [tik.encode_ordinary(x) for x in texts()]
    found = token_files.encoder(P.path(TOKENIZER)).encode(texts())
    assert list(parts(*found)) == [hub.encode(x, add_special_tokens=False).ids for x in texts()]


def test_chunk_table_is_emptied_and_goes_on(tik):
    encoder = chunks.ChunkEncoder(bpe.encoder(P.path(RANKS), P.PATTERN).encode_new, most_chunks=10)
    for text in texts()[:300]:
        assert encoder.encode([text])[0].tolist() == tik.encode_ordinary(text)


def test_parts_of_chunks_join_and_encode_alike(tik, hub):
    r = random.Random(2)
    letters = ["a", "Q", "é", "ß", "я", "語", "ǅ", "ʰ", "ª", "𐐀", "Ა", "\u0301", "²", "7", "'", "'s", "’", "\x00", "\u200d", "_", ".", ",", "\n", "\t", "-", "(", "🎉", " ", " "]
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    chunks_ = ["", *(x.strip(" ") for x in odd), "", "."]
    parts_, sizes = chunks.cut(chunks_)
    at = [0, *sizes.cumsum().tolist()]
    assert ["".join(parts_[a:b]) for a, b in zip(at, at[1:])] == chunks_ and max(sizes) > 2
    assert chunks.cut(["don't.stop,.x", "a1.b"])[0] == ["don't", ".stop", ",.x", "a1.b"]
    found = bpe.encoder(P.path(RANKS), P.PATTERN).encode(odd)
    assert list(parts(*found)) == [tik.encode_ordinary(x) for x in odd]
    found = token_files.encoder(P.path(TOKENIZER)).encode(odd)
    assert list(parts(*found)) == [hub.encode(x, add_special_tokens=False).ids for x in odd]


def counting(seen):
    """Encodes every chunk as its length, and notes it."""

    def encode_new(firsts, rests):
        seen.extend([*firsts, *rests])
        return np.array([len(x) for x in [*firsts, *rests]], np.int32), np.ones(len(firsts) + len(rests), np.int64)

    return encode_new


def test_parts_seen_before_are_not_encoded_again():
    seen = []
    encoder = chunks.ChunkEncoder(counting(seen))
    encoder.encode(["x word end.\nNext", "x word, x"])
    assert sorted(seen) == sorted(["x", " word", " end", ".\nNext", ",", " x"])
    seen.clear()
    assert encoder.encode(["x word.\nNext end, word.\nNext", ""])[0].tolist() == [1, 5, 6, 4, 1, 5, 6, 0]
    assert seen == [""]


def test_between_tasks_as_many_chunks_stay_as_are_asked_for():
    seen = []
    encoder = chunks.ChunkEncoder(counting(seen))
    words = [f"{i}" for i in range(100_000)]
    text = " ".join(["first", *words, *words, *words[:5]])
    encoder.encode([text, text])
    encoder.shrink(token_files.BETWEEN_TASKS)
    seen.clear()
    found = encoder.encode([text])
    assert seen == [] and found[0].tolist() == [len(x) + (k > 0) for k, x in enumerate(text.split(" "))]
    encoder.shrink(6)
    encoder.encode(["first 0 1 2 3 4 5"])
    assert len(seen) == 1


def test_long_rows_equal_short_rows():
    ranks = bpe.ranks(P.path(RANKS))
    r = random.Random(5)
    for _ in range(300):
        piece = "".join(r.choice("etaoin shrdlu.-="[: r.randint(2, 16)]) for _ in range(r.randint(2, 200))).encode()
        long = ranks.merge_long(ranks.of_byte[list(piece)])
        if piece not in ranks.ids:
            assert long.tolist() == ranks.encode_pieces([piece])[0].tolist()


def digest(ids):
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_round_trip_over_whole_table(spark, sf_dir, tik):
    found = {r.doc_id: r for r in op1_bpe(spark, sf_dir).collect()}
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(given)
    for row in given:
        ids = tik.encode_ordinary(row.text or "")
        r = found[row.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(ids))
        assert r.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_round_trip_of_odd_rows(spark, tik):
    given = docs(spark, [None, *ODD, "twice", "twice"]).unionByName(docs(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    given = given.withColumn("n_tokens", F.lit("clash"))
    out = bpe.round_trip(given, P.path(RANKS), P.PATTERN, ids=True)
    assert {r.doc_id: r.ids for r in out.where("doc_id IS NOT NULL").collect()} == {
        i: tik.encode_ordinary(x) for i, x in enumerate(["", *ODD, "twice", "twice"])
    }
    assert out.count() == given.count()
    assert bpe.round_trip(given.limit(0), P.path(RANKS), P.PATTERN).count() == 0


def expect_files(rows, hub):
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*hub.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return want


def test_token_files_over_whole_table(spark, sf_dir, hub):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op2_token_files(spark, sf_dir).collect())) == sorted(expect_files(given, hub))


def test_token_files_of_odd_rows_and_selective_reads(spark, hub, tmp_path):
    given = docs(spark, [None, *ODD, "twice", "twice"]).withColumn("ids", F.lit("clash"))
    given = given.unionByName(given.where("doc_id = 3")).unionByName(given.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    out = str(tmp_path / "files")
    token_files.write(given, P.path(TOKENIZER), out, page_rows=4)
    found = [tuple(r) for r in token_files.digests(token_files.read_starts(spark, out)).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(found, key=key) == sorted(expect_files(given.select("doc_id", "text").collect(), hub), key=key)
    one = token_files.read(spark, out).where("doc_id = 5")
    assert one.first().ids == [*hub.encode(ODD[4], add_special_tokens=False).ids, 0]
    plan = one.select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and "ids:array" not in plan.split("ReadSchema")[1]
    empty = str(tmp_path / "empty")
    token_files.write(given.limit(0), P.path(TOKENIZER), empty)
    assert token_files.digests(token_files.read_starts(spark, empty)).count() == 0


def test_files_have_delta_pages_and_page_indexes(spark, tmp_path):
    import pyarrow.parquet as pq

    out = tmp_path / "files"
    token_files.write(docs(spark, [f"text {i} of many words" for i in range(5000)]).coalesce(1), P.path(TOKENIZER), str(out))
    meta = pq.ParquetFile(next(out.glob("part-*"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(4)}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
