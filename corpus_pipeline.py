"""A training corpus from raw documents: language, near copies, benchmark passages, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from risewatch.llm import bpe, decontam, langid, neardup
from risewatch.llm.common import stage, table
from risewatch.llm.queries import RANKS, is_held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language.

    Rejected are those without a letter (no language at all), null and empty texts included, and those for
    which no learned language is more likely than all others together.  Columns other than those of
    ``documents`` are left out, whatever their names.  Repeated rows and rows without doc_id are judged like
    any others.  Where no row has a language there is nothing to recognise, and no row stays.
    """
    model = langid.fit(docs.where(~is_held_out()))
    return langid.keep_recognised(docs.select(COLUMNS), model, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares 80 in 100 of its five-word shingles.

    The one with the smallest doc_id stays.  Rows equal in doc_id and text are one document, and the row with
    the least other columns stays; different texts under one doc_id are documents of their own.  Texts that
    are null or hold no word, and rows without doc_id, stay.  An empty table stays empty.
    """
    return neardup.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item.

    An item counts as held where 80 in 100 of its five-word shingles are.  Null and empty texts and items
    hold nothing; repeated rows share their fate; a row without doc_id is judged by its own text.  Without
    items all rows stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), words=5, containment=0.8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded.

    One row out per row in, repeated rows and null ids included; a null or empty text has no tokens.
    """
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encode", encode),
]

#: Language scores and byte-pair merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
