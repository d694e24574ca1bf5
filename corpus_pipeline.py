"""A corpus pipeline: identify languages, drop copies and near copies, mix sources, encode."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tripspark.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from tripspark.llm.common import checkpoint_folder, documents, remove_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null texts, texts without letters, mere guesses. All columns stay; an empty table stays empty."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z and a-z the one with the largest doc_id stays; null equals the empty text. All columns stay; rows that repeat id and text stay or go together."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by an n-gram similarity of 0.8 or more the one with the smallest doc_id stays. All columns stay; rows with a null id and texts without words stay."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream of all documents in which each source has its target weight; small sources repeat, so rows may too. All columns keep their values; a null source is one of its own."""
    return mixing.mixed_stream(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the decoded text, and its place in the stream; a null text has no tokens."""
    placed = mixing.stream_position(docs)
    return bpe.bpe_encode(placed, carry=("stream_part", "stream_row")).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again. What a stage no longer reads is deleted; the last one's input stays."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
