"""From raw documents to token ids: five stages, each written as Parquet and read again before the next.

Defined cases: a null text counts as empty; empty texts are kept by quality, are equal to each other in exact dedup, are
linked with nothing in near dedup, hold no benchmark item, and have no tokens. Rows with a null or repeated doc_id are
judged each for itself, by its text; exact dedup leaves one of the rows that repeat an id and a text. In ties the smallest
doc_id stays (of near copies, those with a null or repeated id come last). A null lang is a language of its own in the
quality model. Very long texts are read whole. Other columns are passed on, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitegrain.llm import decontaminate, exact_dedup, minhash, quality
from sitegrain.llm.common import table
from sitegrain.llm.queries import bpe_digests
from sitegrain.session import scratch_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return minhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("byte_bpe", tokens_stage),
]

#: SQL has no word for the model, the minima and the tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
