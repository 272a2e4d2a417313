"""A corpus from raw documents to token ids: the stages of run(), each written as Parquet and reread by the next.

All stages but the last return the columns of documents, further columns of their input play no part and are dropped.

Defined results of every stage: a null text counts as empty, whole texts of any length are read, an empty table gives no
rows. Rows without doc_id are documents like others; rows that repeat the doc_id and the text are copies of one another.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bytestrata.llm import bpe, exact_dedup, mixing, near_join, quality_rules
from bytestrata.llm._common import delete_folder, read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep: each row is judged by its text alone, so equal texts fare alike."""
    return quality_rules.survivors(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, of those the smallest doc_id, null ids last, and one row of it."""
    return exact_dedup.survivors(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest doc_id, null ids last. Texts without words are one class."""
    return near_join.survivors(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, in shards and shuffled there: a document's row as often as the mix takes it, never one without words."""
    return mixing.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and digests of them and of what they decode to; no ids for an empty text, rows repeat as they do."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("mixing", mix), ("bpe", tokens)]

#: Hashed ratios, permutations and merges aren't SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents. A stage's folder goes when the next one is written; the last one's stays."""
    docs, base = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete_folder(spark, f"{base}/{k - 1}")
    return docs
