"""A corpus pipeline: each stage reads what the one before it has written.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of documents. Every stage
judges all rows it gets. Null texts count as empty, and rows with a null doc_id are never removed; rows that
share a doc_id stay or go together; very long texts are worked on whole; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm import leaks, neardup, packing, secrets, toxicity
from rivalry.llm.common import delete_folder, scratch_scope, shared_dir, table
from rivalry.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score 0.7 or more, learned from the labels of the documents that are not held out.

    Without labels of both kinds nothing is removed; extra columns of docs are dropped, here and in each stage
    that returns documents.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, the one with the smallest id, of each group linked at a similarity of 0.8 over shingles of five words."""
    return neardup.drop_near_duplicates(docs, 5, 80).select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a passage of a benchmark item. An empty benchmark removes nothing."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret replaced by a mark, and n_chars counted again. No document is removed; a null text stays null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of a document, in sequences of 1024 tokens.

    A null or empty text is one piece of one id.
    """
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes on the way is deleted once its result is written, and so is that result once
    the next stage's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete_folder(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
