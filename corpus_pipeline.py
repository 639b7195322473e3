"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for
the last, returns the columns of documents. The toxicity and language stages judge each row by its
text. The others decide by id: rows that repeat a doc_id are one document there and stay or go
together (its texts are linked, so a group may hold texts that are alike only by way of it), and rows
with a null doc_id are never dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certveil.llm import decontamination, language_id, near_dedup, packing, toxicity
from certveil.llm.shared import release, shared_dir, table, without, written
from certveil.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity network, fitted on the labelled ones, scores 0.5 or more. Empty texts stay unless they score so."""
    labels = table(ship(spark), sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those far from every language's centroids."""
    ship(spark)
    return language_id.drop_rejected(docs, language_id.fit(docs.where(~language_id.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group."""
    ship(spark)
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("doc"))
    return without(docs, written(gone, "duplicates"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or with other numbers, names or units."""
    ship(spark)
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, written(found.select(F.col("doc_id").alias("doc")).distinct(), "contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

# Trained models and the tokenizer are beyond SQL; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written as Parquet in the shared folder and read again. The operators' own
    intermediate tables are deleted after each stage; the stages' tables stay there for the caller."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)
        docs = spark.read.parquet(path)
    return docs
