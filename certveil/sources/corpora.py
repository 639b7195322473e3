"""Corpus sources and sinks: JSON lines with labelled spans, Parquet, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import gold_spans
from ..schema import DOCUMENT, FINANCE_TYPES, GRETEL_LABELS, NEMOTRON_LABELS

#: name -> (label map, characters kept of a text before spans are checked)
CORPORA = {"synpii": ({}, None), "synpii-f": ({}, None), "gretel": (GRETEL_LABELS, 8000), "nemotron": (NEMOTRON_LABELS, None)}


def read_jsonl(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Documents from JSON lines under a declared schema; blank lines are skipped, as a batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(DOCUMENT).json(path).where("id is not null")
    return rows.withColumnRenamed("id", "doc_id").withColumn("is_dup", F.coalesce("is_dup", F.lit(False)))


def load_corpus(spark: SparkSession, name: str, path: str, allowed: tuple[str, ...] = FINANCE_TYPES) -> tuple[DataFrame, DataFrame]:
    """(documents, gold spans) of a corpus by name; unknown names raise."""
    if name.lower() not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}; known: {', '.join(sorted(CORPORA))}")
    table, keep = CORPORA[name.lower()]
    docs = read_jsonl(spark, path)
    gold = gold_spans(docs, table, allowed, keep)
    return (docs.withColumn("text", F.substring("text", 1, keep)) if keep else docs), gold


def filtered(docs: DataFrame, **equals: str) -> DataFrame:
    """Rows whose columns have the given values (language, domain)."""
    for column, value in equals.items():
        docs = docs.where(F.col(column) == value)
    return docs


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, to be held against a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def drift(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries (path, sha256) that are missing or changed."""
    found = digests.select("path", F.col("sha256").alias("found"))
    return manifest.join(found, "path", "left").where(F.col("found").isNull() | (F.col("found") != F.col("sha256"))).select("path", F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("state"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def finite(df: DataFrame) -> DataFrame:
    """Infinities as the text "inf", so that reports stay valid JSON."""
    cols = [F.when(F.col(c) == float("inf"), F.lit("inf")).when(F.col(c) == float("-inf"), F.lit("-inf")).otherwise(F.col(c).cast("string")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)
