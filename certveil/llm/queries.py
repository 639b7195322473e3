"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(ship(spark), sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archive, write_archive

    return read_archive(write_archive(table(ship(spark), sf_dir, "pages"), least=0)).drop("url")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    return count_tokens(table(ship(spark), sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), limit=1024)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = table(ship(spark), sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(ship(spark), sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), capacity=4096)


def op6_chat_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotation import link

    return link(table(spark, sf_dir, "conversations"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(ship(spark), sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next

    return compare_with_next(table(ship(spark), sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(ship(spark), sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
