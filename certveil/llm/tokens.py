"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

A pre-token here is a run of white space with the run of other characters after it. No pre-token of
a byte-level tokenizer (and no added special string) crosses such a border, so the pieces of a text
are those of its pre-tokens, each encoded by itself with the library.

1. Every task counts its distinct pre-tokens; the shuffle sums them; each is encoded once.
2. Every document becomes pre-token frequencies. Those of the at most HOT most widespread
   pre-tokens (of at most HOT_CHARS characters, so the broadcast is at most a few MB whatever the
   input) are summed at once; the other (document, pre-token) pairs are joined to the counts by
   pre-token. Token ids are never kept.

Defined cases: null text counts as empty (0 bytes, 0 tokens); each input row gives one row, repeated
rows and null doc_ids too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SPACE = "\t-\r \x85\xa0  -     　"  # fixed values: Unicode White_Space
words = re.compile(f"[^{SPACE}]+").findall
pretokens = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
HOT, HOT_CHARS = 65_536, 48
FLUSH = 400_000  # distinct pre-tokens that a task holds before it passes them on

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer for ``path``, loaded once per worker and single-threaded."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def encoded(path: str, texts: list[str]) -> list[list[int]]:
    t = tokenizer(path)
    return [e.ids for e in getattr(t, "encode_batch_fast", t.encode_batch)(texts, add_special_tokens=False)]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "df"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(set(pretokens(text)))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(ids) for ids in encoded(path, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], names=["pretoken", "df", "pieces"])

    return run


def _frequencies(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = hot.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, ids, size, count, token = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                sure = 0
                for t, n in Counter(pretokens(text)).items():
                    p = known.get(t)
                    if p is None:
                        rows.append(row)
                        ids.append(None)
                        size.append(None)
                        count.append(n)
                        token.append(t)
                    else:
                        sure += n * p
                rows.append(row)
                ids.append(doc_id)
                size.append(len(text.encode("utf-8", "surrogatepass")))
                count.append(sure)
                token.append(f"\0 {row}")  # equal to no pre-token, and spread evenly
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(token, pa.string())],
                names=["row", "doc_id", "n_bytes", "n", "pretoken"],
            )

    return run


def _hot(vocabulary: DataFrame) -> dict[str, int]:
    """The most widespread pre-tokens, cut at a document frequency so that at most HOT are meant."""
    short = vocabulary.where(F.length("pretoken") <= HOT_CHARS)
    steps = sorted(short.groupBy(F.floor(F.log2("df") * 4).alias("step")).count().collect(), reverse=True)
    total, least = 0, None
    for step, n in steps:
        total += n
        if total > HOT:
            break
        least = step
    if least is None:
        return {}
    return {r.pretoken: r.pieces for r in short.where(F.floor(F.log2("df") * 4) >= least).select("pretoken", "pieces").collect()}


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for each row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    distinct = texts.select("text").mapInArrow(_distinct, "pretoken string, df long").groupBy("pretoken").agg(F.sum("df").alias("df"))
    vocabulary = written(distinct.mapInArrow(_pieces(path), "pretoken string, df long, pieces int"), "vocabulary")
    hot = spark.sparkContext.broadcast(_hot(vocabulary))
    rows = texts.mapInArrow(_frequencies(hot), "row long, doc_id long, n_bytes long, n long, pretoken string")
    rows = rows.join(vocabulary.select("pretoken", "pieces"), "pretoken", "left")
    sums = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
