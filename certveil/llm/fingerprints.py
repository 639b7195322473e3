"""Winnowing fingerprints: the least rolling k-gram hash of each window, rightmost on ties, with positions.

Each run of k code points hashes to 64 bits (a polynomial over the points, finished by a mixer; it
is evaluated by doubling, which gives what rolling would). Of every ``window`` neighbouring hashes
the least is kept, the rightmost where several are least, once per position. (Hashes are cut to 33
bits; below them 31 bits hold the position counted from the right, so that one minimum does both.) So any two texts that
share ``window + k - 1`` points in a row share a fingerprint entry. Texts shorter than that have one
window over what hashes they have; texts of fewer than k points hash whole.

A fingerprint is kept as text: ``position:hash`` entries joined by blanks, empty for the empty text.
Likeness is the weighted Jaccard of the multisets of hashes: 1 for two empty fingerprints, 0 if one
is empty.

The query also needs each row's next row by descending id. Ids are cut into blocks at quantiles (so
any ids spread evenly); a block's greatest row also goes to the block above. Then each block is read
in order, and only the row before is held.

Defined cases: null text counts as empty; rows of one id are ordered by text; a single row follows
itself; null ids come last; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions

K, WINDOW = 8, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k points (one of the whole text if it is shorter)."""
    k = min(k, len(points))
    h, size, base = points.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, done = None, 0
    n = len(points) - k + 1
    while True:  # binary method: runs of 1, 2, 4, ... points make up those of k
        if k & size:
            part = h[done : done + n]
            out = part.copy() if out is None else out * base + part
            done += size
        if 2 * size > k:
            break
        h = h[:-size] * base + h[size:]
        with np.errstate(over="ignore"):
            base = base * base
        size *= 2
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept entries, by position."""
    points = _points(text)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _hashes(points, k)
    low = np.uint64(2**31 - 1)
    x = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    w, size = min(window, len(h)), 1
    while 2 * size <= w:  # least of 2, 4, ... neighbours
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < w:
        x = np.minimum(x[: len(x) - (w - size)], x[w - size :])
    x = x[np.concatenate(([True], x[1:] != x[:-1]))]
    return (low - (x & low)).astype(np.int64), x >> np.uint64(31)


def as_text(entries: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join([f"{p}:{h:09x}" for p, h in zip(entries[0].tolist(), entries[1].tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u, m = np.unique(a, return_counts=True)
    v, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _targets(cuts: np.ndarray, also: dict[int, int]):
    """block << 32 | 1 + the block that needs a copy (0: none)."""

    @F.pandas_udf("long")
    def target(ids: pd.Series) -> pd.Series:
        a = ids.to_numpy(np.int64)
        out = np.searchsorted(cuts, a, "left").astype(np.int64) << 32
        if also:
            heads = np.array(sorted(also))
            i = np.minimum(np.searchsorted(heads, a), len(heads) - 1)
            hit = heads[i] == a
            out[hit] |= np.array([also[h] + 1 for h in heads.tolist()])[i[hit]]
        return pd.Series(out)

    return target


def _walk(k: int, window: int):
    def row(held, following: str, entries):
        doc_id, text, own = held
        new = edited(text, following)
        changed = winnow(new, k, window)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, as_text(own), as_text(changed), likeness(own[1], changed[1]), likeness(own[1], entries[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                out = []
                for block, extra, doc_id, text in zip(*(c.to_pylist() for c in whole.slice(start, 1000).columns), strict=True):
                    if block != at:
                        held, at = None, block
                    if extra and held is None:
                        continue
                    entries = winnow(text, k, window)
                    if held is not None:
                        out.append(row(held, text, entries))
                    held = None if extra else (doc_id, text, entries)
                if out:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, its edited text's, and their likenesses (see the module)."""
    spark = docs.sparkSession
    last = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = min(4 * partitions(spark), 2000)
    found = rows.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 20_000)).first()[0]
    cuts = np.unique(np.array(found or [], np.int64))
    place = _targets(cuts, {})
    tops = [r.top for r in rows.select("id").groupBy(place("id").alias("block")).agg(F.max("id").alias("top")).orderBy("block").collect()]  # a row a block
    own = np.searchsorted(cuts, np.array(tops, np.int64), "left").tolist()
    also = {top: own[(i + 1) % len(own)] for i, top in enumerate(tops)}
    marked = rows.withColumn("t", _targets(cuts, also)("id"))
    block, copy = F.shiftright("t", 32).cast("int"), (F.col("t").bitwiseAND(F.lit(2**32 - 1)) - 1).cast("int")
    one = F.struct(block.alias("block"), F.lit(False).alias("extra"))
    two = F.struct(copy.alias("block"), F.lit(True).alias("extra"))
    sent = marked.select(F.explode(F.when(copy >= 0, F.array(one, two)).otherwise(F.array(one))).alias("to"), "id", "text")
    sent = sent.select("to.block", "to.extra", "id", "text").repartition(partitions(spark), "block").sortWithinPartitions("block", "extra", F.desc("id"), "text")
    sent = sent.select("block", "extra", F.when(F.col("id") != last, F.col("id")).alias("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(_walk(k, window), schema)
