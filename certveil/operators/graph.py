"""Duplicates, entity components and score propagation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalise_value
from ..session import materialised, split_join

PRIME = 2_147_483_647


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, first_id, is_dup): the smallest id of equal canonical texts is the original."""
    keyed = materialised(docs.select("doc_id", content_hash(F.col("text")).alias("content_hash")), "hashes")  # texts are read once
    firsts = keyed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return split_join(keyed, firsts, ["content_hash"], "copies", keyed.count()).select("doc_id", "content_hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_dup"))


def coefficients(n: int) -> list[tuple[int, int]]:
    """Multipliers and shifts of the hash family, from a rule: powers of 48271 modulo the prime."""
    out, x = [], 20_011
    for _ in range(n):
        a = x = x * 48_271 % PRIME
        b = x = x * 48_271 % PRIME
        out.append((a, b))
    return out


def _words() -> Column:
    return F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")


def word_shingles(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, h): distinct 31-bit hashes of the k-word shingles."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))
    rows = docs.select("doc_id", _words().alias("w")).where(F.size("w") > 0).select("doc_id", F.explode(F.array_distinct(grams)).alias("g"))
    return rows.select("doc_id", (F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long") % PRIME).alias("h")).distinct()


def _minima(permutations: int, k: int):
    a, b = (np.array(x, np.int64)[:, None] for x in zip(*coefficients(permutations), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = []
            for words in batch.column(1).to_pylist():
                grams = {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
                h = np.fromiter((int.from_bytes(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:4], "big") % PRIME for g in grams), np.int64, len(grams))
                low = np.full(permutations, PRIME, np.int64)
                for at in range(0, len(h), 4096):  # whatever the length of a text
                    np.minimum(low, ((h[None, at : at + 4096] * a + b) % PRIME).min(axis=1), out=low)
                sigs.append(low)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            offsets = pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * permutations)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "sig"])

    return run


def signatures(docs: DataFrame, permutations: int = 128, k: int = 5) -> DataFrame:
    """(doc_id, sig): minima of (a*h + b) mod 2^31-1 over the shingle hashes of each text with words, one row to one row: nothing is exploded or shuffled."""
    rows = docs.select("doc_id", _words().alias("w")).where(F.size("w") > 0)
    return rows.mapInArrow(_minima(permutations, k), f"doc_id {dict(rows.dtypes)['doc_id']}, sig array<long>")


def lsh_pairs(signatures: DataFrame, bands: int = 4, rows: int = 4) -> DataFrame:
    """(a, b, agreement): pairs in one bucket of some band, with the agreeing share of their signatures.

    Equal signatures collapse to their smallest id before the join, so copies make no pairs of pairs."""
    groups = signatures.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.slice("sig", i * rows + 1, rows).alias("key")) for i in range(bands)])
    banded = groups.select("doc_id", F.explode(keys).alias("x")).select("doc_id", "x.band", "x.key")
    pairs = banded.alias("l").join(banded.alias("r"), ["band", "key"]).where("l.doc_id < r.doc_id").select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
    near = pairs.join(groups.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(groups.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return near.select("a", "b", (same / F.size("sa")).alias("agreement"))


def neighbours(pairs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, other, agreement): both directions of the pairs that agree at least so far."""
    near = pairs.where(F.col("agreement") >= threshold)
    return near.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), "agreement").unionByName(near.select(F.col("b").alias("doc_id"), F.col("a").alias("other"), "agreement"))


def equal_signatures(signatures: DataFrame) -> DataFrame:
    """(a, b): each document after the first of an equal signature, which lsh_pairs collapses, with that first one."""
    firsts = signatures.groupBy("sig").agg(F.min("doc_id").alias("a"))
    return signatures.join(firsts, "sig").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))


def full_agreement(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b, agreement): the Jaccard likeness of each pair's whole shingle sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = shingles.join(ids, "doc_id", "left_semi")
    n = sets.groupBy("doc_id").agg(F.count("*").alias("n"))
    left, right = sets.select(F.col("doc_id").alias("a"), "h"), sets.select(F.col("doc_id").alias("b"), "h")
    shared = pairs.select("a", "b").join(left, "a").join(right, ["b", "h"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = shared.join(n.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("agreement"))


def duplicate_of(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, original): the first exact copy, else the most similar earlier document of at least ``threshold``."""
    exact = exact_duplicates(docs)
    near = pairs.where(F.col("agreement") >= threshold).groupBy(F.col("b").alias("first_id")).agg(F.max_by("a", F.struct("agreement", -F.col("a"))).alias("near_id"))
    return exact.join(near, "first_id", "left").select("doc_id", F.when(F.col("is_dup"), F.col("first_id")).otherwise(F.col("near_id")).alias("original"))


def with_component(spans: DataFrame) -> DataFrame:
    """Adds the identity key (type and normalised value) that names a span's component."""
    return spans.withColumn("value", normalise_value(F.col("match"), F.col("type")))


def components(spans: DataFrame) -> DataFrame:
    return spans.groupBy("type", "value").agg(F.count("*").alias("size"), F.max("score").alias("top"))


def graph_stats(spans: DataFrame) -> DataFrame:
    c = components(spans)
    return c.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.sum(F.col("size") - 1).alias("identity_edges"), F.max("size").alias("largest"), F.avg("size").alias("mean_size"))


def identity_channel(spans: DataFrame, beta1: float = 0.95) -> DataFrame:
    """Adds ``identity``: a component of two or more lifts its members to beta1 times its best score.

    Maxima are aggregated before the shuffle and joined back; huge components are broadcast, so none gathers in a task."""
    best = spans.groupBy("type", "value").agg(F.max("score").alias("best"), F.count("*").alias("size"))
    lifted = F.when(F.col("size") > 1, F.greatest("score", beta1 * F.col("best"))).otherwise(F.col("score"))
    return split_join(spans, best, ["type", "value"], "size", spans.count()).withColumn("identity", lifted).drop("best", "size")


def affinity(edges: DataFrame, cap: int = 32) -> DataFrame:
    """(src, dst, w): both directions, the ``cap`` heaviest per source (ties: smaller dst), rows summing to 1."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    top = both.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("rk") <= cap)
    return top.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("w"))


def diffusion_channel(nodes: DataFrame, edges: DataFrame, beta2: float = 0.6, steps: int = 3) -> DataFrame:
    """(node, diffusion): (1 - beta2) * sum over t of beta2^t A^t score, t up to ``steps``; ``edges`` are normalised."""
    term = nodes.select("node", F.col("score").alias("x"))
    total = term.select("node", ((1 - beta2) * F.col("x")).alias("y"))
    for t in range(1, steps + 1):
        term = edges.join(term.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        total = total.unionByName(term.select("node", ((1 - beta2) * beta2**t * F.col("x")).alias("y")))
    return total.groupBy("node").agg(F.sum("y").alias("diffusion"))


def context_vectors(spans: DataFrame, docs: DataFrame, width: int = 64) -> DataFrame:
    """(node, token, w): L2-normalised bags of the words around each span; spans carry ``node``."""
    left = F.greatest(F.col("start") - width, F.lit(0))
    around = F.lower(F.concat(F.substring("text", left + 1, F.col("start") - left), F.lit(" "), F.substring("text", F.col("end") + 1, F.lit(width))))
    words = F.filter(F.regexp_extract_all(around, F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1)
    rows = spans.join(docs.select("doc_id", "text"), "doc_id").select("node", F.explode(words).alias("token"))
    counts = rows.groupBy("node", "token").agg(F.count("*").cast("double").alias("n"))
    norms = counts.groupBy("node").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "node").select("node", "token", (F.col("n") / F.col("norm")).alias("w"))


def similarity_edges(spans: DataFrame, vectors: DataFrame, pairs: DataFrame, least: float = 0.35) -> DataFrame:
    """(src, dst, w): spans of one type in documents of a near pair whose contexts have that cosine at least."""
    s = spans.select("doc_id", "type", "node")
    two = pairs.join(s.withColumnsRenamed({"doc_id": "a", "node": "src"}), "a").join(s.withColumnsRenamed({"doc_id": "b", "node": "dst"}), ["b", "type"])
    dots = two.join(vectors.withColumnsRenamed({"node": "src", "w": "ws"}), "src").join(vectors.withColumnsRenamed({"node": "dst", "w": "wd"}), ["dst", "token"])
    return dots.groupBy("src", "dst").agg(F.sum(F.col("ws") * F.col("wd")).alias("w")).where(F.col("w") >= least)


def propagate(spans: DataFrame, edges: DataFrame, beta1: float = 0.95, beta2: float = 0.6, steps: int = 3) -> DataFrame:
    """Spans (with ``node``, ``type``, ``value``) whose score is the larger of both channels, at most 1."""
    lifted = identity_channel(spans, beta1)
    spread = diffusion_channel(spans, edges, beta2, steps)
    score = F.least(F.lit(1.0), F.greatest("identity", F.coalesce("diffusion", F.lit(0.0))))
    return lifted.join(spread, "node", "left").withColumn("score", score).drop("identity", "diffusion")


def affinity_mass(edges: DataFrame) -> float:
    """The largest sum of a row of the normalised edges: what bounds the gain of any node by its neighbours."""
    return float(edges.groupBy("src").agg(F.sum("w").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("m")).first().m)
