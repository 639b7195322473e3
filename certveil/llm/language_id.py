"""Language ID by the nearest of several centroids per language.

A text becomes the lower-cased code points of its letters, every run of other characters one
border. Its 1- to 3-grams are hashed to DIMS counts, damped by the square root, weighted by inverse
document frequency and normalised. Each language keeps up to CENTROIDS centroids from a spherical
k-means over its sample; the language of the centroid with the largest cosine wins (ties: the first
centroid in the order of languages). The score is the share of the winner in a softmax over the
languages' best cosines.

Rejection goes by distance: the cosine of a text of n n-grams to its language grows about as
sqrt(n / (n + HALF)); a text whose best cosine, divided by that, lies under NEAR of a low quantile
(LOW) of such values is rejected. They are those of sample texts that centroids of the rest of the
sample were not fitted on, to their own languages; a few odd texts in the sample don't set the floor.

The centroids are fitted on at most SAMPLE texts per language, chosen by hash, of at most LANGUAGES
languages (the most frequent) and TOTAL texts in all; every whole text is classified, with the same
rule at every size.

Defined cases: null texts and texts without a letter give ``und``, score 0, rejected; rows without
language serve no training; without any learned language every text gives ``und``; repeated rows are
classified each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean

DIMS, SAMPLE, CENTROIDS, SHARPNESS, HALF = 4096, 300, 4, 20.0, 512
LANGUAGES, TOTAL = 512, 4800  # learned, at most; of sample texts (16 KB each on the driver)
LOW, NEAR = 0.02, 0.65
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """By code point: 0 for no letter, else the code point in lower case."""
    if not _letters:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters.append(t)
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts; None without a letter."""
    if not text:
        return None
    a = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    a = np.concatenate((a[:1] * np.uint32(0), a, a[:1] * np.uint32(0)))
    a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]
    if len(a) < 2 or not a.any():
        return None
    m1, m2, m3, up = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(20)
    x = a * m1
    one = x[a != 0] >> up
    two = (x[:-1] ^ (a[1:] * m2)) * m3 >> up
    three = ((x[:-2] ^ (a[1:-1] * m2)) * m3 ^ (a[2:] * m2)) * m1 >> up if len(a) > 2 else two[:0]
    return np.bincount(np.concatenate((one, two, three)).astype(np.int64), minlength=DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun from rows far from each other."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        nearest = (x @ _unit(np.array(centres)).T).max(axis=1)
        centres.append(x[int(nearest.argmin())])
    c = _unit(np.array(centres))
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


class Model:
    def __init__(self) -> None:
        self.languages: list[str] = []
        self.idf = np.ones(DIMS, np.float32)
        self.centroids = np.zeros((0, DIMS), np.float32)
        self.owner = np.zeros(0, np.int64)
        self.floor = 0.0
        self.texts = 0  # learned from

    def vector(self, n: np.ndarray) -> np.ndarray:
        return _unit(np.sqrt(n).astype(np.float32) * self.idf)

    def fit(self, rows: list[tuple[str, np.ndarray]]) -> Model:
        if not rows:
            return self
        self.texts = len(rows)
        n = np.array([c for _, c in rows])
        self.idf = (np.log((1 + len(n)) / (1 + (n > 0).sum(axis=0))) + 1).astype(np.float32)
        x = np.array([self.vector(c) for c in n])
        langs = np.array([g for g, _ in rows])
        self.languages = sorted(set(langs.tolist()))
        place = np.zeros(len(rows), np.int64)  # a row's number in its language
        for g in self.languages:
            place[langs == g] = np.arange((langs == g).sum())
        apart = place % 5 == 4
        nearest = []
        for g in self.languages:
            if (mine := (langs == g) & apart).any():
                c = _clustered(x[(langs == g) & ~apart], CENTROIDS)
                size = n[mine].sum(axis=1)
                nearest.append((x[mine] @ c.T).max(axis=1) / np.sqrt(size / (size + HALF)))
        self.floor = NEAR * float(np.quantile(np.concatenate(nearest), LOW)) if nearest else 0.0
        parts = [_clustered(x[langs == g], CENTROIDS) for g in self.languages]
        self.centroids = np.concatenate(parts).astype(np.float32)
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return self

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, best cosine, rejected."""
        n = counts(text)
        if n is None or not self.languages:
            return "und", 0.0, 0.0, True
        cosine = self.centroids @ self.vector(n)
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.owner, cosine)
        i = int(best.argmax())
        share = 1 / np.exp(SHARPNESS * (best - best[i])).sum()
        return self.languages[i], float(share), float(best[i]), bool(best[i] < self.floor * np.sqrt(n.sum() / (n.sum() + HALF)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(g, u, hashlib.md5(c.tobytes()).digest(), np.minimum(c, 2**31 - 1).astype("<i4").tobytes()) for g, u, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (c := counts(t)) is not None]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["lang", "u", "h", "counts"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the ``lang`` and ``text`` of at most ``sample`` texts per language among ``docs`` (see LANGUAGES and TOTAL).
    Equal rows count once, so that a row that stands there many times brings no more to the driver."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not n:
        return Model()
    sample = max(1, min(sample, TOTAL // len(n)))
    rates = F.create_map(*[F.lit(x) for g, c in n.items() for x in (g, min(1_000_000, 1_300_000 * sample // c + 1))])
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1_000_000))).where(F.col("u") < rates[F.col("lang")])
    found = rows.select("lang", "u", "text").mapInArrow(lean("language_id", _vectors), "lang string, u long, h binary, counts binary").dropDuplicates(["lang", "u", "h"])
    least = Window.partitionBy("lang").orderBy("u", "h")
    found = found.withColumn("k", F.row_number().over(least)).where(F.col("k") <= sample).collect()
    return Model().fit([(r.lang, np.frombuffer(bytes(r.counts), "<i4")) for r in sorted(found, key=lambda r: (r.lang, r.k))])


def _classify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [model.classify(t) for t in batch.column(1).to_pylist()]
            lang, score, cosine, rejected = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "cosine", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cosine, rejected for each row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean("language_id", _classify(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, lang_pred string, score double, cosine double, rejected boolean")


def _known(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not model.classify(t)[3] for t in texts], pa.bool_()))

    return run


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without the rows whose text is rejected; all stay where no language was learned."""
    return docs.mapInArrow(lean("language_id", _known(docs.sparkSession.sparkContext.broadcast(model))), docs.schema) if model.languages else docs


def held_out():
    """True for the ids that no training may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2
