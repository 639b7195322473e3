"""Near-duplicate groups by min-max hashing, banding and exact confirmation.

A document's set holds the distinct 5-word shingles of its text (words: runs of
``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; fewer words: the whole sequence as one shingle; no words
or null text: the empty set, linked with nothing). Each of 64 permutations of the shingle hashes
is evaluated once and gives two signature values, its minimum and its maximum; 32 bands of 4 of
these 128 values propose pairs and every link is confirmed on the full sets
(100 * intersection >= 75 * union). At a similarity of 0.75 a pair misses all bands with a
probability of 5e-6.

How groups of any size stay bounded: equal sets collapse to one node first. Within a bucket each
node is compared with the bucket's smallest one only. In buckets that then still hold more than one
component, the nodes outside the bucket's largest component are compared with all its nodes of other
components: pairs are judged once, in the first bucket that they share. Their left sides go in blocks
of at most some BYTES of signatures and hashes, against which right sides stream, BLOCK nodes or more to
a task: so many more that copies of left sides are COPIES rows for each node of the bucket at most. The
rows of a bucket hence grow with its nodes, until those outside its largest component take more than
BYTES; the comparisons within a task grow with the pairs. Signatures go first, and only nodes with a
candidate in a block send their texts, each joined once. A candidate agrees in LEAST of its
128 signature values; a pair at a similarity of 0.75 has fewer with a probability under 1e-8
(Chernoff's bound), less than what banding loses. A block passes on links that join its components,
fewer than it has nodes. Rows of hot buckets and of equal sets are joined by broadcast of the hot keys
(at most 50,000, see ``split_join``); texts travel only for documents with candidates, found by a
bitmap sized by their count.

Defined cases: rows with a null doc_id are linked with nothing (component_id null, kept true);
rows that repeat a doc_id count as one document, linked by any of its texts, and get the same
component; ties cannot arise (the smallest doc_id names the group); other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import groups, lean, partitions, split_join, texts_of, written

SHINGLE, PERMUTATIONS, ROWS = 5, 64, 4
BLOCK, COPIES = 512, 4  # nodes on the right of one comparison, at least; rows that copies of the left sides may take for each node of a bucket
BYTES, HELD = 1 << 25, 400  # on the left of one comparison, of hashes and signatures; of one node's signature and bands
PAIRS = 1 << 19  # compared at once
STAR = 256  # pairs of one leader that are confirmed together
LEAST = 0.5  # share of equal signature values below which a pair of a crowded bucket isn't confirmed

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _M1 + h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
    out = _mixed(out)
    out.sort()
    return out if len(out) < 2 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima and then the maxima of the permuted hashes, 128 values."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 4096):
        p = _A * x[None, at : at + 4096] + _B
        np.minimum(low, p.min(axis=1), out=low)
        np.maximum(high, p.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * _M3
    for i in range(ROWS):
        key = _mixed(key * _M1 + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, sets, sigs, bands = batch.column(0), [], [], [], []
        for i, (doc_id, text) in enumerate(zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True)):
            h = shingle_hashes(text)
            counts.append(len(h))
            if len(h):
                s = signature(h)
                sets.append(hashlib.md5(h.tobytes()).digest())
                sigs.append((s & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(band_keys(s))
            else:  # a value of its own: empty sets mustn't meet in one task
                sets.append(hashlib.md5(f"{doc_id} {i}".encode()).digest()[:15])
                sigs.append(b"")
                bands.append(np.empty(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["doc_id", "n_shingles", "set_hash", "sig", "bands"],
        )


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, {}
        for batch in batches:
            out = []
            for a, salt, role, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, salt) != at:
                    at, leaders = (a, salt), {}
                h = shingle_hashes(text)
                if role == 0:
                    leaders[h.tobytes()] = h
                elif any(_linked(x, h, percent) for x in leaders.values()):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity; a's text travels once for each STAR pairs."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("doc"))
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("doc"))
    rows = members.unionByName(leaders)
    rows = rows.join(texts_of(docs, rows), "doc").select("a", "salt", "role", "doc", "text")
    n = partitions(docs.sparkSession)
    return rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(lean("near_dedup", _confirm(percent)), "a long, b long")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, comp, signatures, bands."""
    sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    bands = batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column("node").to_numpy(), batch.column("comp").to_numpy(), sigs, bands


def _candidates(key: int, left, right, same: bool) -> np.ndarray:
    """Pairs (row of left, row of right) to confirm: of different components, alike, and with ``key`` as the first band they share."""
    (node, comp, sig, band), (node2, comp2, sig2, band2) = left, right
    ok = comp[:, None] != comp2[None, :]
    if same:  # both sides are outside the largest component: each pair once
        ok &= node[:, None] < node2[None, :]
    turned = len(node) > len(node2)
    if turned:  # the shorter side is walked
        ok, sig, band, sig2, band2 = ok.T, sig2, band2, sig, band
    out = []
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        others = np.flatnonzero(ok[i])
        others = others[(sig2[others] == sig[i]).mean(axis=1) >= LEAST]
        if len(others):
            equal = band2[others] == band[i]
            others = others[band[i][equal.argmax(axis=1)] == key]
            out.append(np.stack((np.full(len(others), i), others), axis=1))
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return pairs[:, ::-1] if turned else pairs


def _left(parts: list[pa.RecordBatch]):
    return [np.concatenate(x) for x in zip(*map(_matrix, parts), strict=True)]


def _slices(batch: pa.RecordBatch, left) -> Iterator[pa.RecordBatch]:
    """Parts of a right side that make at most PAIRS pairs with ``left``."""
    step = max(1, min(1000, PAIRS // len(left[0])))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _sides(run: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches of a group, cut where the side changes: 0 left, 1 right within the largest component, 2 right outside it."""
    for batch in run:
        side = batch.column("side").to_numpy()
        for s in (0, 1, 2):
            at = np.flatnonzero(side == s)
            if len(at):
                yield s, batch.slice(int(at[0]), len(at))


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those rows of each (key, i, j) that have a candidate there, by signatures alone."""
    for (key, _, _), run in groups(batches, ["key", "i", "j"]):
        parts, left, hit = [], None, None
        for side, batch in _sides(run):
            if not side:
                parts.append(batch)
                continue
            if left is None:
                if not parts:
                    break
                left = _left(parts)
                hit = np.zeros(len(left[0]), bool)
            for some in _slices(batch, left):
                pairs = _candidates(key, left, _matrix(some), side == 2)
                if len(pairs):
                    hit[pairs[:, 0]] = True
                    yield some.take(pa.array(np.unique(pairs[:, 1])))
        at = 0
        for part in parts if hit is not None else ():
            mine = hit[at : at + part.num_rows]
            at += part.num_rows
            if mine.any():
                yield part.filter(pa.array(mine))


def _within(percent: int):
    """Links (a, b) between the components of each (key, i, j), confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), rows in groups(batches, ["key", "i", "j"]):
            parts, sets, left, up, found = [], [], None, {}, []

            def root(c, up=up):
                while (d := up.get(c, c)) != c:
                    c = d
                return c

            for side, batch in _sides(rows):
                if not side:
                    parts.append(batch.drop_columns(["text"]))
                    sets += [shingle_hashes(t) for t in batch.column("text").to_pylist()]
                    continue
                if left is None:
                    if not parts:
                        break
                    left = _left(parts)
                for some in _slices(batch, left):
                    right, hashes = _matrix(some), [shingle_hashes(t) for t in some.column("text").to_pylist()]
                    for i, o in _candidates(key, left, right, side == 2).tolist():
                        a, b = root(int(left[1][i])), root(int(right[1][o]))
                        if a != b and _linked(sets[i], hashes[o], percent):
                            up[max(a, b)] = min(a, b)
                            found.append((min(a, b), max(a, b)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def _crowded(hits: DataFrame, first: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Rows (key, i, j, side, node, comp, sig, bands) of the buckets that still hold several components."""
    rest = hits.where("m > 2").join(first, "node", "left")
    rest = written(rest.select("key", "node", F.coalesce("comp", "node").alias("comp"), "n_shingles"), "shared")
    parts = rest.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    buckets = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.max_by("size", F.struct("n", "comp")).alias("top_size"), F.sum("n").alias("all"), F.sum("size").alias("size")).where("all > top.n")
    outside = F.col("all") - F.col("top.n")
    lefts = F.ceil((HELD * outside + 8 * (F.col("size") - F.col("top_size"))) / BYTES).cast("int")
    rights = F.ceil(F.least(F.col("all") / BLOCK, COPIES * F.col("all") / outside)).cast("int")
    buckets = written(buckets.select("key", F.col("top.comp").alias("major"), lefts.alias("lefts"), rights.alias("rights"), "all"), "crowded")
    rest = split_join(rest, buckets, ["key"], "all", total)
    # A node's place on its own side, and all the blocks of the other side that it meets.
    one = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outer = F.col("comp") != F.col("major")
    at = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    right = F.transform(one("lefts"), lambda i: F.struct(i.alias("i"), at("rights", 1).alias("j"), F.when(outer, 2).otherwise(1).alias("side")))
    left = F.transform(one("rights"), lambda j: F.struct(at("lefts", 2).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    rest = rest.withColumn("places", F.when(outer, F.concat(left, right)).otherwise(right)).select("key", "node", "comp", "places")
    rest = rest.join(nodes.select("node", "sig", "bands"), "node").withColumn("at", F.explode("places"))
    return rest.select("key", "at.i", "at.j", "at.side", "node", "comp", "sig", "bands")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is the document's own)."""
    n = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(lean("near_dedup", _sign), "doc_id long, n_shingles long, set_hash binary, sig binary, bands array<long>"), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    sets = written(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets")
    # Texts of one id: their sets are linked, and its empty texts go with them.
    kinds = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high"), F.max("n_shingles").alias("most")).where("low < high and most > 0")
    kinds = written(kinds.select("doc_id"), "kinds")
    of_one = signed.select("doc_id", "n_shingles", "set_hash").join(kinds, "doc_id").distinct()
    joined = split_join(of_one.where("n_shingles > 0"), sets, ["set_hash"], "copies", signed.count()).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    empty = of_one.where("n_shingles = 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    nodes = signed.withColumnRenamed("doc_id", "rep").join(sets, ["set_hash", "rep"]).dropDuplicates(["set_hash", "rep"])
    nodes = written(nodes.select(F.col("rep").alias("node"), "n_shingles", "sig", "bands"), "nodes")
    total = 32 * nodes.count()
    members = nodes.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").cast("int").alias("n_shingles"))
    buckets = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("m")).where("m > 1")
    hits = written(split_join(members, written(buckets, "buckets"), ["key"], "m", total), "hits")
    star = hits.where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(written(star, "star"), texts, percent).unionByName(joined)
    first = components(written(links, "links"))

    rest = written(_crowded(hits, first, nodes, total), "rest")
    dealt = rest.repartitionByRange(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")  # blocks side by side, not by chance together
    alike = written(dealt.mapInArrow(lean("near_dedup", _survivors), rest.schema), "alike")
    # Each node's text is joined once; dealing by range reads its rows twice.
    places = F.collect_list(F.struct("key", "i", "j", "side")).alias("places")
    found = alike.groupBy("node", "comp", "sig", "bands").agg(places)
    sent = found.join(texts_of(texts, alike.select(F.col("node").alias("doc"))).withColumnRenamed("doc", "node"), "node").withColumn("at", F.explode("places"))
    sent = sent.select("at.key", "at.i", "at.j", "at.side", "node", "comp", "sig", "bands", "text")
    late = sent.repartitionByRange(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(lean("near_dedup", _within(percent)), "a long, b long")
    second = components(written(late, "links")).select(F.col("comp").alias("final"), F.col("node").alias("comp"))

    reached = sets.unionByName(empty).join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    reached = reached.join(second, "comp", "left").select("set_hash", F.coalesce("final", "comp").alias("component_id"), "copies")
    rows = signed.select("doc_id", "n_shingles", "set_hash")
    out = split_join(rows.where("doc_id is not null"), reached, ["set_hash"], "copies", signed.count(), "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
