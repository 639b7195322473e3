"""Pattern packing by non-negative least squares.

Documents become token ids (the tokenizer's, then id 1); only those longer than the capacity are
cut. The driver sees no document, only the histogram of piece lengths, of at most ``capacity``
entries. It enumerates patterns of few lengths that fill a sequence, fits their repeat counts to the
histogram by non-negative least squares until no count moves, and rounds them; what that leaves goes
through the same again, and a last residual is packed best-fit, largest first. The plan is a list of
runs (length, ranks, sequences, offset), whose number follows from the capacity and not from the
input; each piece finds its place by its rank among the pieces of its length.

A length may hold any share of the rows: ranks are taken within (length, salt) and shifted by the
counts of the salts before.

Defined cases: null text counts as empty (one piece holding id 1); repeated rows and null doc_ids are
packed like others; equal lengths are ranked by doc_id and piece; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import claim, written
from .tokens import _loaded, encoded, tokenizer, words

SALTS, EACH = 64, 6
ROUNDS, PRICE = 12, 2.0  # fits, at most; of a sequence left empty, in mean counts of a length
CACHED = 250_000  # words whose ids a worker keeps
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEADING = MARKS.replace("'", "")
# The rules of a tokenizer file by which words can be encoded apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
END = np.array([1], "<u4").tobytes()
_ids: dict[str, Words] = {}
_known: dict[str, Lean] = {}


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100: these lower one for one, as the tokenizer lowers them, and compose with none of each other."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _words(text: str | None) -> list[str]:
    """Runs without white space, Latin texts in lower case. str.split() also splits at U+001C to U+001F, which the tokenizers keep."""
    if not text:
        return []
    if _latin(text) and "<|" not in text:  # special strings are met before letters are lowered
        text = text.lower()
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return words(text)
    return text.split()


class Lean:
    """What is known of a tokenizer file: whether words can be encoded apart (``apart``: it lowers letters, drops white
    space, parts letters from marks and ends words with ``</w>``), which ids end a word, and a tokenizer without the
    steps that change nothing in lower-case Latin letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.apart = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["model"].get("end_of_word_suffix") == "</w>"
        if self.apart:
            vocabulary = rules["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1024, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.normalizer = normalizers.Sequence([])
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])


def _lean(path: str) -> Lean:
    tokenizer(path)
    if path not in _known:
        _known[path] = Lean(path)
    return _known[path]


def _encode_letters(path: str, some: list[str]) -> dict[str, bytes]:
    """The ids of words of letters as bytes. They go to the library many at once: each is one pre-token, so the
    ids that end a word part them. Where the ends don't number as many as the words, each is encoded by itself."""
    lean, out = _lean(path), {}
    for at in range(0, len(some), 1000):
        part = some[at : at + 1000]
        joined = " ".join(part)
        t = lean.tokenizer if joined.islower() and _latin(joined) else tokenizer(path)
        a = np.array(t.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(lean.ends[a]) + 1).tolist()
        if len(stops) == len(part) and stops[-1] == len(a):
            data, starts = a.tobytes(), [0, *stops[:-1]]
            out.update(zip(part, [data[4 * i : 4 * j] for i, j in zip(starts, stops, strict=True)], strict=True))
        else:
            out |= _encode_others(path, part)
    return out


def _encode_others(path: str, some: list[str]) -> dict[str, bytes]:
    return {w: np.array(ids, "<u4").tobytes() for w, ids in zip(some, encoded(path, some), strict=True)}


def _parts(word: str) -> tuple[str, str, str]:
    """Marks, letters, marks, where a word with marks is that; else the word, whole. The tokenizer parts ASCII marks
    from letters, but for those after an apostrophe."""
    head = word.rstrip(MARKS)
    core = head if head.isalpha() else head.lstrip(LEADING)
    if not core.isalpha() or "<|" in word:
        return "", word, ""
    return head[: len(head) - len(core)], core, word[len(head) :]


class Words:
    """A worker's ids of words. Words that come again within a while stay; the others go when it is full."""

    def __init__(self, path: str):
        self.path = path
        self.ids: dict[str, bytes] = {}
        self.once: set[str] = set()  # those met in one batch only

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        self.once -= words
        if len(self.ids) + len(new) > CACHED:
            for w in self.once:
                del self.ids[w]
            self.once.clear()
            if len(self.ids) > 0.8 * CACHED:
                self.ids.clear()
            new = words.difference(self.ids)
        letters = [w for w in new if w.isalpha()]
        marked = [(w, _parts(w)) for w in new.difference(letters)]
        self.ids.update(_encode_letters(self.path, letters))
        need = list(set().union(*(p for _, p in marked)).difference(self.ids, [""]))
        cores = [w for w in need if w.isalpha()]
        own = _encode_letters(self.path, cores) | _encode_others(self.path, list(set(need).difference(cores)))
        find = lambda x: own[x] if x in own else self.ids[x]
        for w, (lead, core, tail) in marked:
            ids = find(core) + find(tail) if tail else find(core)
            self.ids[w] = find(lead) + ids if lead else ids
        self.once |= new


def _forget() -> None:
    for cache in (_ids, _known, _loaded):
        cache.clear()


def token_bytes(path: str, texts: list[str | None]) -> list[bytes]:
    """Each text's ids and the id 1, as little-endian unsigned 32-bit numbers; equals encoding the whole text."""
    if not _lean(path).apart:
        return [np.array([*ids, 1], "<u4").tobytes() for ids in encoded(path, [t or "" for t in texts])]
    cache = _ids.setdefault(path, Words(path))
    split = [_words(t) for t in texts]
    cache.learn(set().union(*split))
    return [b"".join([*map(cache.ids.__getitem__, ws), END]) for ws in split]


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _forget)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), token_bytes(path, batch.column(1).to_pylist()), strict=True):
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _patterns(rest: dict[int, int], capacity: int, seed: int) -> list[tuple[int, ...]]:
    """Fillings of few lengths, EACH or more begun from every length: the others are drawn as the histogram has
    them while the space is wide, and one or two lengths that are there fill what is left as well as they can.
    Those that are full or almost are kept, and the fullest of a length that has few of them."""
    lengths = np.array(sorted(rest), np.int64)
    share = np.cumsum([rest[x] for x in lengths.tolist()]).astype(np.float64)
    near = max(1, capacity // 1024)  # waste that still counts as full
    wide = int(lengths[np.searchsorted(share, 0.6 * share[-1])])
    there = np.zeros(capacity + 1, np.int64)  # the largest length up to a space, 0 if none
    there[lengths] = lengths
    there = np.maximum.accumulate(there)
    draws, each = np.random.default_rng(seed), max(EACH, 200 * EACH // len(lengths))
    found = set()
    for x in lengths.tolist():
        own = {}
        for turn in range(each + 1):
            pattern, space = [x], capacity - x
            while there[space] and (space > wide or not turn):
                i = np.searchsorted(lengths, space, "right")
                y = int(lengths[np.searchsorted(share, draws.random() * share[i - 1], "right")]) if turn else int(there[space])
                pattern.append(y)
                space -= y
            last = int(there[space])
            if space - last > near and last:  # two lengths that fill it better
                some = lengths[: np.searchsorted(lengths, space, "right")]
                left = space - some - there[space - some]
                best = np.flatnonzero(left == left.min())
                first = int(some[best[int(draws.integers(len(best)))]])
                pattern.append(first)
                last = int(there[space - first])
            if last:
                pattern.append(last)
            p = tuple(sorted(pattern, reverse=True))
            if all(p.count(y) <= rest[y] for y in set(p)):
                own[p] = capacity - sum(p)
        full = [p for p, waste in own.items() if waste <= near]
        found.update(full if len(full) >= EACH else sorted(own, key=own.get)[: 2 * EACH])
    return sorted(found)


def _least_squares(patterns: list[tuple[int, ...]], rest: dict[int, int], capacity: int, rounds: int = 3000) -> np.ndarray:
    """Non-negative repeat counts whose sums come nearest to the histogram (squares weighted by length), at a small price for space left empty:
    accelerated projected gradient steps, begun anew when they overshoot, until no count can move by more than a
    thousandth of the mean count of a length."""
    index = {x: i for i, x in enumerate(sorted(rest))}
    goal = np.array([rest[x] for x in sorted(rest)], np.float64)
    weight = np.array(sorted(rest)) / max(rest)
    sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
    row = np.array([index[x] for p in patterns for x in p], np.int64)
    first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(patterns)), sizes)
    put = lambda c: np.bincount(row, c[owner], len(goal))
    take = lambda r: np.add.reduceat((weight * r)[row], first)
    v = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue
        v = take(put(v))
        top = float(np.linalg.norm(v))
        v /= top
    price = PRICE * goal.mean() * (1 - np.array([sum(p) for p in patterns]) / capacity)
    counts = np.zeros(len(patterns))
    ahead, t, enough = counts, 1.0, 1e-3 * goal.mean()
    for k in range(rounds):
        slope = take(put(ahead) - goal) + price
        new = np.maximum(0.0, ahead - slope / (1.02 * top))
        if ((ahead - new) * (new - counts)).sum() > 0:
            t = 1.0
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step = new - counts
        ahead, t, counts = new + (t - 1) / nxt * step, nxt, new
        if k % 20 == 19:
            slope = take(put(counts) - goal) + price
            if np.abs(np.minimum(counts, slope)).max() < enough:
                break
    return counts


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, on counts: each step repeats one filling until a length of it is used up."""
    rest, out = dict(rest), []
    left = sorted(x for x, n in rest.items() if n)
    while left:
        used: dict[int, int] = {}
        pattern, space = [], capacity
        while (i := bisect_right(left, space)) and space:
            x = next((left[k] for k in range(i - 1, -1, -1) if rest[left[k]] > used.get(left[k], 0)), 0)
            if not x:
                break
            pattern.append(x)
            used[x] = used.get(x, 0) + 1
            space -= x
        n = min(rest[x] // m for x, m in used.items())
        out.append((tuple(pattern), n))
        for x, m in used.items():
            rest[x] -= n * m
            if not rest[x]:
                left.remove(x)
    return out


def fitted(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(pattern, repeats) by non-negative least squares, and what they leave of the histogram.

    Each round enumerates patterns over what is left, fits and rounds their repeat counts, the best fitted
    first and none beyond what is there; rounds end when they place little."""
    rest = {x: n for x, n in histogram.items() if n > 0}
    out = []
    if full := rest.pop(capacity, 0):
        out.append(((capacity,), full))
    for k in range(ROUNDS):
        before = sum(rest.values())
        patterns = _patterns(rest, capacity, k) if rest else []
        if not patterns:
            break
        counts = _least_squares(patterns, rest, capacity)
        for i in np.argsort(-counts, kind="stable").tolist():
            if counts[i] < 1e-3:
                break
            p = patterns[i]
            n = min(max(1, int(counts[i])), *(rest[x] // p.count(x) for x in p))
            if n > 0:
                out.append((p, n))
                for x in p:
                    rest[x] -= n
        rest = {x: n for x, n in rest.items() if n}
        if sum(rest.values()) > 0.9 * before:
            break
    return out, rest


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that place every piece of the histogram, none over ``capacity``: the fitted patterns, then best fit for the residual."""
    chosen, rest = fitted(histogram, capacity)
    return chosen + _best_fit(rest, capacity)


def _runs(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length and rank: keys (length << 44 | first rank), first sequence, offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in chosen:
        offset = 0
        for x in pattern:
            first = ranks.get(x, 0)
            rows.append((x << 44 | first, sequence, offset))
            ranks[x] = first + n
            offset += x
        sequence += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy()


def _place(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = runs.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = (batch.column("length").to_numpy() << 44) | batch.column("rank").to_numpy()
            i = np.searchsorted(keys, at, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[i] + at - keys[i]), pa.array(offsets[i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_cut(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(_runs(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rn", F.row_number().over(within)).join(shifts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("rn") - 1).alias("rank"))
    return ranked.mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
