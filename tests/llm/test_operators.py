"""Each operator on small fixtures: defined cases and brute force."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import public_tokenizers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def text(start, n, skip=()):
    return " ".join(w for i, w in enumerate(WORDS[start : start + n]) if i not in skip)


HARD = [(1, None), (2, ""), (3, " \t\n "), (4, "Aa \x1c b c <|endoftext|>x  y\n\n z's 𝒳é ﬁ ½"), (5, "word " * 30_000), (6, "one two"), (6, "one two"), (7, "one two"), (None, "no id here")]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, repeated rows, ties and clashing extra columns."""
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in HARD], DOCS)
    extra = {c: F.lit("x") for c in ("rep", "node", "h", "key", "label", "score", "piece", "length", "salt", "id", "block", "_bit", "_word", "row", "n", "pretoken", "level")}
    return rows.withColumns(extra)


@pytest.fixture(scope="module")
def empty(hard):
    return hard.where("false")


def test_token_counts(spark, hard, empty):
    from tokenizers import Tokenizer

    from certveil.llm.tokens import count_tokens

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    want = sorted(((i or -1), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in HARD)
    got = count_tokens(hard, path, 1024).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.doc_id for r in got if r.over_limit} == {5}
    assert count_tokens(empty, path, 1024).count() == 0


def test_packing(spark, hard, empty):
    from tokenizers import Tokenizer

    from certveil.llm.packing import fitted, pack, plan

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    got = pack(hard, path, 4096).collect()
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in HARD}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in HARD)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(empty, path, 4096).count() == 0
    rng = np.random.default_rng(1)
    for _ in range(5):
        h = {int(x): int(n) for x, n in zip(rng.integers(1, 100, 40), rng.integers(1, 500, 40), strict=True)}
        chosen = plan(h, 100)
        used = {}
        for p, n in chosen:
            assert sum(p) <= 100
            for x in p:
                used[x] = used.get(x, 0) + n
        assert used == h
        assert sum(n for _, n in chosen) <= 1.02 * best_fit_decreasing(h, 100) + 2
    base = {}
    for x in np.minimum(4096, rng.lognormal(6.3, 1, 3000)).astype(int).tolist():
        base[max(1, x)] = base.get(max(1, x), 0) + 1
    for times in (1, 20, 1000):  # patterns carry most pieces at every size, with next to no waste
        h = {x: n * times for x, n in base.items()}
        least = -(-sum(x * n for x, n in h.items()) // 4096)
        assert sum(n for _, n in plan(h, 4096)) <= least + max(1, least // 1000)
        assert sum(fitted(h, 4096)[1].values()) < 0.05 * sum(h.values())
    assert plan({}, 4096) == [] and plan({4096: 3}, 4096) == [((4096,), 3)] and sum(n for _, n in plan({3000: 5, 2000: 1}, 4096)) == 6
    assert sum(n for _, n in plan({3: 100_000}, 4096)) == 74


def test_packing_encodes_as_the_library():
    from tokenizers import Tokenizer

    from certveil.llm.packing import token_bytes

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    texts = ["it's they've x's 's 'sword a'd", "don't, (I'll) \"we've\"", "İstanbul ΣΑΣ ΣΑΣ. ½ x² ①a áb é. Å ﬁ ﬀ, ǅ ᾳ", "<|endoftext|> x<|endoftext|>y <|startoftext|>, (<|endoftext|>)", "<|ENDOFTEXT|> A<|EndOfText|>", "Ünïcödé ÀÉÎ ÿ µ ß, Ñandú.", "a_b __init__ _bar 12ab ab12. 3.14 $5,000.00! #tag,%%% ...", "ก็ กำ 한글 ᄀ ᅡ 日本語、中国 ｡ｱ", "á é, ñ. ́ x́y", "'' ' 's' 'S THEY'RE, o'clock"]
    assert token_bytes(path, texts) == [np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes() for x in texts]


def best_fit_decreasing(histogram, capacity):
    open_bins = [0] * (capacity + 1)  # by space left
    used = 0
    for x in sorted(histogram, reverse=True):
        for _ in range(histogram[x]):
            space = next((s for s in range(x, capacity + 1) if open_bins[s]), None)
            if space is None:
                used, space = used + 1, capacity
            else:
                open_bins[space] -= 1
            open_bins[space - x] += 1
    return used


def brute_components(rows, percent=75):
    from certveil.llm.near_dedup import shingle_hashes

    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(set(shingle_hashes(t).tolist()))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, hard, empty):
    from certveil.llm.near_dedup import near_duplicates, shingle_hashes

    rng = np.random.default_rng(3)
    rows = [(100 + k, text(0, 100)) for k in range(4)] + [(200 + k, text(100, 100 - k)) for k in range(0, 60, 3)]
    rows += [(400 + k, text(200, 80, skip=set(rng.integers(0, 80, 2).tolist()))) for k in range(40)] + [(600, "A b c"), (601, "a B C"), (602, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingle_hashes(dict(rows)[r.doc_id])) for r in got)
    out = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(hard).collect())
    assert [x for x in out if x[0] in (6, 7)] == [(6, 1, 6, True), (6, 1, 6, True), (7, 1, 6, False)]
    assert [x for x in out if x[0] in (1, 2, 3)] == [(i, 0, i, True) for i in (1, 2, 3)]
    assert out[0] == (-1, 1, -1, True)
    assert near_duplicates(empty).count() == 0


def test_blocks_find_links_that_the_leader_misses(spark):
    from certveil.llm.near_dedup import near_duplicates

    rows = [(k, text(4 * k, 120)) for k in range(12)]  # a chain: neighbours alike, ends not
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_texts_of_one_id_are_one_document(spark):
    from certveil.llm.near_dedup import near_duplicates

    a, b, c, d = (text(80 * k, 60) for k in range(4))
    rows = [(1, a), (5, a), (5, b), (9, b), (20, c), (20, d), (20, ""), (21, d), (22, ""), (23, None), (30, c), (40, d + " more"), (None, a), (50, "x y"), (50, "x y")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components([r for r in rows if r[0] is not None])
    assert want[9] == 1 and want[40] == want[30] == 20
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted((i, want[i], i == want[i]) for i, _ in rows if i is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_recall_and_crowded_buckets(spark, monkeypatch):
    """Families of texts about as alike as the limit, and one family that shares its bands but falls into several components."""
    from certveil.llm import near_dedup as N

    monkeypatch.setattr(N, "BLOCK", 8)
    rng = np.random.default_rng(17)
    rows, at = [], 0
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(160)]
        for _ in range(25):
            ws = list(base)
            for k in rng.integers(0, 160, int(rng.integers(1, 7))):
                ws[k] = f"u{at}x{k}"
            at += 1
            rows.append((at, " ".join(ws)))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert len(set(want.values())) > 12 and np.mean([got[i] == want[i] for i in want]) > 0.99
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert np.mean([got[a] == got[b] for a, b in pairs]) > 0.99
    assert all(want[a] == want[b] for a in got for b in got if a < b and got[a] == got[b])


def test_rows_of_a_bucket_grow_with_its_nodes(spark, monkeypatch):
    """One group of near copies of which a fifth share bands with the rest without a link; then the same in many left blocks."""
    from certveil.llm import near_dedup as N

    rng = np.random.default_rng(5)
    rows = []
    for d in range(200):
        ws = [f"w{i}" for i in range(150)]
        for k in rng.integers(0, 150, int(rng.integers(6, 9)) if d % 5 == 4 else int(rng.integers(0, 2))):
            ws[k] = f"u{d}x{k}"
        rows.append((d, " ".join(ws)))
    docs, want, seen = spark.createDataFrame(rows, "doc_id long, text string"), brute_components(rows), {}
    write = N.written
    monkeypatch.setattr(N, "written", lambda df, name: seen.setdefault(name, write(df, name)) if name == "rest" else write(df, name))
    monkeypatch.setattr(N, "BLOCK", 2)
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()} == want
    rest = seen.pop("rest")
    members = rest.select("key", "node").distinct().count()
    assert members > 500 and rest.select("j").distinct().count() > 2
    assert rest.count() <= 6 * members
    monkeypatch.setattr(N, "BYTES", 8000)
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()} == want
    assert seen["rest"].select("i").distinct().count() > 2


def test_freed_memory_goes_back():
    """What a task freed isn't kept by Arrow's pool; caches of other operators go when it begins."""
    import pyarrow as pa

    from certveil.llm import shared

    held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith(("Pss_Anon:", "Pss_Shmem:"))) / 1024
    kept, most = ["other"], []

    def run(batches):
        for n in batches:
            some = [pa.array(np.ones(n, np.int64)).cast(pa.float64()) for _ in range(4000)]
            most.append(held())
            del some
            yield n

    shared.claim("another", kept.clear)
    before = held()
    assert list(shared.lean("near_dedup", run)(iter([4000, 4001]))) == [4000, 4001] and not kept
    assert max(most) > before + 100 and held() < before + 60


def test_min_max_signature_is_unbiased():
    from certveil.llm.near_dedup import shingle_hashes, signature

    a, b = shingle_hashes(text(0, 300)), shingle_hashes(text(60, 300))
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((signature(a) == signature(b)).mean() - j) < 0.13


def test_components(spark):
    from certveil.llm.components import components

    path = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_winnowing_guarantee_and_ties():
    from certveil.llm.fingerprints import K, WINDOW, _hashes, _points, likeness, winnow

    rng = np.random.default_rng(5)
    for n in (1, 5, 16, 40, 79, 80, 400):
        t = "".join(rng.choice(list("ab"), n))
        at, h = winnow(t)
        low = _hashes(_points(t), K) >> np.uint64(31)
        w = min(WINDOW, len(low))
        want = sorted({max(p for p in range(s, s + w) if low[p] == low[s : s + w].min()) for s in range(len(low) - w + 1)})
        assert at.tolist() == want and h.tolist() == low[want].tolist()
    shared = text(0, 40)
    a, b = winnow("alpha beta " + shared + " gamma"), winnow(text(200, 30) + shared)
    assert set(a[1].tolist()) & set(b[1].tolist())
    assert likeness(a[1], a[1]) == 1 and likeness(a[1], a[1][:0]) == 0 and likeness(a[1][:0], a[1][:0]) == 1


def test_half_of_a_short_text_keeps_an_entry():
    from certveil.llm.fingerprints import edited, likeness, winnow

    rng = np.random.default_rng(6)
    for n in range(46, 160):
        a, b = ("".join(rng.choice(list("abcdefghij "), n)) for _ in range(2))
        assert likeness(winnow(a)[1], winnow(edited(a, b))[1]) > 0


def test_fingerprints_with_next(spark, hard, empty):
    from certveil.llm.fingerprints import compare_with_next, edited

    order = sorted(((i if i is not None else -(2**63), x or "") for i, x in HARD), key=lambda r: (-r[0], r[1]))
    want = sorted((t, hashlib.sha256(edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (_, t) in enumerate(order))
    got = compare_with_next(hard).collect()
    by_text = sorted(r.edited_sha256 for r in got)
    assert by_text == sorted(s for _, s in want) and len(got) == len(HARD)
    assert compare_with_next(empty).count() == 0
    one = compare_with_next(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()


def test_language(spark, hard, empty):
    from certveil.llm import language_id as L

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = L.fit(docs.where(~L.held_out()))
    got = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = {r.doc_id: r for r in L.identify(hard, model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[1].score == 0 and odd[1].rejected
    assert L.identify(empty, model).count() == 0
    assert {r.lang_pred for r in L.identify(hard, L.fit(empty)).collect()} == {"und"}
    assert L.drop_rejected(docs, model).count() > 0.98 * docs.count()
    rng = np.random.default_rng(4)
    junk = [(k, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10)))) for _ in range(n))) for k, n in enumerate([20, 50, 200, 2000] * 8)]
    assert all(r.rejected for r in L.identify(spark.createDataFrame(junk, "doc_id long, text string"), model).collect())
    many = docs.where(~L.held_out()).limit(20).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50))))
    assert L.fit(many).texts <= 20 and L.fit(docs, sample=3).texts == 12


def test_language_against_brute_force(spark):
    """Scores of single texts by dictionaries and loops."""
    import math

    from certveil.llm import language_id as L

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = L.fit(docs.where(~L.held_out()))
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["Ça va? Ünïcode", "x", "12 a 3", "…"]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    m1, m2, m3, m = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 2**32
    for k, t in enumerate(texts):
        points = [0]
        for ch in t:
            c = (ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch)) if ch.isalpha() else 0
            if c or points[-1]:
                points.append(c)
        if points[-1]:
            points.append(0)
        grams = {}
        for i, c in enumerate(points):
            if c:
                grams.setdefault(c * m1 % m >> 20, []).append(1)
            if i + 1 < len(points):
                two = ((c * m1 ^ points[i + 1] * m2) % m) * m3 % m
                grams.setdefault(two >> 20, []).append(1)
                if i + 2 < len(points):
                    grams.setdefault(((two ^ points[i + 2] * m2) % m) * m1 % m >> 20, []).append(1)
        if not any(points):
            assert got[k].lang_pred == "und" and got[k].score == 0
            continue
        v = {g: math.sqrt(len(n)) * float(model.idf[g]) for g, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        best = {}
        for row, owner in zip(model.centroids, model.owner, strict=True):
            g = model.languages[owner]
            best[g] = max(best.get(g, -1), sum(x * float(row[i]) for i, x in v.items()) / norm)
        lang = max(best, key=best.get)
        assert got[k].lang_pred == lang and abs(got[k].cosine - best[lang]) < 1e-4
        assert abs(got[k].score - 1 / sum(math.exp(L.SHARPNESS * (b - best[lang])) for b in best.values())) < 1e-3


def test_toxicity(spark, hard, empty):
    from certveil.llm import toxicity as X

    base = SMALL.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    net = X.fit(docs, labels.where(~X.held_out()))
    judged = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(X.held_out()).repartition(4)
    got = X.score(judged, net).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    ones, zeros = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert len(ones) > 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9
    mild, rude = X.score(spark.createDataFrame([(1, text(0, 200)), (2, "you idiot clown of a scum " * 40)], "doc_id long, text string"), net).orderBy("doc_id").collect()
    assert mild.score < rude.score
    assert X.score(hard, net).count() == len(HARD) and X.score(empty, net).count() == 0
    assert X.drop_toxic(hard, net).columns == hard.columns
    none = X.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in X.score(hard, none).collect()} == {0.0}
    # Single texts by loops over windows, steps and words.
    texts = [r.text for r in docs.orderBy("doc_id").limit(12).collect()] + ["", "Idiot!", None, "a b c " * 11]
    assert np.abs(net.scores(texts) - [plain_toxicity(net, t) for t in texts]).max() < 1e-4


def plain_toxicity(net, t):
    import math
    import re

    import xxhash

    from certveil.llm import toxicity as X

    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    ws = re.findall(r"\w+", (t or "").lower())
    p, h = {k: v.astype(float) for k, v in net.p.items()}, X.HIDDEN

    def vector(w):
        b, grams = f"<{w}>", []
        for i in range(len(w)):
            c = (ord(b[i]) * 0x9E3779B1 ^ ord(b[i + 1]) * 0x85EBCA77 ^ ord(b[i + 2]) * 0xC2B2AE3D) % 2**32
            grams.append(((c ^ c >> 15) * 0x27D4EB2F % 2**32 >> 20) % X.GRAMS)
        mean = np.mean([net.gram[g] for g in grams], axis=0) if grams else np.zeros(X.EMBED)
        return np.concatenate((net.word[xxhash.xxh32_intdigest(w) % X.WORDS], mean, [net.odds.get(w, 0.0), 1.0])).astype(float)

    def states(xs, side):
        state, out = np.zeros(h), []
        for x in xs:
            a, g = x @ p[f"W{side}"] + p[f"b{side}"], state @ p[f"U{side}"]
            new = np.zeros(h)
            for i in range(h):
                z, r = sigmoid(a[i] + g[i]), sigmoid(a[h + i] + g[h + i])
                new[i] = (1 - z) * math.tanh(a[2 * h + i] + r * g[2 * h + i]) + z * state[i]
            state = new
            out.append(state)
        return out

    starts = [0] if len(ws) <= X.WINDOW else sorted({*range(0, len(ws) - X.WINDOW + 1, X.STRIDE), len(ws) - X.WINDOW})
    logits = []
    for s in starts:
        if not ws:  # no step: nothing is pooled
            logits.append(float(p["bo"][0]))
            continue
        xs = [vector(w) for w in ws[s : s + X.WINDOW]]
        both = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        e = np.array([x @ p["va"] for x in both])
        e = np.exp(e - e.max())
        logits.append(float(sum(w * x for w, x in zip(e / e.sum(), both, strict=True)) @ p["wo"] + p["bo"][0]))
    return sigmoid(net.scale * max(logits) + net.shift)


def test_toxicity_gradients():
    from certveil.llm.toxicity import Network

    net, r = Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = r.standard_normal((5, 3, 14)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(net.projected(x.reshape(-1, 14)).reshape(5, 3, -1), mask)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    keep = {}
    z = net.forward(net.projected(x.reshape(-1, 14)).reshape(5, 3, -1), mask, keep)
    g, _ = net.gradients(x, mask, keep, (1 / (1 + np.exp(-z)) - y) / 3)
    for k in ("Uf", "Wb", "bf", "va", "wo"):
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-4
        up = loss()
        net.p[k][at] -= 2e-4
        down = loss()
        net.p[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3


def test_warc_round_trip(spark, tmp_path):
    from certveil.llm import warc as W

    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u\r\nX: y", None), (4, "u", ""), (7, "u", "é𝒳" * 200_000), (8, "u", "x\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (9, "u", "dup"), (9, "u", "dup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("sha", F.lit(2))
    archive = W.write_archive(pages)
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_archive(archive).collect())
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in rows:
        top = max((p for p, _, x in rows if (x or "") == (t or "") and p is not None), default=None)
        want.append((i or -1, len((t or "").encode()), b32(t), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert max(r.n for r in archive.select(F.octet_length("data").alias("n")).collect()) <= W.CHUNK + 4096
    parts = W.read_payloads(archive).orderBy("record", "chunk").collect()
    whole = {}
    for p in parts:
        whole[p.record] = whole.get(p.record, b"") + bytes(p.part)
    assert ("é𝒳" * 200_000).encode() + W.END in whole.values()
    W.export_file(archive.orderBy("record", "chunk").toLocalIterator(), str(tmp_path / "a.warc"))
    assert (tmp_path / "a.warc").read_bytes().startswith(b"WARC/1.1\r\n")
    assert W.read_archive(W.write_archive(pages.where("false"))).count() == 0
    small = {r.page_id: r.record_type for r in W.read_archive(W.write_archive(pages, least=5)).collect()}
    assert small[1] == small[5] == "response"


def test_html(spark):
    from certveil.llm.html_text import extract, main_text

    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Home</a></header>
    <nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies, all of them, always.</div>
    <main><article><h1>Head &amp; line</h1><p>First  paragraph, with <b>bold</b>\n text, that goes on for a while.<p>Second one&nbsp;here, not closed
    <script>var x = "<p>no</p>";</script><blockquote>Said so.</blockquote><div class="ad">Buy, buy, buy this thing right now, please.</div></article>
    <section id="comments"><p>I disagree, strongly, with every word of this text.</p></section></main>
    <form><p>Your name, please, and your address too.</p></form><footer>(c)</footer></body></html>"""
    assert main_text(page) == "Head & line\nFirst paragraph, with bold text, that goes on for a while.\nSecond one here, not closed\nSaid so."
    assert [main_text(x) for x in (None, "", "<p>", "<!-- open", "<script>x", "plain")] == ["", "", "", "", "", "plain"]
    assert main_text("<div><p>" + "a" * 300_000 + "</p></div>") == "a" * 300_000
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y"))
    assert sorted((r.page_id or 0, r.n_chars) for r in extract(rows).collect()) == [(0, 0), (1, len(main_text(page))), (1, len(main_text(page)))]
    assert extract(rows.where("false")).count() == 0


def test_html_keeps_what_belongs_to_the_article():
    from certveil.llm.html_text import main_text

    prose = "This is a sentence, long enough to count, of the article that we want."
    for part, want in [
        ("<p>Euler: <math><mi>e</mi><mo>=</mo><mn>0</mn><annotation>e=0</annotation></math> holds.</p>", "Euler: e=0 holds."),
        ("<ul><li><a href=1>First source</a><li><a href=2>Second source</a><li><a href=3>Third source</a></ul>", "First source\nSecond source\nThird source"),
        ('<p class="reply">The ministry sent this reply, in part.</p>', "The ministry sent this reply, in part."),
        ('<section class="related-work"><p>Others did this before.</p></section>', "Others did this before."),
        ('<div class="share-price"><p>It rose by 3 %.</p></div>', "It rose by 3 %."),
        ('<div id="market-share">A third.</div>', "A third."),
    ]:
        assert main_text(f"<html><body><article><p>{prose}</p>{part}<p>{prose}</p></article></body></html>") == f"{prose}\n{want}\n{prose}"
    for part in ('<div class="related-posts"><p>Read this too, please, now.</p></div>', '<div class="share-buttons">Share</div>', '<li class="comment"><p>I disagree, strongly, with all.</p></li>', '<div class="reply">Me too</div>', '<p class="ad">Buy</p>', '<div class="site-footer">(c)</div>', '<div class="post-share">Share it</div>'):
        assert main_text(f"<html><body><article><p>{prose}</p>{part}<p>{prose}</p></article></body></html>") == f"{prose}\n{prose}"
    menu = "<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>"
    assert main_text(f"<body>{menu}<p>{prose}</p>{menu}<p>{prose}</p>{menu}</body>") == f"{prose}\nOne\nTwo\nThree\n{prose}"


def test_html_is_linear_in_depth_and_quotes():
    import time

    from certveil.llm.html_text import main_text

    def seconds(page):
        at = time.process_time()
        main_text(page)
        return time.process_time() - at

    deep = lambda n: "<div>" * n + "word and word, again. " * 3 + "</div>" * n
    stray = lambda n: "<p title=\">text</p>" * n + "'"
    wrong = lambda n: "<div><p>some text</section>" * n
    many = lambda n: "<div>" * (n // 10) + "<p>a line of text, with words.</p>" * n
    for page in (deep, stray, wrong, many):
        assert seconds(page(20_000)) < 8 * seconds(page(5_000)) + 0.5


def test_html_against_pages_of_known_content():
    """Random pages are built from article blocks and furniture; the extracted text is the article's blocks."""
    import html as H

    from certveil.llm.html_text import main_text

    rng = np.random.default_rng(9)
    some = lambda lo, hi: " ".join(rng.choice(WORDS, int(rng.integers(lo, hi)))) + rng.choice([".", ", and so on.", " & more <now>."])
    for _ in range(200):
        truth, body = [], []
        for _ in range(int(rng.integers(3, 12))):
            t = some(8, 60)
            tag = str(rng.choice(["p", "p", "p", "blockquote", "h2", "li", "pre"]))
            truth.append(" ".join(t.split()))
            inner = H.escape(t).replace(" w1", " <b>w1</b>").replace(" w2", "\n w2")
            body.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
            if rng.random() < 0.3:
                body.append(str(rng.choice(['<div class="ad">Buy, buy, buy this right now, please do.</div>', "<script>var a = '<p>x</p>';</script>", "<aside><p>By the way, some other thing here.</p></aside>", '<form><p>Your mail address, please, here.</p></form>', "<!-- <p>gone</p> -->"])))
        article = rng.choice(["article", "main", "div"])
        links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(6))
        page = f"<html><head><title>T</title></head><body><nav><ul>{links}</ul></nav><div class=header>Name of the site</div><{article}>{''.join(body)}</{article}><div id='comments'><p>No, no, no, I think not, says a reader.</p></div><ul>{links}</ul><footer>Imprint, terms, and so on, and so on.</footer></body></html>"
        assert main_text(page) == "\n".join(truth)


def test_quotation(spark):
    from certveil.llm.quotation import link

    rows = [
        (1, 0, "a", "Hello there my friend.\n\nSecond paragraph is here."), (1, 1, "b", "On Monday a wrote:\n> Hello there my  friend.\n>\n> Second paragraph is here.\nI agree with that"),
        (1, 2, "a", "> I agree with that\nfine then, thank you"), (2, 0, "c", "> Second paragraph\n> is here.\nyes"), (1, 3, "b", ">> never said anywhere\nok"), (1, 3, "b", ">> never said anywhere\nok"),
        (None, 1, "x", None), (3, 0, "y", ""), (4, 0, "z", "long " * 50_000),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(1) for x in ("own", "level", "key", "unit", "row", "position", "n")})
    got = sorted(((r.conv_id or 0, r.turn, r.text[:30], r.n_linked, r.parent_conv, r.parent_turn, r.thread_conv, r.thread_turn, r.depth) for r in link(m).collect()), key=repr)
    by = {(x[0], x[1]): x for x in got}
    assert len(got) == len(rows)
    assert by[(1, 1)][2:] == ("I agree with that", 1, 1, 0, 1, 0, 1) and by[(1, 2)][2:] == ("fine then, thank you", 1, 1, 1, 1, 0, 2)
    assert by[(2, 0)][3:] == (1, 1, 0, 1, 0, 1) and by[(1, 3)][2:] == ("ok", 0, None, None, 1, 0, 0) and by[(0, 1)][2] == ""
    assert link(m.where("false")).count() == 0


def brute_links(rows):
    """The rules of the quotation module, message by message."""
    import re

    normal = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    intro = re.compile(r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$")
    parsed = []
    for c, t, role, text in rows:
        lines = []
        for x in re.split(r"\r\n|\r|\n", text or ""):
            p = re.match(r"^[ \t]*(?:>[ \t]?)+", x)
            lines.append((p[0].count(">"), x[p.end() :]) if p else (0, x))
        own = [b for i, (v, b) in enumerate(lines) if v == 0 and not (intro.match(b) and i + 1 < len(lines) and lines[i + 1][0] > 0)]
        parsed.append((c, t, role, "\n".join(own).strip() if any(v for v, _ in lines) else text or "", lines))
    saying = {}
    for c, t, _, own, _ in parsed:
        for u in {normal(own), *map(normal, re.split(r"\n\s*\n", own)), *map(normal, own.split("\n"))} - {""}:
            saying.setdefault(u, set()).add((c, t))

    def original(unit, c, t):
        here = [x for x in saying.get(unit, ()) if x[0] == c]
        if here and min(here)[1] < t:
            return min(here)
        first = min(saying.get(unit, [(c, t)]))
        return first if first < (c, t) and len(unit) >= 12 else None

    weights, counts, out = {}, {}, []
    for c, t, _, _, lines in parsed:
        runs = []
        for v, b in lines:
            if not runs or runs[-1][0] != v:
                runs.append((v, []))
            runs[-1][1].append(b)
        for v, bodies in runs:
            if not v or not normal(" ".join(bodies)):
                continue
            links = []
            if o := original(normal(" ".join(bodies)), c, t):
                links.append((o, len(normal(" ".join(bodies)))))
            else:
                for para in "\n".join("" if not b.strip() else b for b in bodies).split("\n\n"):
                    parts = [b for b in para.split("\n") if b.strip()]
                    if o := original(normal(" ".join(parts)), c, t):
                        links.append((o, len(normal(" ".join(parts)))))
                    else:
                        links += [(o, len(normal(b))) for b in parts if (o := original(normal(b), c, t))]
            n = counts.setdefault((c, t), [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + bool(links)
            for o, k in links if v == 1 else ():
                w = weights.setdefault((c, t), {})
                w[o] = w.get(o, 0) + k
    parent = {m: max((k, o[0] == m[0], o) for o, k in w.items())[2] for m, w in weights.items()}
    start = {c: min(t for k, t, *_ in parsed if k == c) for c, *_ in parsed}
    for c, t, role, own, _ in parsed:
        m, depth = (c, t), 0
        while m in parent:
            m, depth = parent[m], depth + 1
        p = parent.get((c, t), (None, None))
        out.append((c, t, role, own, *counts.get((c, t), [0, 0]), *p, m[0], m[1] if depth else start[c], depth))
    out.sort(key=lambda r: (r[8], r[9], r[0], r[1], r[2], r[3]))
    seen, done = {}, []
    for r in out:
        k = seen.get(r[8:10], 0)
        seen[r[8:10]] = k + 1
        done.append((*r, k))
    return done


def test_quotation_against_brute_force(spark, monkeypatch):
    from certveil.llm import quotation as Q
    from certveil import session as shared

    rng = np.random.default_rng(12)
    pick = lambda n: " ".join(rng.choice(WORDS[:60], n))
    rows, texts = [], []
    for c in range(30):
        for t in range(int(rng.integers(2, 9))):
            own = "\n".join(pick(int(rng.integers(1, 7))) if rng.random() < 0.8 else "" for _ in range(int(rng.integers(1, 7))))
            if texts and rng.random() < 0.7:
                q = texts[int(rng.integers(max(0, len(texts) - 12), len(texts)))].split("\n")
                i = int(rng.integers(0, len(q)))
                q = q[i : i + int(rng.integers(1, 6))] if rng.random() < 0.5 else q
                own = "\n".join(["He wrote:"] * (rng.random() < 0.5) + [">" * (1 + (rng.random() < 0.2)) + " " * (rng.random() < 0.8) + x for x in q]) + "\n" + own
            texts.append(own)
            rows.append((c, t, "ab"[t % 2], own))
    rows.append(rows[5])
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fields = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "position"]
    want = sorted(brute_links(rows), key=repr)
    assert sum(r[5] for r in want) > 20 and max(r[10] for r in want) > 2
    import duckdb
    import pyarrow as pa

    from certveil.llm import sql

    con = duckdb.connect()
    con.register("conversations", pa.table({k: list(v) for k, v in zip(["conv_id", "turn", "role", "text"], zip(*rows, strict=True), strict=True)}))
    assert sorted(con.execute(f"SELECT {', '.join(fields)} FROM ({sql.QUOTATION})").fetchall(), key=repr) == want
    for cold, few in ((shared.COLD, Q.FEW), (2, 0)):  # the second: hot keys and salts
        monkeypatch.setattr(shared, "COLD", cold)
        monkeypatch.setattr(Q, "FEW", few)
        assert sorted((tuple(r[f] for f in fields) for r in Q.link(m).collect()), key=repr) == want


def test_decontamination(spark, hard, empty):
    from certveil.llm.decontamination import contaminated

    item = "Alice has 12 apples and gives Bob 5 of them before walking 3 km to the market in Paris; how many apples does Alice keep?"
    other = item.replace("12", "44").replace("Alice", "Carol").replace("Bob", "Dave").replace("Paris", "Rome").replace("3 km", "7 miles")
    mixed = "Carol has 44 apples and gives Dave 9 of them before walking 8 km to the market in Rome; how many apples does Erin keep?"
    rows = [(11, "before. " + item + " after"), (12, other), (13, mixed.replace("Dave 9", "Erin 9")), (14, "Quite other words stand here, and none of them are in the item at all."), (15, "Alice has 12 apples")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("templates", F.lit("x")).withColumn("h", F.lit(1))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: r for r in contaminated(docs, bench).collect()}
    assert set(got) - {13} == {11, 12} and got[11].kind == "verbatim" and got[12].kind == "reparameterised" and got[12].consistency == 1
    assert contaminated(docs, bench, consistency=1.0).where("doc_id = 13").count() == 0
    assert contaminated(hard, bench).count() == 0 and contaminated(empty, bench).count() == 0 and contaminated(docs, bench.where("false")).count() == 0
    full = spark.read.parquet(f"{SMALL}/documents.parquet")
    b = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [r.text for r in b.collect()]
    assert {r.doc_id for r in contaminated(full, b).collect()} == {r.doc_id for r in full.collect() if any(t in r.text for t in items)}


def test_decontamination_ignores_case(spark):
    from certveil.llm.decontamination import contaminated

    items = ["La Casa Verde opened near Lake Garda in May and Luca sold 12 Red Kites there to Anna", "Every Word Of This Item Has A Capital And It Is Never Lost"]
    cases = [str, str.upper, str.lower, str.title, str.swapcase]
    docs = spark.createDataFrame([(10 * k + i, f"so it goes: {f(t)} and so on") for k, t in enumerate(items) for i, f in enumerate(cases)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage, r.kind) for r in got) == [(10 * k + i, k, 1.0, "verbatim") for k in (0, 1) for i in range(len(cases))]


def test_decontamination_takes_each_copy_by_itself(spark):
    from certveil.llm.decontamination import contaminated

    item = "Alice has 12 apples and gives Bob 5 of them before walking 3 km to the market in Paris; how many apples does Alice keep?"
    variants = [item.replace("12", str(20 + i)).replace("Alice", a).replace("Bob", b).replace("Paris", c).replace("3 km", f"{i + 4} miles") for i, (a, b, c) in enumerate([("Carol", "Dave", "Rome"), ("Erin", "Frank", "Oslo"), ("Grace", "Henry", "Cairo")])]
    longer = variants[0].replace("to the market", "slowly and alone to the market")
    loose, other = "Tom gave 3 coins to Tom and then 3 more coins to Tom while the 3 cats of Tom slept by the old door", "Ann gave 4 coins to Ben and then 6 more coins to Cid while the 9 cats of Dan slept by the old door"
    docs = [(1, item + " " + variants[0]), (2, " ".join(variants)), (3, longer + " And so on, and so on, as it was. " + variants[1]), (4, other), (5, variants[2])]
    got = {r.doc_id: r for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, loose)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 5} and all(r.consistency >= 0.8 for r in got.values())
    assert got[1].coverage == got[2].coverage == got[5].coverage == 1 and got[2].kind == got[5].kind == "reparameterised"


def test_decontamination_of_hard_items_and_null_ids(spark, monkeypatch):
    """Planted copies of items full of numbers and names, of short items, and under null ids are all found."""
    from certveil.llm import decontamination as D

    items = {1: "Marie Curie Pierre Curie 1903 Nobel Prize", 2: "12 kg 5 km 7 % 3 days 1999 2004 18 hours 4 miles", 3: "3 + 4 = 7", 4: "Why is grass green", 5: "two words", 6: "List 1 2 3 4 5 6 7 8 of values then 9 10 11 12 13 14 end", None: "A null item has words enough, so that it can be found in Rome by 12 people"}
    plain = "some words stand here before it and then"
    docs = [(10 * i, f"{plain} {t} {plain}") for i, t in items.items() if i] + [(10 * i + 1, f"{plain} {t.upper()} {plain}") for i, t in items.items() if i]
    docs += [(52, "Two words"), (None, f"{plain} {items[1]}"), (None, f"{plain} {items[None]}"), (None, "nothing of the kind"), (70, f"{items[None]} {plain}"), (80, plain), (81, "13 kg 6 km 8 % 4 days 2000 2005 19 hours 5 miles"), (82, "Why is the grass green"), (90, None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = sorted([(10 * i + k, i) for i in (1, 2, 4, 6) for k in (0, 1)] + [(30, 3), (31, 3), (52, 5), (None, 1), (None, None), (70, None)], key=repr)
    for few in (D.FEW, 0):
        monkeypatch.setattr(D, "FEW", few)
        assert sorted(((r.doc_id, r.item_id) for r in D.contaminated(*frames).collect()), key=repr) == want


def test_without(spark):
    from certveil.llm.shared import without

    docs = spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "y")], "doc_id long, text string")
    left = without(docs, spark.createDataFrame([(3,), (3,), (49,), (None,)], "doc long"))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == [-1] + [i for i in range(50) if i not in (3, 49)]
