"""Calibration and deployment end to end, and the parts that have no SQL twin."""

import json
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from certveil.functions import registry, stats
from certveil.functions import text as T
from certveil.operators import act, graph, labels, monitor, risk, shift, spans
from certveil.plans import fixtures as X
from certveil.plans import pipeline as P

LEVELS = {"alpha": 0.3, "gamma": 0.3, "epochs": 60}


@pytest.fixture(scope="module")
def halves(spark):
    docs, gold = X.forms(spark, SMALL), X.form_gold(spark, SMALL)
    part = labels.split(docs.withColumn("is_dup", F.lit(False))).select("doc_id", "text", "part").cache()
    cal, dep = (part.where(F.col("part") == p).select("doc_id", "text") for p in ("calibration", "test"))
    of = lambda x: gold.join(x.select("doc_id"), "doc_id", "left_semi")
    return cal, dep, of(cal), of(dep)


@pytest.fixture(scope="module")
def pool(halves):
    return P.pool(halves[0], halves[1], P.Config())


@pytest.fixture(scope="module")
def certificate(halves, pool):
    return P.calibrate(halves[0], halves[1], halves[2], P.Config(**LEVELS, key=b"k"), pool)[0]


@pytest.fixture(scope="module")
def report(halves, pool, certificate):
    return P.deploy(certificate, pool, halves[3])


def test_a_certificate_is_given_and_says_where_it_holds(certificate):
    assert not certificate.empty and certificate.verdict in ("valid", "void") and certificate.rho_star > 0
    assert certificate.in_scope == (certificate.rho_hat <= certificate.rho_star)
    blob = json.dumps(certificate.to_dict(), allow_nan=False)
    assert json.loads(blob)["alpha"] == 0.3 and "Infinity" not in blob


def test_risks_fall_and_rise_to_full_redaction(certificate):
    points = certificate.points.orderBy("j").collect()
    leak, over = [p.leak for p in points], [p.over for p in points]
    assert leak == sorted(leak, reverse=True) and over[:-1] == sorted(over[:-1]) and (leak[0], over[0]) == (1.0, 0.0)
    assert (leak[-1], over[-1], points[-1].esc, points[-1].t) == (0.0, 1.0, 1.0, 1.0) and points[-1].p_over == 1.0
    best = [p for p in points if p.certified and p.esc <= 0.3]
    assert certificate.j == max(best, key=lambda p: (p.rho_star, -p.j)).j


def test_risks_equal_a_loop_over_documents(halves, pool, certificate):
    """The events' sums against masks made step by step."""
    cal, _, gold, _ = halves
    cands = [r for r in P._part(pool.candidates, "calibration").collect()]
    texts, by_doc, golds = {f"c|{r.doc_id}": r.text for r in cal.collect()}, {}, {}
    for c in cands:
        by_doc.setdefault(c.doc_id, []).append(c)
    for g in gold.collect():
        golds.setdefault(f"c|{g.doc_id}", []).append(g)
    path = risk.mask_path(pool.candidates).orderBy("j").collect()
    over_lap = lambda a, b: max(0, min(a.end, b.end) - max(a.start, b.start))
    import re

    for step in (0, 3, len(path) // 2, len(path) - 2):
        limit = {}
        for p in path[: step + 1]:
            if p.type:
                limit[p.type] = min(p.score, limit.get(p.type, 2))
        leaks, overs = [], []
        for d, text in texts.items():
            masked = [c for c in by_doc.get(d, []) if c.score >= limit.get(c.type, 2)]
            gs = golds.get(d, [])
            leaks.append(sum(not any(m.type == g.type and 2 * over_lap(m, g) >= max(m.end, g.end) - min(m.start, g.start) for m in masked) for g in gs) / max(1, len(gs)))
            tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
            plain = [t for t in tokens if not any(g.start < t[1] and t[0] < g.end for g in gs)]
            overs.append(sum(any(m.start < t[1] and t[0] < m.end for m in masked) for t in plain) / max(1, len(plain)))
        row = certificate.points.where(F.col("j") == step).first()
        assert abs(row.leak - np.mean(leaks)) < 1e-9 and abs(row.over - np.mean(overs)) < 1e-9


def test_deployment_keeps_the_level_and_covers_every_document(halves, report, certificate):
    n = halves[1].count()
    assert report.n_docs == n and report.realised_leakage <= certificate.config.alpha and report.realised_overmask <= 0.5
    assert report.ledger.count() == n and act.ledger_verify(report.ledger).where("not valid").count() == 0
    assert {r.stage for r in report.texts.collect()} == {"mask"} and report.dark_matter.count() and report.alarms.count() == 9
    types = {r.type for r in report.candidate_miss.collect()}
    assert "ALL" in types and {r.type for r in report.effective_miss.collect()} == types
    shown = {r.doc_id: r.text for r in report.texts.collect()}
    secret = halves[1].join(halves[3].where("type in ('EMAIL', 'IBAN', 'CREDIT_CARD')"), "doc_id").select("doc_id", F.expr("substring(text, start + 1, `end` - start)").alias("v")).collect()
    assert secret and not [1 for r in secret if r.v in shown[r.doc_id]]


def test_the_pool_holds_both_parts(halves, pool):
    assert pool.docs.count() == halves[0].count() + halves[1].count()
    assert {r.role for r in pool.docs.select("role").distinct().collect()} == {"calibration", "deployment"}


def test_tighter_levels_leak_no_more_and_infeasible_ones_go_to_review(halves, pool):
    cal, dep, g, h = halves
    leaks = []
    for alpha in (0.5, 0.2):
        c, _ = P.calibrate(cal, dep, g, P.Config(alpha=alpha, gamma=0.5, epochs=60), pool)
        if not c.empty:
            leaks.append(P.deploy(c, pool, h).realised_leakage)
    assert leaks == sorted(leaks, reverse=True)
    c, _ = P.calibrate(cal, dep, g, P.Config(alpha=1e-6, gamma=1e-6, epochs=60), pool)
    r = P.deploy(c, pool, h)
    assert c.empty and c.verdict == "no-certificate" and (r.escalated_fraction, r.realised_leakage, r.realised_overmask) == (1.0, 0.0, 1.0)
    assert r.ledger.count() == dep.count() and {x.stage for x in r.texts.collect()} == {"route-to-review"} and r.masked.count() == 0


def test_the_best_f1_promises_no_radius(halves, pool):
    c, _ = P.calibrate(*halves[:3], P.Config(select_by="max_f1", epochs=60), pool)
    assert c.uncertified and c.rho_star == 0.0 and c.diagnostics["f1"] > 0.5
    assert P.deploy(c, pool, halves[3]).span_metrics.where("type = 'ALL'").first().f1 > 0.5


def test_no_guarantee_without_gold_and_no_odd_knobs(halves):
    with pytest.raises(ValueError):
        P.calibrate(halves[0], halves[1], None, P.Config())
    for bad in ({"beta2": 1.0}, {"steps": 0}, {"beta1": 1.5}, {"alpha": 0.0}, {"select_by": "luck"}, {"grid": 1}):
        with pytest.raises(ValueError):
            P.Config(**bad).validate()


def test_another_corpus_is_declared_void(spark, halves):
    """Other words and templates: the radius can't cover it, and that is known before any label is read."""
    cal = halves[0]
    other = spark.createDataFrame([(i, f"zzq kkw {i} vvx jjh " * 30) for i in range(60)], "doc_id long, text string")
    r = shift.fit_density_ratio(cal, other)
    assert r.separable and math.isinf(r.rho_hat) and math.isinf(r.low)
    same = shift.fit_density_ratio(cal, halves[1], epochs=60)
    assert not same.separable and same.rho_hat < 0.5 and same.low <= same.high and abs(same.weights.agg(F.avg("w")).first()[0] - 1) < 1e-9


def test_config_files(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# levels\nalpha: 0.07\nengines: \"rule\"\ntypes: EMAIL, SSN\nweighted: false\ngrid: 128 # steps\n")
    c = P.load_config(str(path), gamma=0.2)
    assert (c.alpha, c.engines, c.types, c.weighted, c.grid, c.gamma) == (0.07, "rule", ("EMAIL", "SSN"), False, 128, 0.2)
    assert P.Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.as_dict().items()}).alpha == 0.07
    path.write_text("colour: red\n")
    with pytest.raises(ValueError):
        P.load_config(str(path))


def test_finite_radius_is_below_the_plain_one():
    rng = np.random.default_rng(0)
    for n in (300, 2000):
        x, k = np.unique(np.round(rng.beta(2, 20, n), 3), return_counts=True)
        plain, finite = shift.certified_radius(x, k.astype(float), 0.2), shift.finite_radius(x, k.astype(float), 0.2)
        assert 0 < finite < plain
        worst = [shift.finite_sample_worst_case(x, k.astype(float), r) for r in (0, 0.05, 0.2, 1, 5)]
        assert worst == sorted(worst) and all(w >= shift.worst_case(x, k.astype(float), r) for w, r in zip(worst, (0, 0.05, 0.2, 1, 5), strict=True))
    one = np.array([0.3]), np.array([500.0])
    assert shift.certified_radius(*one, 0.2) == 0.0 and shift.certified_radius(np.array([0.01]), np.array([500.0]), 0.2) == 50.0


def test_betting_path_equals_single_series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        events = [(int(j), 1, int(rng.integers(0, 3)), 0) for j in sorted(rng.choice(6, 2, replace=False) + 1)]
        rows.append((f"{i:03}", 3, 10, events))
    losses = spark.createDataFrame(rows, "doc_id string, n_gold long, n_plain long, events array<struct<j:int,gold:bigint,plain:bigint,band:bigint>>")
    got = {r.j: (r.b_leak, r.b_over) for r in risk.betting_path(losses, 9, 0.5, 0.2).collect()}
    for j in range(8):
        leak, over = risk.LowBettor(0.5), risk.LowBettor(0.2)
        for _, g, p, events in rows:
            leak.see((g - sum(e[1] for e in events if e[0] <= j)) / g)
            over.see(sum(e[2] for e in events if e[0] <= j) / p)
        assert abs(got[j][0] - leak.p()) < 1e-9 and abs(got[j][1] - over.p()) < 1e-9
    assert got[8][1] == 1.0


def test_binomial_sums_whatever_the_size(spark):
    rows = [(k, n) for n in (1, 5, 40, 1000, 50_000) for k in sorted({0, 1, n // 20, n // 10, n // 3, n - 1, n})]
    got = spark.createDataFrame(rows, "k long, n long").withColumn("p", stats.binomial_cdf(F.col("k"), F.col("n"), 0.1)).collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.1) + (r.n - i) * math.log(0.9)) for i in range(min(r.k, r.n) + 1))
        assert abs(r.p - want) < 1e-7, r


def test_context_vectors_and_similarity_edges(spark):
    text = "the wire for {} was sent to the bank in the north on that day by hand"
    docs = spark.createDataFrame([(1, text.format("Ann Lee")), (2, text.format("Bob Day")), (3, "quite other words around Cid Fox here and there")], "doc_id long, text string")
    s = spans.apply_rules(docs, [r for r in spans.RULES if r.name == "bigram"]).withColumn("node", F.col("doc_id") * 10)
    v = graph.context_vectors(s, docs)
    assert all(abs(r.n - 1) < 1e-9 for r in v.groupBy("node").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect())
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    e = graph.similarity_edges(s, v, pairs).collect()
    assert [(r.src, r.dst) for r in e] == [(10, 20)] and e[0].w > 0.9
    norm = graph.affinity(graph.similarity_edges(s, v, pairs))
    assert graph.affinity_mass(norm) == 1.0 and norm.count() == 2
    nodes = spark.createDataFrame([(10, 0.9), (20, 0.3)], "node long, score double")
    spread = {r.node: r.diffusion for r in graph.diffusion_channel(nodes, norm, 0.6, 1).collect()}
    assert abs(spread[20] - 0.4 * (0.3 + 0.6 * 0.9)) < 1e-9


def test_ledger_sees_changes_and_reordering(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, f"p{i}") for i in range(20)] + [(2, i, "x") for i in range(3)], "ledger long, seq long, payload string")
    chain = act.ledger_chain(rows)
    act.write_ledger(chain, str(tmp_path / "l"))
    back = act.read_ledger(spark, str(tmp_path / "l"))
    ok = lambda x: {r.ledger: r.valid for r in act.ledger_verify(x).collect()}
    assert ok(back) == {1: True, 2: True}
    assert ok(back.withColumn("payload", F.when(F.col("seq") == 7, "q").otherwise(F.col("payload")))) == {1: False, 2: True}
    assert ok(back.withColumn("seq", F.when(F.col("seq") == 4, 5).when(F.col("seq") == 5, 4).otherwise(F.col("seq")))) == {1: False, 2: True}


def test_surrogates_keep_kind_and_shape(spark):
    rows = [("CREDIT_CARD", "4532 0151 1283 0366"), ("EMAIL", "a.b@c.com"), ("PHONE", "555-010-2020"), ("ACCOUNT_NUMBER", "1" * 40), ("IBAN", "DE89370400440532013000"), ("SSN", "123-45-6789"), ("PERSON", "Ann Lee"), ("DOB", "01/02/1990"), ("ADDRESS", "1 Oak St")]
    s = spark.createDataFrame(rows, "type string, value string")
    got = {r.type: r.replacement for r in act.with_surrogates(s, b"key").collect()}
    assert got == {r.type: r.replacement for r in act.with_surrogates(s, b"key").collect()} != {r.type: r.replacement for r in act.with_surrogates(s, b"other").collect()}
    assert all(got[t] != v for t, v in rows) and got["EMAIL"].endswith("@c.com")
    from certveil.functions.checksums import iban_valid, luhn_valid

    good = spark.createDataFrame([(got["CREDIT_CARD"], got["IBAN"])], "c string, i string").select(luhn_valid(F.col("c")).alias("c"), iban_valid(F.col("i")).alias("i")).first()
    assert good.c and good.i and [len(x) for x in got["CREDIT_CARD"].split()] == [4, 4, 4, 4]
    long = got["ACCOUNT_NUMBER"]
    assert len(long) == 40 and long.isdigit() and long[:20] != long[20:] and long[:16] != long[16:32]


def test_a_registered_engine_and_statistic(spark):
    registry.register_engine(spark, "shouts", lambda t: [(i, i + 1, "BANG", 0.5) for i, c in enumerate(t) if c == "!"])
    docs = spark.createDataFrame([(1, "a!b!"), (2, "c"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.match) for r in registry.engine_spans(docs, "shouts").collect()) == [(1, 1, "!"), (1, 3, "!")]
    registry.register_statistic(spark, "spread", lambda x: x.max() - x.min())
    assert spark.sql("select spread(id) from range(5)").first()[0] == 4.0


def test_alarms_by_name(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, float(rng.random() < (0.05 if s == 0 or i < 300 else 0.5))) for s in (0, 1) for i in range(800)]
    stream = spark.createDataFrame(rows, "series long, pos long, x double")
    for name, f in registry.alarms().items():
        got = {r.series: r.alarm for r in f(stream, 0.05).collect()}
        assert got[1] is not None and got[1] >= 290, name
        if name != "fixed-window":
            assert got[0] is None, name
    sums = {r.series: r.peak for r in monitor.e_detector_alarm(stream, 0.05).collect()}
    assert sums[1] > 1e6


def test_offsets_of_long_documents_are_near_linear(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
        at = time.time()
        row = T.finditer(docs, r"\S+").agg(F.count("*").alias("n"), F.max("end").alias("e")).first()
        assert row.n == n and row.e == sum(len(f"w{i}") + 1 for i in range(n)) - 1
        return time.time() - at

    seconds(100)
    assert seconds(150_000) < 20


def test_marks_in_texts_do_not_part_matches(spark):
    docs = spark.createDataFrame([(1, "a￿b c"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.start, r.end) for r in T.finditer(docs, r"\S+").collect()] == [(0, 3), (4, 5)]
