"""Known answers of the scalar functions, span engines and sequential operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from certveil.functions import checksums as C
from certveil.functions import stats
from certveil.functions import text as T
from certveil.operators import act, graph, labels, metrics, monitor, risk, shift, spans
from certveil.schema import GRETEL_LABELS


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields)).select(column.alias("v")).first().v


@pytest.mark.parametrize("number, ok", [("4532015112830366", True), ("4111 1111 1111 1111", True), ("378282246310005", True), ("4532015112830367", False), ("1234567890123", False), ("", False)])
def test_luhn(spark, number, ok):
    assert value(spark, C.luhn_valid(F.col("n")), n=number) is ok


@pytest.mark.parametrize("iban, ok", [("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 32", True), ("FR1420041010050500013M02606", True), ("DE88370400440532013000", False), ("x", False)])
def test_iban(spark, iban, ok):
    assert value(spark, C.iban_valid(F.col("n")), n=iban) is ok


@pytest.mark.parametrize("country, bban", [("DE", "370400440532013000"), ("NL", "ABNA0417164300"), ("ES", "21000418450200051332")])
def test_made_ibans_are_valid(spark, country, bban):
    assert value(spark, C.iban_valid(C.make_iban(F.col("c"), F.col("b"))), c=country, b=bban) is True


def test_ssn(spark):
    got = {s: value(spark, C.ssn_plausible(F.col("s")), s=s) for s in ("123-45-6789", "000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000", "12")}
    assert got == {"123-45-6789": True, "000-45-6789": False, "666-45-6789": False, "900-45-6789": False, "123-00-6789": False, "123-45-0000": False, "12": False}


def test_hmac_equals_python(spark):
    import hmac

    assert value(spark, T.hmac_sha256(b"k", F.col("m")), m="a\0é") == hmac.new(b"k", "a\0é".encode(), "sha256").hexdigest()


def test_finditer_has_python_offsets(spark):
    text = "é a@b.co 𝒳 Ann Lee x@y.org\nBob Day"
    for pattern in (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"\b[A-Z][a-z]{2,}\s[A-Z][a-z]{2,}\b"):
        got = T.finditer(spark.createDataFrame([(1, text)], "doc_id int, text string"), pattern).collect()
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text)]
        assert [m for _, _, m in want] == [r.match for r in sorted(got, key=lambda r: r.start)]
        assert [(r.start, r.end) for r in sorted(got, key=lambda r: r.start)] == [(s, e) for s, e, _ in want]


def test_labels(spark):
    got = {x: value(spark, labels.map_label(F.col("x"), GRETEL_LABELS), x=x) for x in ("first_name", "api_key", "e-mail", "email", "National_ID")}
    assert got == {"first_name": "PERSON", "api_key": None, "e-mail": None, "email": "EMAIL", "National_ID": "SSN"}
    assert value(spark, labels.map_label(F.col("x"), {"a": "DOB"}), x="DATE-OF-BIRTH") is None


def test_engines_find_labelled_fields_and_names(spark):
    docs = spark.createDataFrame([(1, "Name: Melanie Carter\nSSN: 123-45-6789\nDr. Karen Lane signed. Card 4532 0151 1283 0366")], "doc_id int, text string")
    found = {(r.type, r.match) for r in spans.heuristic_spans(docs).collect()}
    assert {("PERSON", "Melanie Carter"), ("SSN", "123-45-6789")} <= found
    rules = {(r.type, r.match, r.score) for r in spans.rule_spans(docs).collect()}
    assert {("SSN", "123-45-6789", 0.96), ("CREDIT_CARD", "4532 0151 1283 0366", 0.98), ("PERSON", "Karen Lane", 0.85)} <= rules
    merged = {r.match: r.engines for r in spans.ensemble(docs).where("type = 'SSN'").collect()}
    assert merged["123-45-6789"] == ["heuristic-ner", "rule", "shape"]
    with pytest.raises(ValueError):
        spans.ensemble(docs, "rule,none")


def test_suppression_is_strict_and_merging_is_not(spark):
    rows = spark.createDataFrame([(1, 0, 10, "T", "", 0.9, "a"), (1, 5, 10, "T", "", 0.8, "a"), (1, 4, 10, "T", "", 0.7, "a")], "doc_id int, start int, end int, type string, match string, score double, engine string")
    assert sorted(r.start for r in spans.dedupe_overlaps(rows).collect()) == [0, 5]
    assert [r.start for r in spans.merge_spans(rows).collect()] == [0]


def test_surrogates_keep_kind_and_shape(spark):
    rows = [("EMAIL", "jo@x.org"), ("CREDIT_CARD", "3782-822463-10005"), ("IBAN", "DE89370400440532013000"), ("PHONE", "(212) 555-0100"), ("DOB", "1980-02-03"), ("SSN", "123-45-6789"), ("__ALL__", "all")]
    docs = act.with_surrogates(spark.createDataFrame(rows, "type string, value string"), b"secret")
    out = {r.type: r.replacement for r in docs.collect()}
    assert out == {r.type: r.replacement for r in docs.collect()}
    assert out["EMAIL"].endswith("@x.org") and out["__ALL__"] == "[REDACTED]"
    assert re.fullmatch(r"\d{4}-\d{6}-\d{5}", out["CREDIT_CARD"]) and value(spark, C.luhn_valid(F.col("n")), n=out["CREDIT_CARD"])
    assert value(spark, C.iban_valid(F.col("n")), n=out["IBAN"]) and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", out["PHONE"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", out["DOB"]) and value(spark, C.ssn_plausible(F.col("n")), n=out["SSN"])


def test_rewrite_handles_overlaps(spark):
    docs = spark.createDataFrame([(1, "Call 555-010-2020 or a.b@c.com now"), (2, "nothing")], "doc_id int, text string")
    s = spark.createDataFrame([(1, 5, 17, "PHONE", 0.9), (1, 8, 12, "ACCOUNT_NUMBER", 0.5), (1, 21, 30, "EMAIL", 0.9)], "doc_id int, start int, end int, type string, score double")
    out = act.rewrite(docs, act.union_spans(s).withColumn("replacement", F.concat(F.lit("<"), "type", F.lit(">"))))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Call <PHONE> or <EMAIL> now", 2: "nothing"}


def test_ledger_finds_tampering(spark):
    rows = spark.createDataFrame([(0, i, f"row {i}") for i in range(5)], "ledger long, seq long, payload string")
    chain = act.ledger_chain(rows)
    assert act.ledger_verify(chain).first().valid
    assert not act.ledger_verify(chain.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload")))).first().valid
    assert not act.ledger_verify(chain.where("seq <> 2")).first().valid


def test_escalation_is_greedy_optimum(spark):
    rows = spark.createDataFrame([(1, "T", "a", 0.5), (2, "T", "a", 0.6), (3, "T", "b", 0.9), (4, "T", "c", 0.0)], "cand_id int, type string, value string, pi double")
    assert [r.value for r in act.escalate(rows, 3).orderBy("rank").collect()] == ["a", "b"]


def test_propagation_bounds(spark):
    n = spark.createDataFrame([(1, "T", "a", 0.9), (2, "T", "a", 0.3), (3, "T", "b", 0.2)], "node int, type string, value string, score double")
    e = graph.affinity(spark.createDataFrame([(2, 3, 1.0)], "src int, dst int, w double"))
    out = {r.node: r.score for r in graph.propagate(n, e).collect()}
    assert out[1] == 0.9 and math.isclose(out[2], 0.855) and 0.2 <= out[3] <= 1
    flat = {r.node: r.score for r in graph.propagate(n, e, beta1=0.0, beta2=0.0).collect()}
    assert flat == {1: 0.9, 2: 0.3, 3: 0.2}


def test_e_values_reject_the_large_one(spark):
    rows = spark.createDataFrame([("PERSON", 400.0), ("EMAIL", 1.2), ("SSN", 0.4), ("IBAN", 30.0)], "name string, e_value double")
    assert {r.name for r in monitor.e_bh(rows, 0.05).where("rejected").collect()} == {"PERSON"}


def test_e_process_alarms_after_a_change_only(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    x = spark.range(2400).select((F.col("id") * 0).alias("series"), F.col("id").alias("pos"), (u < F.when(F.col("id") < 400, 0.05).otherwise(0.35)).cast("double").alias("x"))
    r = monitor.e_process(x, 0.1).first()
    assert r.alarm is not None and 400 <= r.alarm < 700
    assert monitor.e_process(x.where("pos < 400"), 0.1).first().alarm is None


def test_chao_regimes(spark):
    rows = [("all", 3)] * 50 + [("mixed", m) for m in [1] * 40 + [2] * 60 + [3] * 10] + [("single", 1)] * 40
    out = {r.type: r for r in monitor.chao1(spark.createDataFrame(rows, "type string, multiplicity int"), 3).collect()}
    assert out["all"].n_hat == 50 and out["mixed"].n_upper > out["mixed"].n_hat > 110 and not out["single"].informative


def test_robust_radius(spark):
    x, n = np.array([0.0, 0.2, 1.0]), np.array([50.0, 30.0, 2.0])
    assert shift.certified_radius(np.array([0.3]), np.array([10.0]), 0.1) == 0
    assert shift.certified_radius(np.array([0.01]), np.array([10.0]), 0.1) == 50
    w = [shift.worst_case(x, n, r) for r in (0, 0.1, 0.5, 1)]
    assert w == sorted(w) and math.isclose(w[0], np.average(x, weights=n))
    big = [shift.finite_sample_worst_case(x, n, r) for r in (0, 0.1, 0.5)]
    assert all(b >= a for a, b in zip(w, big, strict=False))


def test_prf(spark):
    gold = spark.createDataFrame([(1, 1, 0, 5, "PERSON"), (1, 2, 10, 17, "EMAIL")], "doc_id int, gid int, start int, end int, type string")
    pred = spark.createDataFrame([(1, 1, 0, 5, "PERSON", 0.9), (1, 2, 30, 35, "PHONE", 0.9)], "doc_id int, pid int, start int, end int, type string, score double")
    r = metrics.evaluate(gold, pred).where("type = 'ALL'").first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1)


def test_tests_by_sequence_are_monotone(spark):
    rows = spark.createDataFrame([(j, 400, max(0.0, 0.12 - 0.003 * j), 0.003 * j) for j in range(41)], "j int, n long, leak double, over double")
    fixed = {r.j for r in risk.learn_then_test(rows, 0.1, 0.1, 0.05).where("certified").collect()}
    strict = {r.j for r in risk.learn_then_test(rows, 0.1, 0.1, 0.05, "bonferroni").where("certified").collect()}
    assert strict <= fixed and fixed
    assert not risk.learn_then_test(rows, 1e-4, 1e-4, 0.05).where("certified").collect()


def test_binomial_tail(spark):
    want = sum(math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(5))
    assert math.isclose(value(spark, stats.binomial_cdf(F.col("k"), F.col("n"), 0.3), k=4, n=20), want, rel_tol=1e-9)
