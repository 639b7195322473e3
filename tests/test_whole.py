"""Registered queries take all rows of their tables: brute force beside them."""

import hashlib

from conftest import SMALL
from pyspark.sql import functions as F

from certveil.plans import catalogue


def test_ledgers_hold_every_order(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").orderBy("o_orderkey").collect()
    heads, want = {}, {}
    for o in orders:
        prev = heads.get(o.o_custkey, "0" * 64)
        heads[o.o_custkey] = hashlib.sha256(f"{prev}|{o.o_orderstatus}|{o.o_custkey}".encode()).hexdigest()
        want[o.o_orderkey] = (o.o_custkey, prev, heads[o.o_custkey])
    got = catalogue.queries()["ledger_chain"](spark, SMALL).collect()
    assert len(got) == len(orders) and {r.seq: (r.ledger, r.prev_digest, r.digest) for r in got} == want
    checked = catalogue.queries()["ledger_verify"](spark, SMALL).collect()
    assert sum(r.n_rows for r in checked) == len(orders) and {r.ledger: r["head"] for r in checked} == heads
    assert [(r.ledger, r.n_bad) for r in checked if not r.valid] == [(want[402][0], 1)]


def test_duplicates_are_found_and_confirmed_on_full_sets(spark, tmp_path):
    rows = []
    for k in range(60):
        base = [f"k{k}w{i}" for i in range(100)]
        for j, changed in enumerate(((), (20, 60), (20, 50, 80))):  # likeness 1, 86 / 106, 81 / 111
            rows.append((3 * k + j, " ".join("other" + w if i in changed else w for i, w in enumerate(base))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.original for r in catalogue.queries()["duplicate_of"](spark, str(tmp_path)).collect()}
    assert {i: o for i, o in got.items() if i % 3 < 2} == {i: i - 1 if i % 3 else None for i, _ in rows if i % 3 < 2}
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(96)} for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in got:
        near = [(-like(j, i), j) for j in range(i - i % 3, i) if like(j, i) >= 0.75]
        assert got[i] == (min(near)[1] if near else None)
    pairs = {(r.a, r.b) for r in catalogue.queries()["minhash_pairs"](spark, str(tmp_path)).collect()}
    assert {(3 * k, 3 * k + 1) for k in range(60)} <= pairs


def test_weights_and_losses_of_every_order(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").collect()
    w = {o.o_orderkey: 0.5 + o.o_custkey % 10 / 10 for o in orders}
    total = sum(w.values()) + max(w.values())
    got = {r.pos: float(r.weight) for r in catalogue.queries()["weighted_crc_weights"](spark, SMALL).collect()}
    assert set(got) == set(w) and all(abs(got[k] - w[k] / total) < 1e-9 for k in w)
    risks = {j: sum(w[o.o_orderkey] * (float(o.o_totalprice) % 1) / j for o in orders) / total + max(w.values()) / total for j in range(1, 9)}
    r = catalogue.queries()["weighted_crc"](spark, SMALL).first()
    want = min(j for j in risks if risks[j] <= 0.1)
    assert r.j_star == want and abs(float(r.risk) - risks[want]) < 1e-6


def test_certified_run_masks_every_deployed_form(spark):
    from certveil.operators import labels
    from certveil.plans.fixtures import forms

    part = labels.split(forms(spark, SMALL).withColumn("is_dup", F.lit(False)))
    got = {r.type: r.n_docs for r in catalogue.queries()["certified_run"](spark, SMALL).collect()}
    assert got["EMAIL"] == part.where("part = 'test'").count() > 50
