"""Report tables, the runner of experiments, n-gram features."""

import json
import math

from conftest import SMALL

from certveil.operators.shift import featurise
from certveil.sources import assets


def test_tables(spark):
    rows = spark.createDataFrame([("a|b_c", 0.5, None), ("d e", float("inf"), 3)], "name string, x double, n long").coalesce(1)
    assert assets.markdown(rows, 2) == "| name | x | n |\n|-|-|-|\n| a\\|b_c | 0.50 | - |\n| d e | inf | 3 |\n"
    assert "a|b\\_c & 0.5000 & - " in assets.latex(rows) and assets.latex(rows).startswith("\\begin{tabular}{lll}")
    assert assets.columns(rows).splitlines()[2] == "d_e inf 3"


def test_runner_leaves_rows_tables_and_a_manifest(spark, tmp_path):
    from certveil.plans.experiments import run_all

    out = str(tmp_path / "reports")
    got = run_all(spark, SMALL, out, ("engine_baselines", "exp_monitor"))
    assert [m["name"] for m in got] == ["engine_baselines", "exp_monitor"] and got[0]["rows"] == 3
    assert json.loads(spark.read.text(f"{out}/manifest").first().value)["reports"][1]["rows"] == 6
    monitors = {r.monitor: r for r in spark.read.json(f"{out}/exp_monitor/rows").collect()}
    assert float(monitors["e-process"].null_alarms) <= 0.1 and float(monitors["cusum calibrated"].null_alarms) <= 0.06 and float(monitors["fixed-window calibrated"].null_alarms) <= 0.06
    sound = [r for n, r in monitors.items() if n.startswith("e-") or "calibrated" in n]  # the others alarm before the change too often
    assert len(sound) == 4 and all(float(r.detected) > 0.8 for r in sound), {n: (r.detected, r.null_alarms) for n, r in monitors.items()}


def test_reports_on_forms(spark):
    """The experiments without SQL twins: what must hold of their rows."""
    from certveil.plans import catalogue

    q = catalogue.queries()
    main = {r.system: r for r in q["exp_main_table"](spark, SMALL).collect()}
    assert set(main) == {"rule", "heuristic-ner", "shape", "strict", "balanced", "uncertified"} and main["uncertified"].alpha is None
    assert all(r.certified != "held" or r.miss <= r.alpha for r in main.values())
    radius = q["exp_shift_radius"](spark, SMALL).orderBy("rho").collect()
    assert [r.worst for r in radius] == sorted(r.worst for r in radius) and all(r.worst_finite >= r.worst - 1e-9 for r in radius) and radius[0].rho_star >= radius[0].rho_star_finite
    esc = q["exp_escalation"](spark, SMALL).collect()
    for kind in ("review", "gold"):
        rows = sorted((r for r in esc if r.resolver == kind), key=lambda r: r.budget)
        assert [r.leakage for r in rows] == sorted((r.leakage for r in rows), reverse=True) and rows[0].n_escalated == 0
    assert all(g.precision >= r.precision - 1e-9 for g in esc for r in esc if g.resolver == "gold" and r.resolver == "review" and g.budget == r.budget)
    report = {r.setting: r for r in q["deploy_report"](spark, SMALL).collect()}
    assert report["refused"].verdict == "no-certificate" and report["refused"].ledger_rows == report["refused"].n_docs and report["best-f1"].rho_star == 0.0


def test_features_against_loops(spark):
    texts = ["Abc abc 12\n", "", "é", "aaaa" * 10]
    got = {r.doc_id: r.features for r in featurise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        v, b = [0.0] * 512, t.encode()
        for k in range(len(b) - 3):
            h = 0
            for c in b[k : k + 4]:
                h = h * 0x01000193 % 2**32 ^ c
            v[(h ^ h >> 15) % 512] += 1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(a - x / norm) < 1e-9 for a, x in zip(got[i], v, strict=False))
        assert abs(got[i][512] - math.log1p(len(t)) / 10) < 1e-9 and got[i][517] == 1.0


def test_every_twin_has_a_query():
    from certveil.plans import catalogue

    names = set(catalogue.queries())
    assert set(catalogue.oracle_sql()) <= names and len(names) > 110
