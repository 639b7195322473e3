"""Plans and steps that larger tables need, each beside a small case."""

from conftest import SMALL
from pyspark.sql import functions as F

from certveil.operators import risk
from certveil.plans import catalogue


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_texts_and_tokens_are_not_broadcast_by_estimate(spark):
    q = catalogue.queries()
    for name in ("surrogate_text", "form_candidates", "risk_overmask", "ltt_bonferroni"):
        plan = planned(q[name](spark, SMALL))
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "doc_id" in line], name


def test_tokens_are_shuffled_once(spark):
    tokens = spark.range(300).select((F.col("id") % 10).alias("doc_id"), F.expr("id div 10").alias("k"), (F.expr("id div 10") * 6).cast("int").alias("start"), (F.expr("id div 10") * 6 + 5).cast("int").alias("end"))
    gold = spark.createDataFrame([(d, 0, 20) for d in range(10)] + [(11, 0, 5)], "doc_id long, start int, end int")
    masked = spark.createDataFrame([(d, 12, 12 + 6 * d + 6) for d in range(10)] + [(3, 0, 200)], "doc_id long, start int, end int")
    catalogue.queries()["risk_escalation"](spark, SMALL)
    rows = risk.overmask(tokens, gold, masked)
    got = {r.doc_id: r.over for r in rows.collect()}
    spans = {d: [(12, 18 + 6 * d)] + [(0, 200)] * (d == 3) for d in range(10)}
    for d in range(10):
        plain = [(6 * k, 6 * k + 5) for k in range(30) if not 6 * k < 20]
        assert got[d] == sum(any(s < e and t < b for s, b in spans[d]) for t, e in plain) / len(plain)
    assert len(got) == 10
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 3, plan  # tokens, gold, masked


def test_streams_read_folders_and_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    q = catalogue.queries()
    for name in ("stream_dedup", "stream_eprocess", "stream_alarm_windows"):
        got, want = (sorted(map(tuple, q[name](spark, d).collect())) for d in (str(tmp_path), SMALL))
        assert got == want and got[0][0] is not None and (name != "stream_dedup" or got[0][0] > 0)


def test_shapes_are_worked_out_once_and_engines_run_once(spark):
    from certveil.operators import spans
    from certveil.plans.fixtures import forms

    plan = spans.shape_spans(forms(spark, SMALL), suppress=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\p{Lu}") == 1, plan.count(r"\p{Lu}")
    plan = catalogue.queries()["dark_matter"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_places_of_many_matches(spark):
    import re

    from certveil.functions import text as T

    text = " ".join("x" * (1 + i % 7) for i in range(500)) + "  end"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, " ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.k, r.start, r.end) for r in T.tokens(docs).collect())
    assert got == [(1, k, m.start(), m.end()) for k, m in enumerate(re.finditer(r"\S+", text))]
    assert "array_append" in str(T.starts("parts", "sums", lambda start, match: F.struct(start.alias("s"), match.alias("m"))))  # a block is folded once, not summed anew for each match


def test_the_discriminator_reads_every_row(spark):
    """All rows of a table larger than the former sample, in the driver and by passes of the executors."""
    import numpy as np

    from certveil.operators import shift

    n = 21_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.array((F.col("id") % 7 / 7.0), (F.col("id") / float(n)), F.lit(1.0)).alias("features"), ((F.col("id") > 0.6 * n) | (F.col("id") % 5 == 0)).cast("int").alias("target"))
    data = rows.collect()
    x, y = np.array([r.features for r in data]), np.array([r.target for r in data], float)
    w, beta = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n, np.zeros(3)
    for _ in range(40):
        beta -= 0.5 * (x.T @ (w * (1 / (1 + np.exp(-x @ beta)) - y)) + 1e-3 * beta)
    assert np.abs(shift.fit_discriminator(rows, epochs=40) - beta).max() < 1e-9


def test_passes_of_the_executors_equal_the_driver(spark):
    import numpy as np

    from certveil.operators import shift

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab c"), (F.col("id") % 90).cast("int")), F.col("id").cast("string")).alias("text"), (F.col("id") % 3 == 0).cast("int").alias("target"), (F.col("id") % 2).cast("int").alias("fold"))
    blocks = shift.packed(docs.repartition(3))
    here, there = shift.descend(blocks, [0, 1], epochs=5), shift.descend(blocks, [0, 1], epochs=5, held=0)
    assert all(np.abs(here[k] - there[k]).max() < 1e-12 and np.abs(here[k]).max() > 0 for k in (0, 1))
    want = {r.doc_id: r.features for r in shift.featurise(docs.select("doc_id", "text")).collect()}
    for r in blocks.collect():
        x, y = shift._rows_of(*r[:-1])
        assert np.array_equal(x, np.array([want[i] for i in r.ids])) and list(y) == [float(i % 3 == 0) for i in r.ids]
