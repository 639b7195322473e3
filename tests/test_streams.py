"""Streaming forms against the batch ones."""

import datetime as dt

from pyspark.sql import functions as F

from certveil.operators.models import ask
from certveil.operators.shift import auc_by_rank, dro_worst_case, worst_case
from certveil.streaming import streams as S

BASE = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, name):
    path = f"{tmp_path}/{name}"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(spark.read.parquet(f"{path}/0").schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def test_windows_over_several_micro_batches(spark, tmp_path):
    rows = [[(at(3 * i + 240 * k), i % 4, "error" if i % 5 == 0 else "ok") for i in range(20)] for k in range(3)]
    schema = "ts timestamp, user_id long, event_type string"
    flat = [r for part in rows for r in part]
    got = S._drain(S.alarm_windows(stream(spark, tmp_path, rows, schema, "a"), "30 minutes", slide="10 minutes"), "complete")
    last = {r.window_start: (r.n, r.errors) for r in got.groupBy("window_start").agg(F.max("n").alias("n"), F.max("errors").alias("errors")).collect()}
    for start, (n, errors) in last.items():
        inside = [r for r in flat if start <= r[0] < start + dt.timedelta(minutes=30)]
        assert (n, errors) == (len(inside), sum(r[2] == "error" for r in inside))
    sessions = S._drain(S.session_windows(stream(spark, tmp_path, rows, schema, "b"), "20 minutes"), "append").count()
    batch = spark.createDataFrame(flat, schema).groupBy(F.session_window("ts", "20 minutes"), "user_id").count().count()
    assert 0 < sessions <= batch


def test_duplicates_within_a_watermark(spark, tmp_path):
    rows = [[(1, "a  b", at(0)), (2, "A b", at(1)), (3, "c", at(2))], [(4, "a b", at(30)), (5, "d", at(31))]]
    schema = "doc_id long, text string, ts timestamp"
    kept = S._drain(S.deduplicated(stream(spark, tmp_path, rows, schema, "c"), "ts", "2 hours"), "append")
    assert sorted(r.doc_id for r in kept.collect()) in ([1, 3, 5], [2, 3, 5])
    assert S._drain(S.deduplicated(stream(spark, tmp_path, rows, schema, "d")), "append").count() == 3


def test_each_micro_batch_is_redacted(spark, tmp_path):
    rows = [[(1, "mail a@b.co")], [(2, "none")]]
    seen = []
    mask = lambda batch: batch.withColumn("text", F.regexp_replace("text", r"\S+@\S+", "[EMAIL]"))
    S.redact(stream(spark, tmp_path, rows, "doc_id long, text string", "e"), lambda df, epoch: seen.extend(r.text for r in df.collect()), mask).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start().awaitTermination()
    assert sorted(seen) == ["mail [EMAIL]", "none"]


def test_what_was_not_asked_is_said_so(spark):
    def client(text):
        if text == "bad":
            raise ValueError
        return f'[{{"text": "{text}", "type": "PERSON"}}]'

    docs = spark.createDataFrame([(i, "bad" if i == 1 else f"t{i}") for i in range(6)], "doc_id long, text string").coalesce(1)
    assert [r.status for r in ask(docs, client).orderBy("doc_id").collect()] == ["ok", "failed", "ok", "ok", "ok", "ok"]
    assert [r.status for r in ask(docs, client, 3).orderBy("doc_id").collect()] == ["ok", "failed", "ok", "unasked", "unasked", "unasked"]


def test_ranks_over_ranges_and_worst_case_of_many_losses(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.round(rng.random(3000), 3)
    y = (rng.random(3000) < x).astype(int)
    got = auc_by_rank(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "score double, is_target int")).first().auc
    pairs = (x[y == 1][:, None] > x[y == 0][None]).mean() + (x[y == 1][:, None] == x[y == 0][None]).mean()
    assert abs(got - pairs) < 1e-9
    losses, n = np.unique(np.round(rng.beta(2, 8, 5000), 4), return_counts=True)
    h = spark.createDataFrame([(float(a), int(b)) for a, b in zip(losses, n, strict=True)], "loss double, n long")
    assert abs(dro_worst_case(h, 0.4).first().worst - worst_case(losses, n.astype(float), 0.4)) < 1e-3
    assert dro_worst_case(h.where("false"), 0.4).first().worst is None
