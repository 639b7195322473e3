import json

import pytest


def test_corpus_round_trip(spark, tmp_path):
    from certveil.sources.corpora import load_corpus, read_jsonl, write_jsonl

    path = tmp_path / "c.jsonl"
    rows = [
        {"id": "a", "text": "Jo met Al", "gold": [{"start": 0, "end": 2, "type": "first_name"}, {"start": 7, "end": 99, "type": "name"}, {"start": 3, "end": 6, "type": "api_key"}]},
        {"id": "b", "text": "", "gold": []},
    ]
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    docs, gold = load_corpus(spark, "gretel", str(path))
    assert {r.doc_id for r in docs.collect()} == {"a", "b"}
    assert [(r.doc_id, r.type, r.surface) for r in gold.collect()] == [("a", "PERSON", "Jo")]
    write_jsonl(docs.withColumnRenamed("doc_id", "id"), str(tmp_path / "out"))
    assert read_jsonl(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        load_corpus(spark, "nope", str(path))


def test_command_line(spark, tmp_path, capsys):
    """Every command over a small corpus of forms, and the report that it leaves."""
    from conftest import SMALL

    from certveil import cli
    from certveil.plans import fixtures as X
    from pyspark.sql import functions as F

    docs = X.forms(spark, SMALL).withColumn("id", F.col("doc_id").cast("string"))
    gold = X.form_gold(spark, SMALL).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type")).alias("gold"))
    path = str(tmp_path / "forms")
    docs.join(gold, "doc_id").select("id", "text", "gold").coalesce(1).write.json(path)
    flags = ["--path", path, "--alpha", "0.3", "--gamma", "0.3", "--epochs", "40"]
    assert cli.main(["info", "--path", path]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 9
    assert cli.main(["audit", *flags]) == 0 and json.loads(capsys.readouterr().out)["separable"] is False
    assert cli.main(["run", *flags, "--out", str(tmp_path / "out")]) == 0
    assert {json.loads(x)["type"] for x in capsys.readouterr().out.strip().splitlines()} >= {"EMAIL", "IBAN"}
    report = json.loads(spark.read.text(str(tmp_path / "out" / "report")).first().value)
    assert report["certificate"]["verdict"] in ("valid", "void") and report["provenance"]["config"]["alpha"] == 0.3 and report["leakage"] <= 0.3
    (tmp_path / "a.txt").write_text("Mail a.b@c.org now")
    assert cli.main(["redact", "--file", str(tmp_path / "a.txt")]) == 0 and capsys.readouterr().out.strip() == "Mail [EMAIL] now"
    assert cli.main(["calibrate"]) == 2
