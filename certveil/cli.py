"""Command line: info, audit, calibrate, deploy, run and redact over corpora of JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import act, labels, shift, spans
from .plans import pipeline
from .session import by_measure, ship
from .sources.corpora import finite, load_corpus

KNOBS = {"alpha": float, "gamma": float, "delta": float, "engines": str, "beta1": float, "beta2": float, "steps": int, "near": float, "cosine": float, "degree": int, "iou": float, "floor": float, "grid": int, "budget": float, "method": str, "combine": str, "select_by": str, "epochs": int}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="certveil")
    p.add_argument("command", choices=("info", "audit", "calibrate", "deploy", "run", "redact"))
    p.add_argument("--corpus", default="synpii", help="name of the calibration corpus' format")
    p.add_argument("--path", help="JSON lines of the calibration corpus")
    p.add_argument("--target", help="JSON lines of the deployment corpus; without one the corpus is split")
    p.add_argument("--target-corpus", help="format of the deployment corpus")
    p.add_argument("--file", help="redact: a text file to mask by itself")
    p.add_argument("--config", help="file of name: value lines; flags go before it")
    p.add_argument("--share", type=float, default=0.4, help="part of a split corpus that calibrates")
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--unweighted", action="store_true")
    p.add_argument("--key", default="", help="secret of the surrogates; without one spans become their types")
    p.add_argument("--limit", type=int)
    p.add_argument("--out", help="folder for the masked texts, the ledger and the report")
    for name, kind in KNOBS.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=kind, dest=name)
    return p


def _config(a: argparse.Namespace) -> pipeline.Config:
    given = {k: getattr(a, k) for k in KNOBS if getattr(a, k) is not None}
    given |= {"key": a.key.encode()} | ({"weighted": False} if a.unweighted else {})
    return pipeline.load_config(a.config, **given) if a.config else pipeline.Config(**given).validate()


def _print(rows: DataFrame) -> None:
    for row in finite(rows).toJSON().toLocalIterator():
        print(json.dumps(json.loads(row), ensure_ascii=False))


def provenance(spark: SparkSession, a: argparse.Namespace, config: pipeline.Config) -> dict:
    """Where a report comes from: command, inputs, settings (without the key), versions and time."""
    flags = {k: v for k, v in vars(a).items() if k != "key" and v is not None}
    return {"command": a.command, "flags": flags, "config": config.as_dict(), "spark": spark.version, "python": sys.version.split()[0], "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}


def _save(spark: SparkSession, folder: str, name: str, value: dict) -> None:
    """One JSON document in a folder that only Spark may reach."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, allow_nan=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = by_measure(ship(SparkSession.builder.appName("certveil").getOrCreate()))
    config = _config(a)
    if a.command == "redact" and a.file:
        with open(a.file, encoding="utf-8") as f:
            docs = spark.createDataFrame([(0, f.read())], "doc_id long, text string")
        found = spans.ensemble(docs, config.engines, config.types).where(F.col("score") >= config.effective_floor)
        values = act.union_spans(found).join(docs, "doc_id").select("doc_id", "start", "end", "type", F.expr("substring(text, start + 1, `end` - start)").alias("value"))
        edits = act.with_surrogates(values, config.key) if config.key else values.withColumn("replacement", F.concat(F.lit("["), "type", F.lit("]")))
        print(act.rewrite(docs, edits).first().text)
        return 0
    if not a.path:
        print("--path is needed", file=sys.stderr)
        return 2
    docs, gold = load_corpus(spark, a.corpus, a.path)
    if a.limit:
        docs = docs.limit(a.limit)
    if a.command == "info":
        _print(labels.gold_info(docs, gold.join(docs.select("doc_id"), "doc_id", "left_semi")))
        return 0
    if a.target:
        target, found = load_corpus(spark, a.target_corpus or a.corpus, a.target)
    else:
        part = labels.split(docs.select("doc_id", "text", "is_dup"), a.share, seed=a.seed)
        docs, target, found = part.where("part = 'calibration'"), part.where("part = 'test'"), gold
    docs, target = docs.select("doc_id", "text"), target.select("doc_id", "text")
    mine = lambda g, d: g.join(d.select("doc_id"), "doc_id", "left_semi").select("doc_id", "gid", "type", "start", "end")
    if a.command == "audit":
        r = shift.fit_density_ratio(docs, target, epochs=config.epochs)
        _print(spark.createDataFrame([(r.auc, r.overlap, r.rho_hat, r.low, r.high, r.clip_at, r.clipped, r.separable)], "auc double, overlap double, rho_hat double, low double, high double, clip_at double, clipped double, separable boolean"))
        return 0
    certificate, pool = pipeline.calibrate(docs, target, mine(gold, docs), config)
    if a.command == "calibrate":
        print(json.dumps(certificate.to_dict(), ensure_ascii=False))
        return 0 if not certificate.empty else 1
    report = pipeline.deploy(certificate, pool, mine(found, target))
    if a.out:
        report.texts.write.mode("overwrite").json(os.path.join(a.out, "texts"))
        act.write_ledger(report.ledger, os.path.join(a.out, "ledger"))
        _save(spark, a.out, "report", {"certificate": certificate.to_dict(), "provenance": provenance(spark, a, config), "leakage": report.realised_leakage, "overmask": report.realised_overmask, "escalated": report.escalated_fraction})
    _print(report.texts if a.command == "redact" and not a.out else report.summary)
    return 0


if __name__ == "__main__":
    sys.exit(main())
