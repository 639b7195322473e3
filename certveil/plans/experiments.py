"""Runs the experiments' report queries and keeps their rows, tables and a manifest in one folder."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

from ..session import materialised, ship
from ..sources.assets import columns, latex, markdown
from ..sources.corpora import finite
from . import catalogue

NAMES = ("engine_baselines", "exp_main_table", "exp_shift_radius", "alpha_frontier", "exp_ablation", "exp_monitor", "chao_audit", "exp_escalation")


def _text(spark: SparkSession, path: str, value: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_all(spark: SparkSession, sf_dir: str, out: str, names: tuple[str, ...] = NAMES) -> list[dict]:
    """Each report as JSON rows and as Markdown, LaTeX and column tables under ``out``; returns the manifest, which is written last."""
    ship(spark)
    manifest = []
    for name in names:
        start = time.time()
        rows = materialised(catalogue.queries()[name](spark, sf_dir), name)
        finite(rows).coalesce(1).write.mode("overwrite").json(f"{out}/{name}/rows")
        for kind, form in (("md", markdown), ("tex", latex), ("dat", columns)):
            _text(spark, f"{out}/{name}/{kind}", form(rows))
        manifest.append({"name": name, "rows": rows.count(), "columns": rows.columns, "seconds": round(time.time() - start, 3)})
    _text(spark, f"{out}/manifest", json.dumps({"input": sf_dir, "spark": spark.version, "reports": manifest}))
    return manifest
