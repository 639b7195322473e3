"""Every registered query of the redaction engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import by_measure, ship

MODULES = ("q_text", "q_risk", "q_monitor", "q_pipeline")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name in MODULES:
        for key, f in import_module(f".{name}", __package__).QUERIES.items():
            out[key] = lambda spark, sf_dir, f=f: f(by_measure(ship(spark)), sf_dir)
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for name in MODULES for k, v in import_module(f".{name}", __package__).SQL.items()}
