"""Names under which a session calls one's own engines, statistics and monitors."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_engine(spark: SparkSession, name: str, detect: Callable[[str], Iterable[tuple[int, int, str, float]]]) -> None:
    """A table function ``name(text)`` of (start, end, type, match, score) rows from ``detect(text)``, which gives (start, end, type, score)."""

    class Engine:
        def eval(self, text: str):
            for start, end, kind, score in detect(text or ""):
                yield int(start), int(end), kind, (text or "")[start:end], float(score)

    spark.udtf.register(name, F.udtf(Engine, returnType="start int, `end` int, type string, match string, score double"))


def engine_spans(docs: DataFrame, name: str) -> DataFrame:
    """Spans (doc_id, start, end, type, match, score, engine) of a registered engine over ``docs``."""
    rows = docs.sparkSession.sql(f"SELECT d.doc_id, e.* FROM {{docs}} AS d, LATERAL {name}(d.text) AS e", docs=docs.select("doc_id", "text"))
    return rows.withColumn("engine", F.lit(name))


def register_statistic(spark: SparkSession, name: str, statistic: Callable[[pd.Series], float]) -> Callable:
    """An aggregate ``name(x)`` of a group's values, for SQL and as a column function. A group is held whole: use it for reports over bounded groups."""

    @F.pandas_udf("double")
    def value(x: pd.Series) -> float:
        return float(statistic(x))

    spark.udf.register(name, value)
    return value


def alarms() -> dict[str, Callable[..., DataFrame]]:
    """Monitors by name: each takes a stream (series, pos, x), alpha and its own knobs and gives (series, alarm)."""
    from ..operators import monitor

    return {
        "e-process": lambda stream, alpha, delta=0.05: monitor.e_process(stream, alpha, delta).select("series", "alarm"),
        "e-detector": lambda stream, alpha, delta=0.05: monitor.e_detector_alarm(stream, alpha, delta).select("series", "alarm"),
        "cusum": lambda stream, alpha, threshold=5.0: monitor.cusum_alarm(stream, alpha, threshold).select("series", "alarm"),
        "fixed-window": lambda stream, alpha, width=200, z=1.645: monitor.fixed_window_alarm(stream, alpha, width, z).select("series", "alarm"),
    }
