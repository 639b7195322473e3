"""Structured Streaming forms of the stateful operators.

Each ``run_*`` drains a Parquet source once (availableNow) into a table in the shared folder, so the
result can be compared with the batch operator; the plans themselves work on any source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash
from ..session import shared_dir

STATE = "wealth double, peak double, mu double, var double, n long"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over ``path``, a single file or a folder of them: as a pattern it may be either."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    base = _folder(spark)
    batches: list[str] = []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
        batches.append(f"{base}/out/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).parquet(*batches) if batches else spark.createDataFrame([], schema)


def bet(alpha: float, cap: float = 0.5):
    """State update of an e-process: a micro-batch's rows of a series, sorted by pos, move the stored wealth on."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w, peak, mu, var, n = state.get if state.exists else (1.0, 1.0, alpha, 0.25, 0)
        rows = pd.concat(list(parts)).sort_values("pos")
        for x in rows["x"]:
            gap = mu - alpha
            stake = max(0.0, min(cap / alpha, gap / max(var, 1e-4)))
            w = max(1e-300, w * (1 + stake * (x - alpha)))
            peak, n = max(peak, w), n + 1
            new = x if n == 1 else mu + (x - mu) / n
            var = 0.0 if n == 1 else var + ((x - mu) * (x - new) - var) / n
            mu = new
        state.update((float(w), float(peak), float(mu), float(var), int(n)))
        yield pd.DataFrame({"series": [key[0]], "wealth": [w], "peak": [peak], "n": [n]})

    return update


def e_process(stream: DataFrame, alpha: float) -> DataFrame:
    """(series, wealth, peak, n), updated with each micro-batch, from a stream of (series, pos, x)."""
    return stream.groupBy("series").applyInPandasWithState(bet(alpha), "series long, wealth double, peak double, n long", STATE, "update", GroupStateTimeout.NoTimeout)


def losses(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 8).alias("series"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").cast("double").alias("x"))


def run_e_process(spark: SparkSession, path: str, alpha: float) -> DataFrame:
    out = _drain(e_process(losses(_source(spark, path)), alpha), "update")
    return out.groupBy("series").agg(F.max_by("peak", "n").alias("peak"), F.max("n").alias("n"))


def deduplicated(docs: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first document of each canonical content, by its hash. With an event time hashes are kept for ``late`` only, so
    that the state stays bounded on an endless stream; without one they are kept for ever, as for a drained source."""
    hashed = docs.withColumn("content_hash", content_hash(F.col("text")))
    if time is None:
        return hashed.select("doc_id", "content_hash").dropDuplicates(["content_hash"])
    return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"]).select("doc_id", time, "content_hash")


def run_dedup(spark: SparkSession, path: str) -> DataFrame:
    return _drain(deduplicated(_source(spark, path)), "append")


def alarm_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts of events and errors per tumbling (or sliding) window of event time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "errors")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(s.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "user_id", "n")


def run_alarm_windows(spark: SparkSession, path: str) -> DataFrame:
    return _drain(alarm_windows(_source(spark, path)), "complete")


def redact(stream: DataFrame, sink, deploy) -> object:
    """Detects, masks and writes each micro-batch: ``deploy`` is a batch function, as it needs the calibration pool again."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(deploy(batch), epoch))
