"""Making this package importable on the executors' Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BYTES = 1000, 64 << 20
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once per application, so that workers need no path of their own.

    Arrow batches of the session are kept to BATCH rows and BYTES bytes from here on: texts are long, and a worker and
    its executor each hold a batch. Smaller settings stay."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    if not 0 < int(re.sub(r"\D+$", "", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) <= BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    if sc.applicationId not in _sent:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="certveil-code-"), "certveil.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(top, "certveil")):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark


def by_measure(spark: SparkSession) -> SparkSession:
    """From here on a side of a join is broadcast by its measured size alone, or where it is marked as small.

    Estimates are made from files before any row is read: they know nothing of explodes or of texts put together from
    short columns, and such a side fills the driver. The limit itself stays and holds for what was shuffled."""
    limit, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if (now := spark.conf.get(limit)) != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, now)
        spark.conf.set(limit, "-1")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one serves on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="certveil-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, where several later steps use it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as there are cores, where a scan has fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


HOT, COLD = 50_000, 256  # keys that are broadcast because many rows have them, at most; rows of a key below which it isn't hot


def split_join(rows: DataFrame, side: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, one row for each of ``keys``, so that no key gathers in one task.

    ``size`` names the column of ``side`` that says how many of the ``total`` rows have the key. Keys of more
    than a HOTth of all rows (and of COLD rows) are HOT at most, so that they are broadcast; the others are shuffled."""
    limit = max(COLD, total // HOT)
    hot = F.broadcast(side.where(F.col(size) > limit))
    many = rows.join(hot, keys)
    few = rows.join(hot.select(keys), keys, "left_anti").join(side.where(F.col(size) <= limit), keys, how)
    return many.unionByName(few.select(many.columns))
