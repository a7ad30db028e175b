"""What the training-data operators share: the scratch folder, keyed randomness and schema helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Of one Arrow batch to a Python worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and the master is local (tests on one machine) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_loomwright_scratch", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="loomwright-")
            spark._loomwright_scratch = found
    return found.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; a missing one is fine."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` for Python workers, unless the session asks for less: rows alone don't bound very long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, f"{BATCH_BYTES + 1}b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/loomwright/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwright_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later step reads, so that they do not take disk until the driver ends."""
    for df in tables:
        remove_path(df.sparkSession, df._loomwright_path)


def ascii_lower(column):
    """A-Z lower-cased, all else unchanged."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out evenly; any other input as it is."""
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
