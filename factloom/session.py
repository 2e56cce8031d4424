"""Session settings and the one place where a plan is materialised."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the operators count on: skewed join keys are split by AQE even when
# that costs an extra exchange, and timestamps are read as UTC.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# What one task reads at most, from files or from a shuffle whose partitions are merged. A row of a file becomes
# several triples and links, so Spark's own sizes let the memory of one task grow with the input.
TASK_BYTES = 16 * 2**20
TASK_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
# A shuffled join whose smaller side has no partition above this many bytes hashes that side instead of sorting both.
HASHED_BYTES = 2 * TASK_BYTES
HASHED_SIZE = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key in TASK_SIZES:  # smaller ones of the session stay
        if as_bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, f"{TASK_BYTES}b")
    return spark


def hash_small_sides(spark: SparkSession) -> SparkSession:
    spark.conf.set(HASHED_SIZE, f"{HASHED_BYTES}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is absent and the master is local.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    Work used several times is done once, readers fetch only the columns they need, and no
    executor loss can recompute it differently.
    """
    path = f"{shared_dir(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_finished(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished work, which it does once the driver's garbage is collected.

    A loop of many small jobs makes little garbage and many such files.
    """
    gc.collect()
    spark._jvm.System.gc()


BROADCAST_BYTES = 64 * 2**20


def stored_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast_if_small`` of a table that is first stored, so that counting it does not make it twice."""
    return broadcast_if_small(pin(df), row_bytes, limit)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table only after counting that it fits; otherwise the planner joins by shuffle."""
    rows = limit // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
