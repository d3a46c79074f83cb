"""Session set-up and the shared folder for tables that several steps read."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Broadcast hints are given only to tables with at most this many narrow rows.
BROADCAST_ROW_BOUND = 20_000

#: Settings of every session that runs these operators.
_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot key is worth one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # batches handed to Python stay small however long the texts are
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ratingloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in _ADAPTIVE.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_adaptive_plans(spark: SparkSession) -> SparkSession:
    """Turn on run-time skew splitting and small Python batches in a session made elsewhere."""
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a fresh temporary folder; on a
    cluster that is an error, since executors do not share local disks.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ratingloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """Put tables stored inside the block into one folder, which :func:`delete_folder` can remove."""
    token = _scratch.set(folder or fresh_path(spark, "scratch"))
    try:
        yield _scratch.get()
    finally:
        _scratch.reset(token)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_unused(spark: SparkSession) -> None:
    """Let the driver drop what finished steps left: cached factors, broadcasts and shuffle files go with their objects.

    Without it they wait for a collection that the JVM needs for itself, and its heap grows until then. One costs
    a fraction of a second, so it is for steps that run many jobs.
    """
    # objects of the JVM are held by those of Python
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{_scratch.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Store ``df`` as a table in the shared folder (a folder per value of ``by``) and read it back.

    Cuts the lineage without executor-local state: a lost executor costs a
    re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
