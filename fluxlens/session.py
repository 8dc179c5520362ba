"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

# Settings the operators rely on for speed, not for results. Shuffle partition counts stay with the cluster: adaptive
# execution coalesces from whatever initial number it configures.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Flows take about ten bytes each in files. Splits of the default 128 MB would give a task more groups to sum up before a
    # shuffle than its memory holds, and their sums would go to disk, sorted, several times their size in the file.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Shuffle files would lie on the executors' disks until the driver happens to collect its garbage. A job that writes
    # several tables, or many micro-batches, would hold those of all that it has done.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode. Decoding stages would generate such methods and then
    # run interpreted; above this limit Spark evaluates them operator by operator, with each method compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the recommended runtime settings on an existing session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


#: The fewest partitions that the state of a stream is dealt over, on however few cores.
LEAST_STATE_PARTITIONS = 8


@contextmanager
def state_per_core(spark: SparkSession) -> Iterator[None]:
    """Streams that first start within deal their state over as many partitions as tasks can run, not over more.

    A stream keeps that number for good, and no adaptive execution merges the partitions: every micro-batch, empty ones too,
    starts a task, loads and commits a store, and with Python state calls a worker for each. It is taken from the session's
    number of shuffle partitions, which is chosen for the shuffles of large jobs; a smaller one is left as it is.
    """
    key = "spark.sql.shuffle.partitions"
    chosen = spark.conf.get(key)
    spark.conf.set(key, str(min(int(chosen), max(spark.sparkContext.defaultParallelism, LEAST_STATE_PARTITIONS))))
    try:
        yield
    finally:
        spark.conf.set(key, chosen)


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a plain local master, where tasks run in this very process, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
