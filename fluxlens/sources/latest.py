"""A stored table of the newest row of each key, kept up to date batch by batch.

Keys lie in hash buckets. A batch adds its own newest rows to the buckets that it touches; nothing is read for that. Taking
the newest row is idempotent and has no order, so rows of earlier batches, repeated batches and rows that arrive late never
change an answer: reading takes the newest per key over whatever is there, and merging buckets only makes that cheaper.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluxlens.operators.upkeep import latest_per_key
from fluxlens.sources.tables import MERGED, Folder, owned, stream_name
from fluxlens.streaming.ingest import start

BUCKETS = 64
_PARTITION = ["bucket", "stream", "batch_id"]


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_latest(rows: DataFrame, path: str, stream: str, batch_id: int, key: str = "ip", version: str = "updated_at", buckets: int = BUCKETS) -> None:
    """Add a batch: its newest row of each key, in sub-partitions of its own that a repeated batch overwrites."""
    newest = latest_per_key(rows, key, version).withColumn("bucket", _bucket(F.col(key), buckets))
    writer = owned(newest, stream_name(stream), batch_id).repartition("bucket").write.partitionBy(*_PARTITION)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_latest(spark: SparkSession, path: str, key: str = "ip", version: str = "updated_at", keys: Sequence[object] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The newest row of each key, or of some keys, for which only their buckets are read."""
    rows = spark.read.parquet(path)
    if keys is not None:
        kind = rows.schema[key].dataType
        literals = [F.lit(k).cast(kind) for k in keys]
        wanted = spark.range(1).select(*[_bucket(k, buckets).alias(f"b{i}") for i, k in enumerate(literals)]).first() if keys else ()
        rows = rows.where(F.col("bucket").isin(*set(wanted)) & F.col(key).isin(*literals)) if keys else rows.limit(0)
    return latest_per_key(rows.drop(*_PARTITION), key, version)


def merge_latest(spark: SparkSession, path: str, key: str = "ip", version: str = "updated_at") -> list[str]:
    """Merge every bucket that several batches have written into one part; returns the buckets.

    The merged part stands next to the others before these go, and rows that are there twice change nothing, so a crash or
    a reader at any point sees the right rows. Run it between batches: a batch may not be repeated after its merge.
    """
    folder = Folder(spark, path)
    merged = []
    for top in folder.names():
        parts = [(s, b) for s in folder.names(top) for b in folder.names(top, s)]
        if not top.startswith("bucket=") or len(parts) < 2:
            continue
        number = 1 + max((int(b.removeprefix("batch_id=")) for s, b in parts if s == f"stream={MERGED}"), default=-1)
        columns = [c for c in spark.read.parquet(path).columns if c not in _PARTITION]
        rows = spark.read.parquet(f"{folder.path}/{top}").select(*columns)
        latest_per_key(rows, key, version).write.parquet(f"{folder.path}/{top}/stream={MERGED}/batch_id={number}")
        for s, b in parts:
            folder.delete(top, s, b)
        merged.append(top)
    return merged


def start_latest(rows: DataFrame, path: str, checkpoint: str, *, stream: str, key: str = "ip", version: str = "updated_at", buckets: int = BUCKETS, transform: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = False) -> StreamingQuery:
    """Keep the table from a stream of rows in any order."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(transform(batch) if transform else batch, path, stream, batch_id, key, version, buckets)

    return start(rows, write, checkpoint, stream, available_now)
