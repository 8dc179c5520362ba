"""The stored tables: detail flows by day, rollup by month."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlens.functions.ip import canonical_ip, ip_key
from fluxlens.functions.time import bucket_start, duration_ms, millisecond_precision
from fluxlens.model import (
    DETAIL_RETENTION_DAYS,
    FLOW_SCHEMA,
    ROLLUP_RETENTION_DAYS,
    ROLLUP_SCHEMA,
    STORED_SCHEMA,
    conform,
)
from fluxlens.operators.query import time_filter
from fluxlens.operators.rollup import compact_rollup
from fluxlens.operators.upkeep import retention_cutoff
from fluxlens.sources.layout import clustered

# Host questions look for single addresses inside time-ordered files: min/max statistics cannot skip row groups there,
# Bloom filters can. Adaptive ones take the size that the addresses of a row group need, from 2 KB to 1 MB.
_FILES = {
    "compression": "zstd",
    "parquet.bloom.filter.enabled#src_ip": "true",
    "parquet.bloom.filter.enabled#dst_ip": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.candidates.number#src_ip": "10",
    "parquet.bloom.filter.candidates.number#dst_ip": "10",
}
_STORED_ORDER = ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port")
_FLOW_PARTITION = ["flow_date", "stream", "batch_id"]
_ROLLUP_PARTITION = ["month", "stream", "batch_id"]
#: Names that streams cannot take: writes without a batch number, and merged files.
BATCH_WRITES, MERGED, CLUSTERED = "_batch", "_merged", "_clustered"
_MERGED, _RETIRED = "_compacting", "_retired"
_FLOW_FILES = T.StructType([f for f in STORED_SCHEMA.fields if f.name != "flow_date"])
_ROLLUP_STORED = T.StructType([*ROLLUP_SCHEMA.fields, T.StructField("month", T.IntegerType(), True)])


def stored_form(flows: DataFrame) -> DataFrame:
    """Flows as stored: all columns, canonical addresses (``::`` for text that does not parse, never a failed batch),
    millisecond times, durations from the times, address keys and the partition column."""
    rows = conform(flows, FLOW_SCHEMA)
    rows = rows.withColumns(
        {
            "duration_ms": duration_ms(F.col("timestamp"), F.col("timestamp_end")),
            "src_ip": canonical_ip(F.col("src_ip")),
            "dst_ip": canonical_ip(F.col("dst_ip")),
        }
    )
    return rows.withColumns(
        {
            "timestamp": millisecond_precision(F.col("timestamp")),
            "timestamp_end": millisecond_precision(F.col("timestamp_end")),
            "src_ip_key": ip_key(F.col("src_ip")),
            "dst_ip_key": ip_key(F.col("dst_ip")),
            "flow_date": F.date_from_unix_date(
                F.floor(F.unix_seconds("timestamp") / F.lit(86400)).cast("int")
            ),
        }
    ).select(*STORED_SCHEMA.fieldNames())


def stream_name(stream: str) -> str:
    """A stream's name is part of paths, so it is kept to letters, digits, dots, dashes and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", stream):
        raise ValueError(f"{stream!r} cannot name a stream")
    return stream


def owned(rows: DataFrame, stream: str | None, batch_id: int | None) -> DataFrame:
    """Rows with the partition columns of whoever writes them: every table has the same layout for all writers."""
    if (stream is None) != (batch_id is None):
        raise ValueError("a numbered batch needs the name of its stream, and a stream numbers its batches")
    return rows.withColumns(
        {
            "stream": F.lit(BATCH_WRITES if stream is None else stream if stream in (MERGED, CLUSTERED) else stream_name(stream)),
            "batch_id": F.lit(0 if batch_id is None else int(batch_id)).cast("long"),
        }
    )


def _write(
    rows: DataFrame, path: str, partition: list[str], order: list[str], overwrite: bool, gather: Column | None = None
) -> None:
    """Write rows where they are, each task its own files, sorted. Only merging gathers rows first: an exchange would hold
    them on the executors' disks a second time, in the width of all columns and about three times their size in the files.
    """
    if gather is not None:
        rows = rows.withColumn("_gather", gather).hint("rebalance", "_gather")
    writer = rows.sortWithinPartitions(*partition, *order).drop("_gather").write.partitionBy(*partition).options(**_FILES)
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def append_flows(flows: DataFrame, path: str, stream: str | None = None, batch_id: int | None = None) -> None:
    """Append flows to the detail table.

    Every task writes the rows that it has, sorted by time, to a file for each day; nothing is shuffled for it. So a batch
    needs no more disk than its files. :func:`compact_flows` gathers the files of closed days by hour.
    With ``stream`` and ``batch_id`` the batch owns its own sub-partitions and overwrites them, which makes a repeated
    batch harmless and keeps streams apart. Without them files are added, next to whatever streams write.
    """
    append_stored(stored_form(flows), path, stream, batch_id)


def append_stored(rows: DataFrame, path: str, stream: str | None = None, batch_id: int | None = None) -> None:
    """As :func:`append_flows` for rows that ``stored_form`` has made."""
    _write(owned(rows, stream, batch_id), path, _FLOW_PARTITION, list(_STORED_ORDER), stream is not None)


def read_flows(
    spark: SparkSession, path: str, time_from: datetime | None = None, time_to: datetime | None = None
) -> DataFrame:
    """The detail table, optionally only a time range (whole days outside it are never listed for reading)."""
    rows = spark.read.schema(STORED_SCHEMA).parquet(path).select(*STORED_SCHEMA.fieldNames())
    if time_from is not None and time_to is not None:
        rows = time_filter(rows, "timestamp", time_from, time_to)
    return rows


def write_batch(rows: DataFrame, path: str, stream: str, batch_id: int) -> None:
    """Rows of a micro-batch in a sub-partition of its own, which it overwrites when it is repeated."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream={stream_name(stream)}/batch_id={int(batch_id)}")


def _with_month(rollup: DataFrame) -> DataFrame:
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts_minute") / F.lit(86400)).cast("int"))
    return rollup.withColumn("month", F.year(day) * 100 + F.month(day))


def append_rollup(rollup: DataFrame, path: str, stream: str | None = None, batch_id: int | None = None) -> None:
    """Add partial sums; a numbered batch overwrites its own sub-partitions, so a retry cannot count twice."""
    rows = owned(_with_month(conform(rollup, ROLLUP_SCHEMA)), stream, batch_id)
    _write(rows, path, _ROLLUP_PARTITION, ["ts_minute", "src_ip"], stream is not None)


def write_compacted_rollup(parts: DataFrame, path: str) -> None:
    """Merge rollup parts into ``path``, replacing exactly the months that occur in ``parts``.

    ``path`` must not be where ``parts`` is read from.
    """
    rows = _with_month(compact_rollup(parts))
    (
        rows.withColumn("_day", bucket_start(F.col("ts_minute"), "day"))
        .hint("rebalance", "_day")
        .sortWithinPartitions("month", "ts_minute", "src_ip")
        .drop("_day")
        .write.partitionBy("month")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**_FILES)
        .parquet(path)
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup. Parts are merged lazily, so readers always sum again (as ``flow_query`` does)."""
    return spark.read.schema(_ROLLUP_STORED).parquet(path).select(*_ROLLUP_STORED.fieldNames())


class Folder:
    """A table's folder through Hadoop's file system, wherever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self._new("/".join([self.path, *names]))

    def exists(self, *names: str) -> bool:
        return self.files.exists(self.at(*names))

    def names(self, *names: str) -> list[str]:
        """Names of the folders in a folder, hidden ones left out."""
        if not self.exists(*names):
            return []
        found = (s for s in self.files.listStatus(self.at(*names)) if s.isDirectory())
        return sorted(n for n in (s.getPath().getName() for s in found) if not n.startswith(("_", ".")))

    def delete(self, *names: str) -> None:
        self.files.delete(self.at(*names), True)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        self.files.mkdirs(self.at(*target[:-1]))
        if not self.files.rename(self.at(*source), self.at(*target)):
            raise OSError(f"{'/'.join(source)} could not be moved to {'/'.join(target)}")


def read_batch(spark: SparkSession, path: str, stream: str, batch_id: int) -> DataFrame | None:
    """The flows that a numbered batch of a stream has stored, None if it had none. Other batches are not listed."""
    folder = Folder(spark, path)
    own = (f"stream={stream_name(stream)}", f"batch_id={int(batch_id)}")
    parts = ["/".join([folder.path, top, *own]) for top in folder.names() if folder.exists(top, *own)]
    if not parts:
        return None
    return spark.read.schema(STORED_SCHEMA).option("basePath", folder.path).parquet(*parts).select(*STORED_SCHEMA.fieldNames())


def has_stream(spark: SparkSession, path: str, stream: str) -> bool:
    """Whether a stream of this name has written to the table."""
    folder = Folder(spark, path)
    return any(folder.exists(top, f"stream={stream}") for top in folder.names())


def _writers(folder: Folder, top: str) -> int:
    return sum(len(folder.names(top, s)) for s in folder.names(top))


def _finish_swaps(folder: Folder) -> None:
    """Complete the swaps that a crash has interrupted: a merged partition is in place before the old one goes."""
    for top in folder.names(_MERGED):
        if folder.exists(_MERGED, top, "_SUCCESS"):
            if folder.exists(top) and not folder.exists(_RETIRED, top):
                folder.move((top,), (_RETIRED, top))
            if not folder.exists(top):
                folder.move((_MERGED, top), (top,))
        if folder.exists(_MERGED, top):
            folder.delete(_MERGED, top)
    if folder.exists(_RETIRED):
        folder.delete(_RETIRED)


def _swap_in(folder: Folder, top: str, write: Callable[[str], None]) -> None:
    """Replace one partition by what ``write`` puts into a hidden folder. A crash loses nothing: the next call goes on.

    The old partition is renamed away and the new one in, so for that moment a reader finds neither.
    """
    write("/".join([folder.path, _MERGED, top]))
    _finish_swaps(folder)


def compact_flows(spark: SparkSession, path: str, *, before: date, by_address: bool = False) -> list[str]:
    """Merge the files of every closed day before ``before`` that several batches have written; returns the days.

    A day is closed when no batch will write or repeat rows of it. Rows that come later all the same are added next to
    the merged ones and merged again. The old files of a day go only after the merged ones are complete; readers of that
    day should be stopped for the swap itself, as between its two renames the day has no files.

    With ``by_address`` the merged files follow ``fluxlens.sources.layout``: they can be pruned by address ranges as well
    as by time, which single-batch days need too, so every closed day that is not yet in that layout is rewritten.
    """
    folder = Folder(spark, path)
    _finish_swaps(folder)
    merged = []
    for top in folder.names():
        if not top.startswith("flow_date=") or date.fromisoformat(top.removeprefix("flow_date=")) >= before:
            continue
        if _writers(folder, top) > 1 or (by_address and not folder.exists(top, f"stream={CLUSTERED}")):

            def write(target: str, top: str = top) -> None:
                rows = spark.read.schema(_FLOW_FILES).parquet(f"{folder.path}/{top}").select(*_FLOW_FILES.fieldNames())
                if by_address:
                    whole = clustered(owned(rows, CLUSTERED, 0))
                    whole.write.partitionBy("stream", "batch_id").options(**_FILES).mode("append").parquet(target)
                    return
                hour = bucket_start(F.col("timestamp"), "hour")
                _write(owned(rows, MERGED, 0), target, ["stream", "batch_id"], list(_STORED_ORDER), False, hour)

            _swap_in(folder, top, write)
            merged.append(top)
    return merged


def compact_rollup_months(spark: SparkSession, path: str) -> list[str]:
    """Sum up the parts of every month that has more than one, in place; returns the months.

    Only months with new parts are read. A batch that may still be repeated must not be merged: run it between batches.
    """
    folder = Folder(spark, path)
    _finish_swaps(folder)
    merged = []
    for top in folder.names():
        if top.startswith("month=") and _writers(folder, top) > 1:

            def write(target: str, top: str = top) -> None:
                rows = compact_rollup(spark.read.schema(ROLLUP_SCHEMA).parquet(f"{folder.path}/{top}").select(*ROLLUP_SCHEMA.fieldNames()))
                day = bucket_start(F.col("ts_minute"), "day")
                _write(owned(rows, MERGED, 0), target, ["stream", "batch_id"], ["ts_minute", "src_ip"], False, day)

            _swap_in(folder, top, write)
            merged.append(top)
    return merged


def _drop(spark: SparkSession, path: str, key: str, expired: Callable[[str], bool]) -> list[str]:
    folder = Folder(spark, path)
    dropped = [n for n in folder.names() if n.startswith(f"{key}=") and expired(n.removeprefix(f"{key}="))]
    for name in dropped:
        folder.delete(name)
    return dropped


def drop_expired_days(spark: SparkSession, path: str, *, now: datetime, days: int = DETAIL_RETENTION_DAYS) -> list[str]:
    """Delete the day partitions that lie wholly before the cutoff and return their names.

    Only the folder list is looked at; rows of the cutoff day itself are left to :func:`retain`.
    """
    cutoff = retention_cutoff(days, now).date()
    return _drop(spark, path, "flow_date", lambda day: date.fromisoformat(day) < cutoff)


def drop_expired_months(spark: SparkSession, path: str, *, now: datetime, days: int = ROLLUP_RETENTION_DAYS) -> list[str]:
    """The same for the months of the rollup."""
    cutoff = retention_cutoff(days, now)
    return _drop(spark, path, "month", lambda month: int(month) < cutoff.year * 100 + cutoff.month)
