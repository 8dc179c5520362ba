"""A rollup of closed minutes that late flows correct.

A stream remembers the newest event time that it has seen; minutes that ended longer than the lateness before it are closed.
Flows of closed minutes are late: they are kept in a table of their own and their sums are added as corrections, so the
rollup of a shuffled input is that of a sorted one, and what changed after the fact can be seen.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluxlens.functions.time import bucket_timestamp
from fluxlens.operators.rollup import build_rollup_1m
from fluxlens.sources.tables import append_rollup, stored_form, write_batch
from fluxlens.streaming.ingest import check_identity, start

LATE_SUFFIX = "-late"


def _mark(spark: SparkSession, path: str, stream: str, batch_id: int):
    """The newest event time of all batches before this one; None before the first. One row."""
    return None if batch_id == 0 else spark.read.parquet(f"{path}/stream={stream}/batch_id={batch_id - 1}").first()[0]


def split_late(rows: DataFrame, newest, lateness: timedelta) -> tuple[DataFrame, DataFrame]:
    """(in time, late): a flow is late when its minute ended at or before the newest time seen before, less the lateness."""
    if newest is None:
        return rows, rows.limit(0)
    ends = bucket_timestamp(F.col("timestamp"), "minute") + F.expr("INTERVAL 1 MINUTE")
    late = F.coalesce(ends <= F.lit(newest - lateness), F.lit(False))
    return rows.where(~late), rows.where(late)


def start_corrected_rollup(
    flows: DataFrame,
    path: str,
    late_path: str,
    marks_path: str,
    checkpoint: str,
    *,
    stream: str,
    lateness: timedelta = timedelta(minutes=1),
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Minute sums of a stream, late flows next to them, and their sums as corrections.

    In the rollup, corrections are the parts of the stream named ``<stream>-late``; readers sum all parts as always. What a
    batch writes follows from its rows and the mark of the batch before, and overwrites itself when it is repeated.
    """
    check_identity(flows.sparkSession, path, checkpoint, stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stored_form(enrich(batch) if enrich else batch).persist()
        try:
            newest = _mark(spark, marks_path, stream, batch_id)
            in_time, late = split_late(rows, newest, lateness)
            append_rollup(build_rollup_1m(in_time), path, stream, batch_id)
            write_batch(late, late_path, stream, batch_id)
            append_rollup(build_rollup_1m(late), path, stream + LATE_SUFFIX, batch_id)
            write_batch(rows.agg(F.greatest(F.max("timestamp"), F.lit(newest).cast("timestamp")).alias("newest")), marks_path, stream, batch_id)
        finally:
            rows.unpersist()

    return start(flows, write, checkpoint, stream, available_now)
