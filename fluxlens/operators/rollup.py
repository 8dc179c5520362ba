"""The minute rollup: building, merging and re-summing it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.time import bucket_timestamp
from fluxlens.model import ROLLUP_KEYS, ROLLUP_METRICS, ROLLUP_SCHEMA

_KEYS_AFTER_TIME = ROLLUP_KEYS[1:]


def build_rollup_1m(flows: DataFrame) -> DataFrame:
    """Sums of bytes and packets and the number of flows per minute and the eleven rollup dimensions.

    Ports, cities and organisations are left out on purpose: they would make the rollup as large as the detail table.
    """
    return (
        flows.groupBy(bucket_timestamp(F.col("timestamp"), "minute").alias("ts_minute"), *_KEYS_AFTER_TIME)
        .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count(F.lit(1)).alias("flows"))
        .select(*ROLLUP_SCHEMA.fieldNames())
    )


def compact_rollup(parts: DataFrame) -> DataFrame:
    """Rows with equal keys (from separate ingest batches) summed into one."""
    return (
        parts.groupBy(*ROLLUP_KEYS)
        .agg(*[F.sum(m).alias(m) for m in ROLLUP_METRICS])
        .select(*ROLLUP_SCHEMA.fieldNames())
    )
