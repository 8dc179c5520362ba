"""Distinct counts from a rollup: exact bitmaps for ports, sketches for addresses as a named approximation.

Counts cannot be added up, sets can. A port rollup keeps for each bucket of time and group the set of its ports as bitmaps
(two of 32,768 bits at most), so any span and any coarser grouping is answered by merging bitmaps, exactly. Addresses have
no such bound; their HyperLogLog sketches merge as well, but their counts are estimates and are only given under names
that say so.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.time import bucket_timestamp
from fluxlens.operators.query import QueryError, check_time_range, time_filter

PORTS = ("src_port", "dst_port")
ADDRESSES = ("src_ip", "dst_ip")
#: Sketches of 2^12 registers: a relative standard error of about 1.6 percent.
SKETCH_BITS = 12


def build_port_rollup(flows: DataFrame, group_by: Sequence[str], interval: str = "hour", port: str = "dst_port") -> DataFrame:
    """One row for each bucket of time, group and half of the port range: ``ts_bucket, <group>, half, ports`` (a bitmap)."""
    if port not in PORTS:
        raise QueryError(f"{port!r} is no port ({', '.join(PORTS)})")
    number = F.col(port).cast("long")
    return (
        flows.where(number.between(0, 65535))
        .groupBy(bucket_timestamp(F.col("timestamp"), interval).alias("ts_bucket"), *group_by, F.bitmap_bucket_number(number + 1).alias("half"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number + 1)).alias("ports"))
    )


def merge_port_rollup(parts: DataFrame) -> DataFrame:
    """Rows of equal bucket and group (from separate batches) merged into one."""
    return parts.groupBy(*[c for c in parts.columns if c != "ports"]).agg(F.bitmap_or_agg("ports").alias("ports"))


def _aligned(rollup: DataFrame, time_from: datetime, time_to: datetime) -> DataFrame:
    check_time_range(time_from, time_to)
    return time_filter(rollup, "ts_bucket", time_from, time_to)


def uniq_ports(rollup: DataFrame, *, time_from: datetime, time_to: datetime, group_by: Sequence[str] = (), name: str = "uniq_dst_port") -> DataFrame:
    """Exact number of different ports for each group: the rollup's buckets that start in the range, merged and counted.

    ``group_by`` may leave out dimensions of the rollup. Bounds should lie on buckets; a bucket counts by its start.
    """
    halves = _aligned(rollup, time_from, time_to).groupBy(*group_by, "half").agg(F.bitmap_count(F.bitmap_or_agg("ports")).alias("_n"))
    return halves.groupBy(*group_by).agg(F.sum("_n").alias(name))


def build_address_sketches(flows: DataFrame, group_by: Sequence[str], interval: str = "hour", bits: int = SKETCH_BITS) -> DataFrame:
    """One row for each bucket of time and group with a sketch of its source and of its destination addresses."""
    sketches = [F.hll_sketch_agg(F.col(a), F.lit(bits)).alias(f"{a}_sketch") for a in ADDRESSES]
    return flows.groupBy(bucket_timestamp(F.col("timestamp"), interval).alias("ts_bucket"), *group_by).agg(*sketches)


def approx_uniq_addresses(sketches: DataFrame, *, time_from: datetime, time_to: datetime, group_by: Sequence[str] = ()) -> DataFrame:
    """Estimated numbers of different addresses, named ``approx_uniq_*`` because they are estimates."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"{a}_sketch")).alias(f"approx_uniq_{a}") for a in ADDRESSES]
    return _aligned(sketches, time_from, time_to).groupBy(*group_by).agg(*counts)
