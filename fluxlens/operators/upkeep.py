"""Dimension upkeep, retention and table profile."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.time import unix_seconds
from fluxlens.model import DETAIL_RETENTION_DAYS
from fluxlens.operators.query import as_utc, time_filter

_END_OF_TIME = datetime(9999, 1, 1)


def latest_per_key(rows: DataFrame, key: str = "ip", version: str = "updated_at") -> DataFrame:
    """The newest row of each key; equal versions keep the row with the highest remaining values.

    A maximum per key, not a window: partial maxima are taken before the shuffle, so one key that holds a third of all
    rows sends one candidate per upstream partition instead of gathering in one task.
    """
    rest = [c for c in rows.columns if c not in (key, version)]
    newest = F.max(F.struct(version, *rest)).alias("newest")
    return rows.groupBy(key).agg(newest).select(key, "newest.*").select(*rows.columns)


def retention_cutoff(days: int, now: datetime) -> datetime:
    if days <= 0:
        raise ValueError("retention days must be positive")
    return as_utc(now) - timedelta(days=days)


def retain(
    df: DataFrame, *, now: datetime, days: int = DETAIL_RETENTION_DAYS, time_column: str = "timestamp"
) -> DataFrame:
    """Rows younger than ``days``; expired partitions are not read at all."""
    return time_filter(df, time_column, retention_cutoff(days, now), _END_OF_TIME)


def table_profile(flows: DataFrame) -> DataFrame:
    """One row: number of flows, oldest and newest unix second (NULL when the table has no rows)."""
    return flows.agg(
        F.count(F.lit(1)).alias("rows"),
        unix_seconds(F.min("timestamp")).alias("oldest"),
        unix_seconds(F.max("timestamp")).alias("newest"),
    )
