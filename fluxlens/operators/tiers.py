"""Long spans from few rows: a range of time is covered by the largest rollup cells that fit.

Next to the minute rollup lie an hour and a day rollup with the same columns. A range is cut like in a segment tree: days in
the middle, hours around them, minutes around those, and the detail table for parts of a minute at its bounds. Every moment
lies in exactly one cell, so sums over the cells are sums over the range, whatever its bounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.time import bucket_timestamp
from fluxlens.model import INTERVAL_SECONDS, ROLLUP_KEYS, ROLLUP_METRICS, ROLLUP_SCHEMA
from fluxlens.operators.query import DETAIL, ROLLUP, FlowTables, QueryError, as_utc, check_time_range, flow_query, time_filter

#: Cells from large to small.
TIERS = ("day", "hour", "minute")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class TieredTables:
    """The detail table and rollups by cell size; without one, its cells are covered by the next smaller."""

    detail: DataFrame
    minute: DataFrame
    hour: DataFrame | None = None
    day: DataFrame | None = None


def build_tier(rollup: DataFrame, interval: str) -> DataFrame:
    """A rollup of larger cells from one of smaller cells; ``ts_minute`` is the start of the cell."""
    if interval not in TIERS:
        raise QueryError(f"no rollup has cells of {interval!r} ({', '.join(TIERS)})")
    return (
        rollup.groupBy(bucket_timestamp(F.col("ts_minute"), interval).alias("ts_minute"), *ROLLUP_KEYS[1:])
        .agg(*[F.sum(m).alias(m) for m in ROLLUP_METRICS])
        .select(*ROLLUP_SCHEMA.fieldNames())
    )


def cover(time_from: datetime, time_to: datetime, tiers: tuple[str, ...] = TIERS) -> list[tuple[str, datetime, datetime]]:
    """The range as (cell size, from, to) in order of time, the largest cells in the middle; parts of a minute are detail."""
    start, end = as_utc(time_from), as_utc(time_to)
    if start >= end:
        return []
    if not tiers:
        return [(DETAIL, start, end)]
    cell = timedelta(seconds=INTERVAL_SECONDS[tiers[0]])
    first, last = _EPOCH - (_EPOCH - start) // cell * cell, _EPOCH + (end - _EPOCH) // cell * cell
    if first >= last:
        return cover(start, end, tiers[1:])
    return [*cover(start, first, tiers[1:]), (tiers[0], first, last), *cover(last, end, tiers[1:])]


def tiered_rows(tables: TieredTables, time_from: datetime, time_to: datetime, largest: str | None = None) -> DataFrame:
    """Rollup rows that together hold the range exactly once, from cells no larger than ``largest``."""
    usable = TIERS[TIERS.index(largest) :] if largest else TIERS
    usable = tuple(t for t in usable if getattr(tables, t) is not None)
    parts = []
    for size, start, end in cover(time_from, time_to, usable):
        if size == DETAIL:
            single = time_filter(tables.detail, "timestamp", start, end)
            rows = single.withColumns({"ts_minute": F.col("timestamp"), "flows": F.lit(1).cast("long")})
        else:
            rows = time_filter(getattr(tables, size), "ts_minute", start, end)
        parts.append(rows.select(*ROLLUP_SCHEMA.fieldNames()))
    return reduce(DataFrame.unionByName, parts)


def tiered_query(tables: TieredTables, *, time_from: datetime, time_to: datetime, interval: str | None = None, **question) -> DataFrame:
    """As ``flow_query`` on rollup dimensions and metrics, for any bounds, reading the fewest cells."""
    check_time_range(time_from, time_to)
    rows = tiered_rows(tables, time_from, time_to, interval)
    return flow_query(FlowTables(tables.detail, rows), time_from=time_from, time_to=time_to, interval=interval, table=ROLLUP, **question)
