"""Relative time ranges and the bucket that suits a span. ``now`` is an argument, so reports can be repeated."""

from __future__ import annotations

from datetime import datetime, timedelta

from fluxlens.operators.filters import QueryError
from fluxlens.operators.query import as_utc, check_time_range

# The ranges on offer.
RELATIVE_RANGES = {
    "15m": timedelta(minutes=15),
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}


def resolve_range(
    choice: str, *, now: datetime, time_from: datetime | None = None, time_to: datetime | None = None
) -> tuple[datetime, datetime]:
    """Absolute half-open range of a relative choice, or the checked bounds of ``custom``."""
    if choice == "custom":
        check_time_range(time_from, time_to)
        return as_utc(time_from), as_utc(time_to)
    if choice not in RELATIVE_RANGES:
        raise QueryError(f"unknown range {choice!r} (available: {', '.join(RELATIVE_RANGES)}, custom)")
    end = as_utc(now)
    return end - RELATIVE_RANGES[choice], end


def interval_for_span(time_from: datetime, time_to: datetime) -> str:
    """Day buckets beyond seven days, hours beyond six hours, else minutes."""
    span = as_utc(time_to) - as_utc(time_from)
    if span > timedelta(days=7):
        return "day"
    return "hour" if span > timedelta(hours=6) else "minute"
