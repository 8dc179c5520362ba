"""Time buckets, durations and exporter clocks. Buckets are UTC whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxlens.model import INTERVAL_SECONDS

MAX_DURATION_MS = 2**32 - 1


def unix_seconds(ts: Column) -> Column:
    """Whole unix seconds of a timestamp, the form in which results carry time."""
    return F.unix_seconds(ts)


def bucket_start(ts: Column, interval: str) -> Column:
    """Start of the minute, hour or day as unix seconds."""
    seconds = F.unix_seconds(ts)
    return seconds - F.pmod(seconds, F.lit(INTERVAL_SECONDS[interval]))


def bucket_timestamp(ts: Column, interval: str) -> Column:
    """Start of the minute, hour or day as a timestamp."""
    return F.timestamp_seconds(bucket_start(ts, interval))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end: 0 when the end comes first, held at the unsigned 32-bit maximum."""
    elapsed = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)
    return F.least(F.greatest(elapsed, F.lit(0)), F.lit(MAX_DURATION_MS)).cast("long")


def exporter_time(export_micros: Column, uptime_ms: Column, event_ms: Column) -> Column:
    """Absolute time of an event stamped with the exporter's uptime clock.

    An unset stamp, or one beyond the uptime at export (the 32-bit clock wrapped), falls back to the export time.
    """
    unknown = (event_ms == 0) | (event_ms > uptime_ms)
    return F.timestamp_micros(F.when(unknown, export_micros).otherwise(export_micros - (uptime_ms - event_ms) * 1000))


def millisecond_precision(ts: Column) -> Column:
    """Drop what is finer than a millisecond: the precision of the stored table."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(1000)))
