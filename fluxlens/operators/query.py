"""The declarative flow question: time range, filter, group-by, metrics, time bucket, sort, limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.ip import render_ip
from fluxlens.functions.time import bucket_start, unix_seconds
from fluxlens.model import (
    DEFAULT_METRICS,
    DIMENSIONS,
    INTERVAL_SECONDS,
    IP_FIELDS,
    MAX_LIMIT,
    MAX_SPAN_DAYS,
    METRICS,
    ROLLUP_DIMENSIONS,
    ROLLUP_METRICS,
    ROLLUP_SCHEMA,
    ROLLUP_SPAN_DAYS,
)
from fluxlens.operators.filters import QueryError, check_filter, filter_column, filter_fields

DETAIL, ROLLUP = "flows", "flows_1m"


@dataclass(frozen=True)
class FlowTables:
    """The detail table and, when there is one, its minute rollup."""

    detail: DataFrame
    rollup: DataFrame | None = None


def as_utc(moment: datetime) -> datetime:
    """Naive moments are taken as UTC."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def time_filter(df: DataFrame, column: str, time_from: datetime, time_to: datetime) -> DataFrame:
    """Half-open time range, plus the predicate on the partition column that lets Spark skip whole days.

    Spark does not derive ``flow_date`` or ``month`` from a predicate on the timestamp, so it is spelled out.
    """
    start, end = as_utc(time_from), as_utc(time_to)
    moment = F.col(column)
    condition = (moment >= F.lit(start)) & (moment < F.lit(end))
    last = end - timedelta(microseconds=1)
    if "flow_date" in df.columns:
        condition &= F.col("flow_date").between(F.lit(start.date()), F.lit(last.date()))
    if "month" in df.columns:
        condition &= F.col("month").between(start.year * 100 + start.month, last.year * 100 + last.month)
    return df.where(condition)


def check_time_range(time_from: datetime | None, time_to: datetime | None) -> None:
    if time_from is None or time_to is None:
        raise QueryError("a time range (from and to) is required: without it the whole history would be read")
    start, end = as_utc(time_from), as_utc(time_to)
    if end <= start:
        raise QueryError(f"time range is empty: to ({end.isoformat()}) must come after from ({start.isoformat()})")
    if end - start > timedelta(days=MAX_SPAN_DAYS):
        raise QueryError(f"time range of {(end - start).days} days exceeds {MAX_SPAN_DAYS} days")


def check_limit(limit: int | None) -> int | None:
    """None asks for all rows; a limit is a top list and must not exceed the largest one."""
    if limit is None:
        return None
    if limit <= 0:
        raise QueryError(f"limit {limit} is not positive; leave it out for all rows")
    if limit > MAX_LIMIT:
        raise QueryError(f"limit {limit} exceeds {MAX_LIMIT}; leave it out for all rows")
    return int(limit)


def _limited(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def metric_column(name: str, table: str) -> Column:
    """Aggregate of one metric; no rows give 0."""
    if name == "flows":
        return F.count(F.lit(1)) if table == DETAIL else F.coalesce(F.sum("flows"), F.lit(0).cast("long"))
    if name.startswith("uniq_"):
        return F.count_distinct(F.col(name.removeprefix("uniq_")))
    return F.coalesce(F.sum(name), F.lit(0).cast("long"))


def first_missing_in_rollup(group_by: Sequence[str], filters: Mapping | None, metrics: Sequence[str]) -> str | None:
    """First dimension, filter field or metric that the rollup does not have."""
    for name in [*group_by, *filter_fields(filters)]:
        if name not in ROLLUP_DIMENSIONS:
            return name
    return next((m for m in metrics if m not in ROLLUP_METRICS), None)


def choose_table(
    time_from: datetime,
    time_to: datetime,
    group_by: Sequence[str] = (),
    filters: Mapping | None = None,
    metrics: Sequence[str] = DEFAULT_METRICS,
    interval: str | None = None,
) -> str:
    """The rollup when it can answer and it pays: a time series, or a span of more than three days."""
    if first_missing_in_rollup(group_by, filters, metrics):
        return DETAIL
    if interval or as_utc(time_to) - as_utc(time_from) > timedelta(days=ROLLUP_SPAN_DAYS):
        return ROLLUP
    return DETAIL


def _filtered(df: DataFrame, filters: Mapping | None) -> DataFrame:
    condition = filter_column(filters, df.columns)
    return df if condition is None else df.where(condition)


def whole_minutes(time_from: datetime, time_to: datetime) -> tuple[datetime, datetime]:
    """The part of a range that consists of whole minutes; empty (start >= end) when there is none."""
    minute = timedelta(minutes=1)
    start, end = as_utc(time_from), as_utc(time_to)
    first = start.replace(second=0, microsecond=0)
    return first if first == start else first + minute, end.replace(second=0, microsecond=0)


def rollup_rows(tables: FlowTables, time_from: datetime, time_to: datetime, filters: Mapping | None) -> DataFrame:
    """Rollup rows of the whole minutes of a range and, at bounds inside a minute, that part from the detail table.

    Summed up, they answer exactly as the detail table does; the detail side reads two minutes at most.
    """
    start, end = as_utc(time_from), as_utc(time_to)
    first, last = whole_minutes(start, end)
    parts = [(start, min(first, end)), (max(last, first, start), end)] if first <= last else [(start, end)]
    rows = None
    if first < last:
        rows = _filtered(time_filter(tables.rollup, "ts_minute", first, last), filters).select(*ROLLUP_SCHEMA.fieldNames())
    for a, b in parts:
        if a < b:
            single = _filtered(time_filter(tables.detail, "timestamp", a, b), filters)
            single = single.withColumns({"ts_minute": F.col("timestamp"), "flows": F.lit(1).cast("long")}).select(*ROLLUP_SCHEMA.fieldNames())
            rows = single if rows is None else rows.unionByName(single)
    return rows


def table_rows(
    tables: FlowTables,
    table: str | None,
    time_from: datetime,
    time_to: datetime,
    filters: Mapping | None,
    group_by: Sequence[str],
    metrics: Sequence[str],
    interval: str | None,
) -> tuple[str, DataFrame, str]:
    """Which table answers, its rows in the range that pass the filter, and their time column.

    The automatic choice never changes an answer. A rollup that is named explicitly is read alone: bounds inside a
    minute then select whole minutes by their start.
    """
    chosen = choose_table(time_from, time_to, group_by, filters, metrics, interval)
    name, source = _resolve_table(tables, table, chosen, first_missing_in_rollup(group_by, filters, metrics))
    if name == ROLLUP and table is None:
        return name, rollup_rows(tables, time_from, time_to, filters), "ts_minute"
    moment = "timestamp" if name == DETAIL else "ts_minute"
    return name, _filtered(time_filter(source, moment, time_from, time_to), filters), moment


def _resolve_table(tables: FlowTables, table: str | None, chosen: str, missing: str | None) -> tuple[str, DataFrame]:
    if table is None:
        table = chosen if tables.rollup is not None else DETAIL
    if table not in (DETAIL, ROLLUP):
        raise QueryError(f"unknown table {table!r} ({DETAIL}, {ROLLUP})")
    if table == DETAIL:
        return table, tables.detail
    if missing:
        raise QueryError(f"{missing!r} is not in the minute rollup; leave out the table or name {DETAIL!r}")
    if tables.rollup is None:
        raise QueryError("there is no minute rollup")
    return table, tables.rollup


def flow_query(
    tables: FlowTables | DataFrame,
    *,
    time_from: datetime,
    time_to: datetime,
    filters: Mapping | None = None,
    group_by: Sequence[str] = (),
    metrics: Sequence[str] = (),
    interval: str | None = None,
    sort: tuple[str, bool] | None = None,
    limit: int | None = None,
    table: str | None = None,
) -> DataFrame:
    """One aggregate question as a lazy DataFrame: ``[ts] + group_by + metrics``.

    ``sort`` is ``(column, descending)``, by default the first metric descending. The grouping columns break ties, so
    a limit always keeps the same rows. Without a limit all rows are returned. Addresses are compared in the canonical
    spelling that stored tables have; bring other frames into it with ``stored_form`` first.
    """
    if isinstance(tables, DataFrame):
        tables = FlowTables(tables)
    check_time_range(time_from, time_to)
    limit = check_limit(limit)
    for name in group_by:
        if name not in DIMENSIONS:
            raise QueryError(f"cannot group by {name!r}")
    metrics = tuple(metrics) or DEFAULT_METRICS
    for name in metrics:
        if name not in METRICS:
            raise QueryError(f"unknown metric {name!r} (available: {', '.join(sorted(METRICS))})")
    if interval and interval not in INTERVAL_SECONDS:
        raise QueryError(f"unknown interval {interval!r} (available: {', '.join(INTERVAL_SECONDS)})")
    outputs = (["ts"] if interval else []) + [*group_by, *metrics]
    if sort and sort[0] not in outputs:
        raise QueryError(f"sort field {sort[0]!r} is neither grouped by nor a metric")
    field, descending = sort or (metrics[0], True)
    check_filter(filters)

    name, rows, moment = table_rows(tables, table, time_from, time_to, filters, group_by, metrics, interval)
    keys = [bucket_start(F.col(moment), interval).alias("ts")] if interval else []
    keys += [F.col(g) for g in group_by]
    result = rows.groupBy(*keys).agg(*[metric_column(m, name).alias(m) for m in metrics])
    if not keys:
        return result
    for ip in IP_FIELDS:
        if ip in group_by:
            result = result.withColumn(ip, render_ip(F.col(ip)))
    order = [F.col(field).desc() if descending else F.col(field).asc()]
    order += [F.col(c).asc() for c in outputs if c not in metrics and c != field]
    return _limited(result.orderBy(*order), limit).select(*outputs)


# Columns of a detail answer, in order.
DETAIL_COLUMNS = (
    "ts",
    "ts_end",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "protocol",
    "bytes",
    "packets",
    "observed_bytes",
    "observed_packets",
    "sampling_rate",
    "tcp_flags",
    "application",
    "src_country",
    "dst_country",
    "src_asn",
    "dst_asn",
    "src_org",
    "dst_org",
    "source_type",
    "device_id",
    "input_interface",
    "vlan",
    "duration_ms",
)


def flow_detail(
    detail: DataFrame,
    *,
    time_from: datetime,
    time_to: datetime,
    filters: Mapping | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Single flows, newest first, all of them without a limit. All output columns break ties, as flows carry no identity of their own."""
    check_time_range(time_from, time_to)
    limit = check_limit(limit)
    check_filter(filters)
    rows = _filtered(time_filter(detail, "timestamp", time_from, time_to), filters)
    derived = {
        "ts": unix_seconds(F.col("timestamp")).alias("ts"),
        "ts_end": unix_seconds(F.col("timestamp_end")).alias("ts_end"),
        "src_ip": render_ip(F.col("src_ip")).alias("src_ip"),
        "dst_ip": render_ip(F.col("dst_ip")).alias("dst_ip"),
    }
    shown = rows.select(F.col("timestamp").alias("_at"), *[derived.get(c, F.col(c)) for c in DETAIL_COLUMNS])
    return _limited(shown.orderBy(F.col("_at").desc(), *DETAIL_COLUMNS), limit).drop("_at")
