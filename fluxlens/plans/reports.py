"""The boards of the dashboard. Each composes ``flow_query``; top lists have the limit of the board, series have none.

``Scope`` carries what all panels of one screen share: tables, time range and the common filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlens.functions.ip import render_ip
from fluxlens.functions.names import protocol_name
from fluxlens.functions.time import bucket_start
from fluxlens.model import DEFAULT_LIMIT, IP_FIELDS
from fluxlens.operators.filters import QueryError, all_of, check_filter, filter_column
from fluxlens.operators.query import (
    DETAIL,
    FlowTables,
    check_time_range,
    flow_query,
    metric_column,
    table_rows,
    time_filter,
)
from fluxlens.plans.ranges import interval_for_span

TOP_LIMIT = 10
STACK_KEYS = 6
COMPOSITION_LIMIT = 8
CONVERSATION_LIMIT = 40
BOARD_LIMIT = 15


@dataclass(frozen=True)
class Scope:
    tables: FlowTables
    time_from: datetime
    time_to: datetime
    filters: Mapping | None = None

    def query(self, *, filters: Mapping | None = None, **question) -> DataFrame:
        return flow_query(
            self.tables,
            time_from=self.time_from,
            time_to=self.time_to,
            filters=all_of(self.filters, filters),
            **question,
        )


def _over_result():
    """A window over a whole board. Boards have at most a few hundred rows, all in one partition already."""
    return W.partitionBy(F.lit(0))


def kpi_summary(scope: Scope) -> DataFrame:
    """One row of totals from the detail table, and how much of the traffic is estimated rather than measured."""
    metrics = ("bytes", "packets", "flows", "observed_bytes", "uniq_src_ip", "uniq_dst_port")
    totals = scope.query(metrics=metrics, table=DETAIL)
    ratio = F.when(F.col("observed_bytes") > 0, F.col("bytes") / F.col("observed_bytes")).otherwise(F.lit(1.0))
    return totals.withColumn("ratio", ratio)


def top_board(
    scope: Scope,
    dimension: str,
    metric: str = "bytes",
    limit: int = TOP_LIMIT,
    filters: Mapping | None = None,
) -> DataFrame:
    """The largest values of one dimension, with each value's percentage of the largest."""
    top = scope.query(group_by=[dimension], metrics=[metric], limit=limit, filters=filters)
    # As on the board, a maximum of 0 is replaced by 1 before dividing.
    largest = F.max(metric).over(_over_result())
    divisor = F.when(largest == 0, F.lit(1)).otherwise(largest)
    return top.withColumn("pct", F.col(metric).cast("double") / divisor.cast("double") * 100.0)


def traffic_trend(scope: Scope, metric: str = "bytes", interval: str | None = None) -> DataFrame:
    """Total of one metric per time bucket, ascending and never cut."""
    interval = interval or interval_for_span(scope.time_from, scope.time_to)
    return scope.query(metrics=[metric], interval=interval, sort=("ts", False))


def zero_filled_series(rows: DataFrame, keys: DataFrame, value: str = "value", limit: int = STACK_KEYS) -> DataFrame:
    """Series ``(ts, key, value)`` in which every bucket has every key, 0 where ``rows`` has nothing.

    ``keys`` holds at most ``limit`` rows ``(position, key)`` with positions from 1, and a further position fails the
    job; rows of other keys are ignored.
    Each bucket becomes one row with a sum per position (one hash aggregation on the bucket), which is then unfolded:
    no pairing of buckets with keys is needed.
    """
    beyond = F.raise_error(F.format_string(f"position %d is beyond the {limit} series that were asked for", "position"))
    small = F.broadcast(keys.withColumn("position", F.when(F.col("position") <= limit, F.col("position")).otherwise(beyond.cast("int"))))
    placed = rows.join(small, "key")
    sums = [
        F.coalesce(F.sum(F.when(F.col("position") == i, F.col(value))), F.lit(0)).alias(f"v{i}")
        for i in range(1, limit + 1)
    ]
    wide = placed.groupBy("ts").agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"v{i}").alias(value)) for i in range(1, limit + 1)])
    return (
        wide.select("ts", F.explode(cells).alias("cell"))
        .select("ts", "cell.position", f"cell.{value}")
        .join(small, "position")
        .select("ts", "key", value, "position")
    )


def stacked_trend(
    scope: Scope,
    dimension: str,
    metric: str = "bytes",
    interval: str | None = None,
    keys: int = STACK_KEYS,
    filters: Mapping | None = None,
) -> DataFrame:
    """Time series of the top values of a dimension, zero-filled: ``ts, <dimension>, <metric>``.

    The top values are found first and restrict the series by a broadcast join of at most ``keys`` rows, inside one
    lazy plan: neither step comes back to the driver.
    """
    if metric.startswith("uniq_"):
        raise QueryError("distinct counts cannot be stacked")
    interval = interval or interval_for_span(scope.time_from, scope.time_to)
    order = W.partitionBy(F.lit(0)).orderBy(F.col(metric).desc(), F.col(dimension))
    top = scope.query(group_by=[dimension], metrics=[metric], limit=keys, filters=filters).select(
        F.col(dimension).alias("key"), F.row_number().over(order).alias("position")
    )
    tree = all_of(scope.filters, filters)
    table, rows, moment = table_rows(scope.tables, None, scope.time_from, scope.time_to, tree, [dimension], [metric], interval)
    shown = render_ip(F.col(dimension)) if dimension in IP_FIELDS else F.col(dimension)
    amount = F.lit(1).cast("long") if metric == "flows" and table == DETAIL else F.col(metric)
    series = rows.select(bucket_start(F.col(moment), interval).alias("ts"), shown.alias("key"), amount.alias("value"))
    filled = zero_filled_series(series, top, limit=keys)
    return filled.orderBy("ts", "position").select(
        "ts", F.col("key").alias(dimension), F.col("value").alias(metric)
    )


def pivot_series(series: DataFrame, dimension: str, metric: str, values: Sequence) -> DataFrame:
    """A zero-filled series with one column per given value, in that order."""
    return series.groupBy("ts").pivot(dimension, list(values)).agg(F.sum(metric)).na.fill(0).orderBy("ts")


def composition(scope: Scope, dimension: str, metric: str = "bytes") -> DataFrame:
    """The top eight values of a dimension and their share (in percent) of the total shown."""
    top = scope.query(group_by=[dimension], metrics=[metric], limit=COMPOSITION_LIMIT)
    total = F.sum(metric).over(_over_result())
    share = F.when(total > 0, F.col(metric).cast("double") / total.cast("double") * 100.0).otherwise(F.lit(0.0))
    result = top.withColumn("share", share)
    if dimension == "protocol":
        result = result.withColumn("label", protocol_name(F.col("protocol"), "display"))
    return result


def conversations(scope: Scope, limit: int = CONVERSATION_LIMIT) -> DataFrame:
    """Pairs of hosts with their bytes, packets and flows."""
    return scope.query(group_by=["src_ip", "dst_ip"], metrics=["bytes", "packets", "flows"], limit=limit)


def host_drilldown(
    scope: Scope, host: str, side: str = "src_ip", metric: str = "bytes", limit: int = TOP_LIMIT
) -> DataFrame:
    """What one host's traffic consists of: six top lists as rows ``panel, key, <metric>, position``.

    One pass over the host's flows: grouping sets give all six lists from a single scan and shuffle, and the ranking
    keeps ``limit`` rows per list already before its own shuffle.
    """
    if side not in IP_FIELDS:
        raise QueryError(f"a host is a src_ip or a dst_ip, not {side!r}")
    if metric.startswith("uniq_"):
        raise QueryError("host drill-down lists sums, not distinct counts")
    other = "dst" if side == "src_ip" else "src"
    panels = {
        "peer": f"{other}_ip",
        "port": "dst_port",
        "application": "application",
        "peer_country": f"{other}_country",
        "peer_asn": f"{other}_asn",
        "protocol": "protocol",
    }
    tree = all_of(scope.filters, {"field": side, "operator": "eq", "value": host})
    check_time_range(scope.time_from, scope.time_to)
    check_filter(tree)
    detail = scope.tables.detail
    rows = time_filter(detail, "timestamp", scope.time_from, scope.time_to)
    rows = rows.where(filter_column(tree, detail.columns))
    columns = list(panels.values())
    totals = rows.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        metric_column(metric, DETAIL).alias(metric), F.grouping_id().alias("_set")
    )
    # Grouping id: one bit per column, the first column highest, 0 for the column that is grouped.
    everything = 2 ** len(columns) - 1
    panel, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for position, (name, column) in enumerate(panels.items()):
        here = F.col("_set") == everything - 2 ** (len(columns) - 1 - position)
        text = render_ip(F.col(column)) if column in IP_FIELDS else F.col(column).cast("string")
        panel = F.when(here, F.lit(name)).otherwise(panel)
        key = F.when(here, text).otherwise(key)
    listed = totals.select(panel.alias("panel"), key.alias("key"), metric)
    rank = F.row_number().over(W.partitionBy("panel").orderBy(F.col(metric).desc(), "key"))
    return listed.withColumn("position", rank).where(F.col("position") <= limit)


def country_map(scope: Scope, field: str = "src_country", metric: str = "bytes") -> DataFrame:
    """Traffic of two-letter countries with the logarithm that colours the map."""
    countries = scope.query(group_by=[field], metrics=[metric])
    return countries.where(F.char_length(field) == 2).withColumn("log_value", F.log10(F.col(metric) + 1))


def geo_boards(scope: Scope, metric: str = "bytes", city_available: bool = True) -> dict[str, DataFrame]:
    """The boards of the geography screen by dimension; cities only where a city table filled them."""
    dimensions = ["src_country", "dst_country", "src_asn", "src_org"] + (["src_city"] if city_available else [])
    return {d: top_board(scope, d, metric, BOARD_LIMIT) for d in dimensions}


def explorer(
    scope: Scope,
    conditions: Sequence[Mapping] = (),
    logic: str = "AND",
    group_by: str = "src_ip",
    metric: str = "bytes",
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """Free combination: any list of conditions joined by AND or OR, one dimension, one metric."""
    if not conditions:
        tree = None
    elif len(conditions) == 1:
        tree = conditions[0]
    else:
        tree = {"op": logic, "conditions": list(conditions)}
    return scope.query(filters=tree, group_by=[group_by], metrics=[metric], limit=limit)
