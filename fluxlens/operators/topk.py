"""Exact top lists over very many keys without shuffling every key.

Keys are dealt over a fixed number of cells by hash. A cell's sum is a bound for each of its keys, as the metrics are never
negative, and takes one long per cell and task to find. The keys of the heaviest cells are summed exactly; the k-th of them
is a level that the whole list must reach, so only cells with at least that sum can hold further members. Keys of all other
cells are filtered out before they are grouped. Ties at the level stay in, so the answer never differs from a full sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.ip import render_ip
from fluxlens.model import DEFAULT_METRICS, DIMENSIONS, IP_FIELDS
from fluxlens.operators.filters import QueryError, check_filter
from fluxlens.operators.query import DETAIL, FlowTables, check_limit, check_time_range, metric_column, table_rows

#: Cells that keys are dealt over: the most rows that a task of the first pass sends, and the most that is broadcast.
CELLS = 1 << 16
#: Cells whose keys are summed first, for each asked row.
FIRST_CELLS = 4
ADDITIVE = ("bytes", "packets", "flows", "observed_bytes", "observed_packets")


def cell_of(keys: Sequence[str], cells: int = CELLS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(cells)).cast("int")


def level_to_reach(rows: DataFrame, keys: Sequence[str], amount: Column, limit: int, cells: int = CELLS) -> tuple[list[int], DataFrame] | None:
    """The cells that may hold one of the `limit` keys with the largest sums, and their rows; None when all may.

    At most `cells` numbers come to the driver, whatever the number of keys.
    """
    dealt = rows.withColumns({"_cell": cell_of(keys, cells), "_amount": F.coalesce(amount.cast("long"), F.lit(0).cast("long"))})
    sums = [tuple(r) for r in dealt.groupBy("_cell").agg(F.sum("_amount"), F.min("_amount")).collect()]
    if any(least < 0 for _, _, least in sums):
        return None
    sums.sort(key=lambda r: (-r[1], r[0]))
    first = [cell for cell, _, _ in sums[: FIRST_CELLS * limit]]
    heads = dealt.where(F.col("_cell").isin(first)).groupBy(*keys).agg(F.sum("_amount").alias("_sum"))
    found = [r[0] for r in heads.select("_sum").orderBy(F.col("_sum").desc()).limit(limit).collect()]
    if len(found) < limit:
        return None
    wanted = [cell for cell, total, _ in sums if total >= found[-1]]
    if len(wanted) == len(sums):
        return None
    chosen = rows.sparkSession.createDataFrame([(c,) for c in wanted], "_cell int")
    return wanted, dealt.join(F.broadcast(chosen), "_cell", "left_semi").drop("_cell", "_amount")


def top_query(
    tables: FlowTables | DataFrame,
    *,
    time_from: datetime,
    time_to: datetime,
    group_by: Sequence[str],
    limit: int,
    filters: Mapping | None = None,
    metrics: Sequence[str] = (),
    table: str | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """As ``flow_query`` sorted by the first metric, descending, with a limit; for group-bys with very many keys.

    The first metric must be additive (bytes, packets, flows, observed ones). Two small jobs run when the question is
    built; the result is lazy. When nothing can be ruled out, it is the plain plan. Rows are read two or three times.
    """
    tables = FlowTables(tables) if isinstance(tables, DataFrame) else tables
    check_time_range(time_from, time_to)
    limit = check_limit(limit)
    metrics = tuple(metrics) or DEFAULT_METRICS
    if limit is None or not group_by or any(g not in DIMENSIONS for g in group_by):
        raise QueryError("a top list needs a limit and dimensions to group by")
    if metrics[0] not in ADDITIVE:
        raise QueryError(f"a top list cannot be bounded by {metrics[0]!r} ({', '.join(ADDITIVE)})")
    check_filter(filters)
    name, rows, _ = table_rows(tables, table, time_from, time_to, filters, group_by, metrics, None)
    amount = F.lit(1) if metrics[0] == "flows" and name == DETAIL else F.col(metrics[0])
    bounded = level_to_reach(rows, group_by, amount, limit, cells)
    kept = rows if bounded is None else bounded[1]
    result = kept.groupBy(*group_by).agg(*[metric_column(m, name).alias(m) for m in metrics])
    for ip in IP_FIELDS:
        if ip in group_by:
            result = result.withColumn(ip, render_ip(F.col(ip)))
    order = [F.col(metrics[0]).desc(), *[F.col(g).asc() for g in group_by]]
    return result.orderBy(*order).limit(limit).select(*group_by, *metrics)
