"""Running sums within groups, spread over tasks whatever the size of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlens.llm.tasks import settled


def running_sum(frame: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """The rows with a new column for each of `values` (new name: summed column): the sum up to and with the row.

    Rows are dealt over tasks by ranges of group and order, so a group that holds most rows lies in as many ranges as its
    size asks for; sums of whole ranges (one row each) tell every range where it starts. Ties are cut anywhere, so equal
    (group, order) rows should be interchangeable; nulls come first in the order, and group columns must not be null.
    """
    ranged = frame.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_tie").drop("_tie")
    blocks = settled(ranged.withColumn("_block", F.spark_partition_id()))
    keys = [*group, "_block"]
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = blocks.groupBy(*keys).agg(*[F.sum(column).alias(f"_{name}") for name, column in values.items()])
    starts = parts.select(*keys, *[F.sum(f"_{name}").over(earlier).alias(f"_{name}") for name in values])
    return (
        blocks.withColumns({name: F.sum(column).over(inside) for name, column in values.items()})
        .join(starts, keys)
        .withColumns({name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) for name in values})
        .drop("_block", *[f"_{name}" for name in values])
    )
