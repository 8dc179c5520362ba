"""A layout of closed days that address ranges can prune: a space-filling key over time, source and destination.

Files sorted by time have every address in every row group. Here the three columns are cut into slices of about equal rows
and a row's three slice numbers are interleaved bit by bit (Z order). Rows are dealt over files and sorted by that key, so a
row group covers a narrow box in all three columns and its minima and maxima rule it out for ranges that miss the box.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a slice number; slices of one column are 2 to this power.
BITS = 8
#: Rows looked at to place the bounds of slices. They only shape the layout, never what is stored or found.
SAMPLED_ROWS = 100_000
COLUMNS = ("timestamp", "src_ip_key", "dst_ip_key")


@dataclass(frozen=True)
class Slices:
    """For each column the sorted lower bounds of its slices but the first, as hex text or epoch microseconds."""

    bounds: dict[str, list]


def _plain(column: str) -> Column:
    """Values whose order is that of the column and that travel as plain numbers or text."""
    return F.unix_micros(column) if column == "timestamp" else F.hex(column)


def sampled_slices(rows: DataFrame, bits: int = BITS, seed: int = 1) -> Slices:
    """Bounds that cut a sample of the rows into slices of equal size; a frequent value is the bound of several slices."""
    total = rows.count()
    share = min(1.0, SAMPLED_ROWS / total) if total else 1.0
    sample = rows.select(*[_plain(c).alias(c) for c in COLUMNS]).sample(share, seed).collect()
    bounds = {}
    for c in COLUMNS:
        values = sorted(r[c] for r in sample if r[c] is not None)
        bounds[c] = [values[len(values) * i >> bits] for i in range(1, 1 << bits)] if values else []
    return Slices(bounds)


def _count(value: Column, bounds: list, met: Callable[[Column, Column], Column]) -> Column:
    """How many sorted bounds meet a value, found in two steps: among every sixteenth, then among the sixteen."""
    groups = [bounds[i : i + 16] for i in range(0, len(bounds), 16)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(heads, lambda b: met(b, value)))
    inner = F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * 16 + F.size(F.filter(inner, lambda b: met(b, value))))


def slice_number(value: Column, bounds: list, spread: Column) -> Column:
    """The slice of a value: how many bounds are at or below it. A value that is the bound of several slices takes one of
    them by `spread`, so that its rows do not crowd one slice; null is in the first."""
    if not bounds:
        return F.lit(0)
    below, upto = _count(value, bounds, lambda b, v: b < v), _count(value, bounds, lambda b, v: b <= v)
    several = below + 1 + F.pmod(spread, F.greatest(upto - below, F.lit(1))).cast("int")
    return F.when(value.isNull(), 0).when(upto > below, several).otherwise(below)


def z_key(slices: Slices, bits: int = BITS) -> Column:
    """The interleaved bits of the three slice numbers, as a long."""
    spread = [F.xxhash64(F.lit(c), *[o for o in COLUMNS if o != c]) for c in COLUMNS]
    numbers = [slice_number(_plain(c), slices.bounds[c], s).cast("long") for c, s in zip(COLUMNS, spread, strict=True)]
    joined = F.lit(0).cast("long")
    for bit in range(bits):
        for place, number in enumerate(numbers):
            taken = F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("long"))
            joined = joined.bitwiseOR(F.shiftleft(taken, bit * len(COLUMNS) + place))
    return joined


def clustered(rows: DataFrame, slices: Slices | None = None, bits: int = BITS) -> DataFrame:
    """The rows dealt over partitions by ranges of the key and sorted by it within each, ready to be written.

    Range bounds are sampled by Spark and the number of partitions follows the data (adaptive execution merges small ones).
    """
    keyed = rows.withColumn("_z", z_key(slices or sampled_slices(rows, bits), bits))
    return keyed.repartitionByRange("_z", "timestamp", "src_ip_key").sortWithinPartitions("_z", "timestamp", "src_ip_key").drop("_z")
