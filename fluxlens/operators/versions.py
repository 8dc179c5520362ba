"""Range tables that change: lookups by address and by the version that was valid at a flow's time.

Each version of a range table gets an address space of its own (its number in the bits above an address), so one index holds
all versions and the lookup is the same equi-join on buckets. The version of a flow follows from its time by comparison with
the versions' starts, of which there are as many as loads of the table, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.ip import any_ipv4_number
from fluxlens.operators.enrich import ASN_VALUES, MAX_BROADCAST_BYTES, RangeIndex, build_range_index, lookup_ranges
from fluxlens.operators.query import as_utc

#: Bits below a version's number: an address, and one more so that ranges of versions never touch.
SPACE_BITS = 33
MAX_VERSIONS = 4096


@dataclass(frozen=True)
class VersionedIndex:
    """One index over all versions, and when each of them begins to hold (sorted)."""

    index: RangeIndex
    starts: tuple[datetime, ...]


def build_versioned_index(
    ranges: DataFrame, values: tuple[str, ...] = ASN_VALUES, valid_from: str = "valid_from", max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> VersionedIndex:
    """Prepare ranges that carry the time from which their version holds; a version holds until the next one begins.

    A version is a whole table, not a change to the one before. Ranges without a time belong to no version.
    """
    found = ranges.where(F.col(valid_from).isNotNull()).select(valid_from).distinct().limit(MAX_VERSIONS + 1).collect()
    if len(found) > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} versions: keep those that are still asked for")
    starts = tuple(sorted(as_utc(r[0].astimezone()) for r in found))
    offset = F.shiftleft(_version(F.col(valid_from), starts), SPACE_BITS)
    placed = ranges.where(F.col(valid_from).isNotNull()).select((F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"), *values)
    return VersionedIndex(build_range_index(placed, values, max_broadcast_bytes, spaces=max(1, len(starts))), starts)


def _version(moment: Column, starts: Sequence[datetime]) -> Column:
    """The number, from 1, of the last version that began at or before a moment; 0 before the first."""
    if not starts:
        return F.lit(0).cast("long")
    return F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= moment)).cast("long")


def lookup_as_of(df: DataFrame, address: Column, moment: Column, versioned: VersionedIndex, names: dict[str, str]) -> DataFrame:
    """Append the values that held for an address at a moment; misses and moments before the first version give ``''`` or 0."""
    version = F.coalesce(_version(moment, versioned.starts), F.lit(0).cast("long"))
    placed = F.when(version > 0, address + F.shiftleft(version, SPACE_BITS))
    return lookup_ranges(df, placed, versioned.index, names)


def enrich_asn_as_of(flows: DataFrame, versioned: VersionedIndex, moment: Column | None = None) -> DataFrame:
    """Fill ``src_/dst_`` asn, country and org by the version of the flow's time, or of a fixed moment to enrich anew as of a date."""
    columns = flows.columns
    at = F.col("timestamp") if moment is None else moment
    for side in ("src", "dst"):
        names = {value: f"{side}_{value}" for value in ASN_VALUES}
        flows = lookup_as_of(flows, any_ipv4_number(F.col(f"{side}_ip")), at, versioned, names)
    return flows.select(*columns, *[c for c in flows.columns if c not in columns])
