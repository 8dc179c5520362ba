"""Address-range lookups: autonomous system, country, organisation, region and city.

Rule of the lookup: take the last range that starts at or before the address, then require that it also ends at or
after it. So an address behind the end of a nested range is a miss even where an outer range would cover it. Ranges are
first cut into disjoint ones that encode this rule, then spread over equal-width address buckets, and crowded buckets
over smaller cells, which turns the lookup into an equi-join that Spark can broadcast or shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlens.functions.ip import any_ipv4_number, ipv4_number
from fluxlens.functions.names import classify_application
from fluxlens.session import work_folder

MAX_BROADCAST_BYTES = 512 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64
SPREAD_KEYS = 1 << 20
_MIN_BUCKET_BITS, _MAX_BUCKET_BITS = 16, 20
#: A bucket of more ranges is cut into 16 cells, and a cell of more than CELL_RANGES again, down to 1/4096 of the bucket.
BUCKET_RANGES, CELL_RANGES = 256, 8
_STEP, _DEPTHS = 4, 3

ASN_VALUES = ("asn", "country", "org")
CITY_VALUES = ("country", "region", "city")


def disjoint_ranges(ranges: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Ranges ``(start, end, *values)`` cut so that each ends before the next one starts.

    Equal starts keep the row with the highest end, then the highest values. The next start is looked up within the
    /16 block of the start, which holds at most 65,536 distinct starts; only the (at most 65,536) first starts of
    blocks are ordered as a whole.
    """
    unique = (
        ranges.groupBy("start")
        .agg(F.max(F.struct("end", *values)).alias("best"))
        .selectExpr("start", "best.*", "shiftright(start, 16) AS block")
    )
    blocks = (
        unique.groupBy("block")
        .agg(F.min("start").alias("first"))
        .selectExpr("block", "lead(first) OVER (ORDER BY block) AS next_block_start")
    )
    next_start = "coalesce(lead(start) OVER (PARTITION BY block ORDER BY start), next_block_start)"
    return (
        unique.join(F.broadcast(blocks), "block")
        .selectExpr("start", f"least(end, {next_start} - 1) AS end", *values)
        .where("start <= end")
    )


@dataclass(frozen=True)
class RangeIndex:
    """Disjoint ranges spread over address buckets of ``2 ** shift`` addresses and, in crowded ones, over smaller cells.

    Each row of ``buckets`` is a range in a cell: the number of its bucket, the ``cell`` as :func:`_cell` writes it, and
    ``at``, where the range begins in it. ``crowded`` names the buckets that are cut and which of their cells are cut
    again; it is None when there are none.
    """

    buckets: DataFrame
    shift: int
    values: tuple[str, ...]
    broadcast: bool
    crowded: DataFrame | None = None


def _cell(address: Column, shift: int, depth: Column) -> Column:
    """The cell of an address at a depth below its bucket, depths told apart by the lowest bits."""
    return F.call_function("shiftright", address, (shift - _STEP * depth).cast("int")) * (_DEPTHS + 1) + depth


def _spread(stored: DataFrame, shift: int) -> DataFrame:
    """Ranges over their buckets, then from crowded cells into the next smaller ones, depth by depth.

    A cell that is cut has several ranges wholly inside, so all cuts together add a bounded number of rows per range.
    Cells lie within their bucket, so every depth counts by one and the same shuffle.
    """
    rows = stored.select(F.explode(F.sequence(F.shiftright("start", shift), F.shiftright("end", shift))).alias("bucket"), "*")
    rows = rows.repartition("bucket").select("*", F.lit(0).alias("depth"), F.col("bucket").alias("_part"))
    for depth in range(_DEPTHS):
        width = shift - _STEP * depth
        first, last = F.shiftleft("_part", width), F.shiftleft(F.col("_part") + 1, width) - 1
        finer = F.sequence(
            F.shiftright(F.greatest("start", first), width - _STEP), F.shiftright(F.least("end", last), width - _STEP)
        )
        held = F.count(F.lit(1)).over(W.partitionBy("bucket", "depth", "_part"))
        rows = rows.withColumn("_cut", (F.col("depth") == depth) & (held > (CELL_RANGES if depth else BUCKET_RANGES)))
        rows = rows.withColumn("_part", F.explode(F.when(F.col("_cut"), finer).otherwise(F.array("_part"))))
        rows = rows.withColumn("depth", F.when(F.col("_cut"), depth + 1).otherwise(F.col("depth"))).drop("_cut")
    begin = F.call_function("shiftleft", F.col("_part"), (shift - _STEP * F.col("depth")).cast("int"))
    cell = F.col("_part") * (_DEPTHS + 1) + F.col("depth")
    return rows.select("bucket", "depth", cell.alias("cell"), F.greatest("start", begin).alias("at"), *stored.columns)


def _crowded(rows: DataFrame, shift: int) -> DataFrame:
    """For each bucket that is cut, how far it is cut in each of its 256 cells of depth 2."""
    one = F.lit(1).cast("long")
    inside = F.col("at") - F.shiftleft("bucket", shift)
    first, second = (F.shiftright(inside, shift - _STEP * d).cast("int") for d in (1, 2))
    again = [F.when((F.col("depth") == 3) & (F.shiftright(second, 6) == q), F.call_function("shiftleft", one, second % 64)).otherwise(0) for q in range(4)]
    bits = (
        rows.where("depth > 0")
        .groupBy("bucket")
        .agg(
            F.bit_or(F.when(F.col("depth") > 1, F.call_function("shiftleft", one, first)).otherwise(0)).alias("first"),
            F.array(*[F.bit_or(a) for a in again]).alias("second"),
        )
    )
    cut = "shiftright(first, shiftright(c, 4)) & 1 = 1"
    cut_again = "shiftright(second[shiftright(c, 6)], c % 64) & 1 = 1"
    depth = f"CASE WHEN {cut} AND {cut_again} THEN 3Y WHEN {cut} THEN 2Y ELSE 1Y END"
    return bits.selectExpr("bucket", f"transform(sequence(0, 255), c -> {depth}) AS depths")


def build_range_index(
    ranges: DataFrame, values: tuple[str, ...] = ASN_VALUES, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, spaces: int = 1
) -> RangeIndex:
    """Prepare a range table for lookups.

    The disjoint ranges are written once to the shared work folder, and so are their rows in the index, because every
    lookup reads them for the source and again for the destination address. About as many buckets as ranges are used, so
    there are at most ``rows + buckets`` rows before crowded buckets are cut. However closely ranges lie, an address is
    compared with at most ``BUCKET_RANGES`` of them. The index is broadcast only when its rows fit
    ``max_broadcast_bytes``. ``spaces`` says how many address spaces of 32 bits the ranges lie in.
    """
    spark = ranges.sparkSession
    path, index, marks = (work_folder(spark, name) for name in ("ranges", "range-index", "range-marks"))
    disjoint_ranges(ranges, values).write.parquet(path)
    stored = spark.read.parquet(path)
    bits = min(max(stored.count().bit_length(), _MIN_BUCKET_BITS), _MAX_BUCKET_BITS)
    shift = 32 - bits
    _spread(stored, shift).write.parquet(index)
    rows = spark.read.parquet(index)
    text = [c for c, kind in rows.select(*values).dtypes if kind == "string"]
    size = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(sum((F.octet_length(c) for c in text), F.lit(0))), F.lit(0)).alias("text_bytes"),
        F.max("depth").alias("depth"),
    ).first()
    crowded = None
    if size["depth"]:
        _crowded(rows, shift).write.parquet(marks)
        crowded = spark.read.parquet(marks)
    index_bytes = size["text_bytes"] + size["rows"] * ROW_OVERHEAD_BYTES
    return RangeIndex(rows.drop("depth"), shift, tuple(values), index_bytes <= max_broadcast_bytes, crowded)


def _found(index: RangeIndex, source: str, names: dict[str, str]) -> list[Column]:
    columns = []
    for value, kind in index.buckets.select(*index.values).dtypes:
        unknown = F.lit("") if kind == "string" else F.lit(0).cast(kind)
        columns.append(F.coalesce(F.col(f"{source}.{value}"), unknown).alias(names[value]))
    return columns


def _no_match(columns: list[str]) -> Column:
    """A negative key, which no bucket or address has, spread by the content of the row."""
    return -1 - F.pmod(F.xxhash64(*columns), F.lit(SPREAD_KEYS))


def _depth(shift: int) -> Column:
    """How far the bucket of ``_address`` is cut there, by the marks of the bucket."""
    second = F.shiftright("_address", shift - 2 * _STEP).bitwiseAND(255).cast("int")
    return F.coalesce(F.get("_depths", second), F.lit(0)).cast("int")


def lookup_ranges(df: DataFrame, address: Column, index: RangeIndex, names: dict[str, str], keep: str | None = None) -> DataFrame:
    """Append the looked-up values under ``names[value]``; misses and NULL addresses give ``''`` or 0.

    With ``keep`` the address is appended under that name, so that later steps need not read it from text again.
    """
    keyed = df.withColumn("_address", address)
    depth = F.lit(0)
    if index.crowded is not None:  # one row for a crowded bucket, so always small beside the index
        marks = F.broadcast(index.crowded.select(F.col("bucket").alias("_crowded"), F.col("depths").alias("_depths")))
        keyed = keyed.join(marks, F.shiftright("_address", index.shift) == F.col("_crowded"), "left")
        depth = _depth(index.shift)
    bucket = _cell(F.col("_address"), index.shift, depth)
    if index.broadcast:
        side = F.broadcast(index.buckets)
    else:
        # Too large to broadcast: a merge join, said explicitly, as Spark's estimate knows nothing of this bound.
        # The flows of one busy network are split by adaptive execution, which measures them; flows without an IPv4
        # address get keys of their own that match nothing, so they do not meet in one partition.
        side = index.buckets.hint("merge")
        bucket = F.coalesce(bucket, _no_match(df.columns))
    keyed = keyed.withColumn("_bucket", bucket)
    side = side.alias("_r")
    on = (F.col("_bucket") == F.col("_r.cell")) & F.col("_address").between(F.col("_r.start"), F.col("_r.end"))
    found = _found(index, "_r", names)
    kept = [F.col(f"_f.{c}") for c in df.columns if c not in set(names.values())]
    kept += [F.col("_f._address").alias(keep)] if keep else []
    return keyed.alias("_f").join(side, on, "left").select(*kept, *found)


def lookup_ranges_as_of(df: DataFrame, address: Column, index: RangeIndex, names: dict[str, str]) -> DataFrame:
    """Same answer as :func:`lookup_ranges` by a sort instead of a range join: the last start carried forward.

    Only distinct addresses are looked up, so busy hosts and repeated rows collapse before the shuffle and a bucket
    holds at most one row per address. Within a bucket, ranges and addresses are sorted together and the latest range
    is carried to the addresses that follow it, one row at a time. The answers are joined back by address, where
    adaptive execution splits the rows of a busy one.
    """
    keyed = df.withColumn("_address", address)
    asked = keyed.select("_address").where(F.col("_address").isNotNull()).distinct()
    left = asked.select(
        F.shiftright("_address", index.shift).alias("_bucket"), F.col("_address").alias("_at"), F.lit(1).alias("_kind")
    )
    right = index.buckets.select(
        F.col("bucket").alias("_bucket"),
        # A range that began in an earlier bucket or cell stands at the head of this one.
        F.col("at").alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct("end", *index.values).alias("_range"),
    )
    carried = F.last("_range", ignorenulls=True).over(
        W.partitionBy("_bucket").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    answers = (
        left.unionByName(right, allowMissingColumns=True)
        .withColumn("_last", carried)
        .where("_kind = 1 AND _at <= _last.end")
        .select("_at", *[F.col(f"_last.{v}").alias(v) for v in index.values])
    )
    found = _found(index, "_r", names)
    kept = [F.col(f"_f.{c}") for c in df.columns if c not in set(names.values())]
    keyed = keyed.withColumn("_address", F.coalesce("_address", _no_match(df.columns)))
    on = F.col("_f._address") == F.col("_r._at")
    return keyed.alias("_f").join(answers.alias("_r"), on, "left").select(*kept, *found)


def enrich_asn(flows: DataFrame, index: RangeIndex, keep: Mapping[str, str] | None = None) -> DataFrame:
    """Fill ``src_/dst_`` asn, country and org; IPv4-mapped addresses count as IPv4 in any spelling, others are misses.

    With ``keep`` the numbers of the addresses are appended under the names that it has for ``src`` and ``dst``.
    """
    columns = flows.columns
    for side in ("src", "dst"):
        names = {value: f"{side}_{value}" for value in ASN_VALUES}
        flows = lookup_ranges(flows, any_ipv4_number(F.col(f"{side}_ip")), index, names, keep=(keep or {}).get(side))
    return flows.select(*columns, *[c for c in flows.columns if c not in columns])


def _city_number(text: Column, known: str | None) -> Column:
    """:func:`ipv4_number` of an address; a number that is known of text without a colon is the same."""
    if known is None:
        return ipv4_number(text)
    return F.coalesce(F.when(~text.contains(":"), F.col(known)), ipv4_number(text))


def enrich_city(flows: DataFrame, index: RangeIndex, mode: str = "override", numbers: Mapping[str, str] | None = None) -> DataFrame:
    """Fill ``src_/dst_`` region and city from a city range table.

    ``override``: a country known to the city table replaces the one already there, so that country, region and city
    agree within a row. ``premium``: only region and city are filled. Addresses that are not IPv4, and ``0.0.0.0``,
    are left alone. ``numbers`` names columns that :func:`enrich_asn` has kept, so that addresses are not parsed again.
    """
    if mode not in ("override", "premium"):
        raise ValueError(f"unknown mode {mode!r} (override, premium)")
    columns = flows.columns
    for side in ("src", "dst"):
        number = _city_number(F.col(f"{side}_ip"), (numbers or {}).get(side))
        names = {"country": "_city_country", "region": "_city_region", "city": "_city_city"}
        flows = lookup_ranges(flows, F.nullif(number, F.lit(0).cast("long")), index, names, keep="_city_address")
        applies = F.col("_city_address").isNotNull()
        for value in ("region", "city"):
            before = F.coalesce(F.col(f"{side}_{value}"), F.lit("")) if f"{side}_{value}" in flows.columns else F.lit("")
            flows = flows.withColumn(f"{side}_{value}", F.when(applies, F.col(f"_city_{value}")).otherwise(before))
        if mode == "override":
            better = F.when(F.col("_city_country") != "", F.col("_city_country")).otherwise(F.col(f"{side}_country"))
            flows = flows.withColumn(f"{side}_country", better)
        flows = flows.drop("_city_address", *names.values())
    return flows.select(*columns, *[c for c in flows.columns if c not in columns])


def enrich_application(flows: DataFrame) -> DataFrame:
    """Fill ``application`` from protocol and ports."""
    name = classify_application(F.col("protocol"), F.col("src_port"), F.col("dst_port"))
    return flows.withColumn("application", name)


def enrich_flows(
    flows: DataFrame,
    asn: RangeIndex | None = None,
    city: RangeIndex | None = None,
    premium_city: RangeIndex | None = None,
) -> DataFrame:
    """All enrichment of the ingest path; the premium city table is used instead of the plain one, never with it."""
    cities = city if premium_city is None else premium_city
    numbers = {side: f"_{side}_number" for side in ("src", "dst")} if asn is not None and cities is not None else {}
    if asn is not None:
        flows = enrich_asn(flows, asn, numbers)
    if cities is not None:
        flows = enrich_city(flows, cities, "override" if premium_city is None else "premium", numbers)
    return enrich_application(flows.drop(*numbers.values()))
