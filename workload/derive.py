"""Flows, observations, range files and captured payloads derived from the given tables by plain projections.

The tables hold no network traffic, so order lines are read as flows and events as packets. Every mapping is integer
arithmetic on columns: it scales with the tables, works on streams, and ``sql.py`` states it once more in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.functions.binary import hex_field
from fluxlens.functions.ip import ipv4_text
from fluxlens.functions.time import duration_ms
from fluxlens.model import FLOW_SCHEMA, conform
from fluxlens.operators.enrich import RangeIndex, build_range_index, enrich_application, enrich_flows
from fluxlens.operators.observations import apply_sampling
from fluxlens.operators.query import FlowTables
from fluxlens.operators.rollup import build_rollup_1m
from fluxlens.session import work_folder
from fluxlens.sources import tables
from fluxlens.sources.ranges import parse_asn_lines

BASE = 1704067200  # 2024-01-01T00:00:00Z
MONTH_SECONDS = 2592000
SRC_NET, DST_NET = 167772160, 3405803776  # 10.0.0.0, 203.0.113.0
FROM, TO = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 31, tzinfo=UTC)

PORTS = (443, 80, 53, 22, 3306, 9999, 8080, 0)
#: The most rows of a given table that one task should read: partial sums of as many groups stay in its memory.
TASK_ROWS = 1_000_000
#: The most files of a copied table that one micro-batch takes, so what it shuffles does not grow with the table.
BATCH_FILES = 32
#: Columns that no mapping reads are left out of copies.
UNREAD = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "props")

EVENT_PORTS = {"signup": 443, "purchase": 80, "view": 53, "click": 22, "error": 8080}


_STAGED: dict[tuple[str, ...], object] = {}


def _once(spark: SparkSession, *key: str, make: Callable[[], object]) -> object:
    """What a session prepares once from the given tables and every query then reads."""
    known = (spark.sparkContext.applicationId, *key)
    if known not in _STAGED:
        _STAGED[known] = make()
    return _STAGED[known]


def _evenly_read(spark: SparkSession, path: str) -> tuple[bool, int]:
    """Whether tasks would read about equally many rows of a file, none more than ``TASK_ROWS``, and how many it has.

    No column is read: a split without the start of a row group has no rows, whatever its size.
    """
    found = spark.read.parquet(path).groupBy(F.spark_partition_id()).count()
    most, rows = found.agg(F.max("count"), F.sum("count")).first()
    tasks = spark.sparkContext.defaultParallelism
    return rows is None or (most <= TASK_ROWS and most * tasks <= 2 * rows), rows or 0


def _spread(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, bool]:
    """Where a large table is read, and whether that is a copy. One that few tasks would read, as a file of a single row
    group is, is copied into the shared folder once, evenly over as many files as tasks can run and about ``TASK_ROWS`` rows
    at most in each. Rows are dealt by their values: dealt in turn, each task would first have to sort all of its rows."""

    def spread() -> tuple[str, bool]:
        source = f"{sf_dir}/{name}.parquet"
        evenly, rows = _evenly_read(spark, source)
        if evenly:
            return source, False
        path = work_folder(spark, name)
        files = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
        read = spark.read.parquet(source).drop(*UNREAD)
        read.repartition(files, *read.columns).write.option("compression", "zstd").parquet(path)
        return path, True

    return _once(spark, sf_dir, name, make=spread)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, of a copied one the columns that are read."""
    large = name in ("lineitem", "events")
    return spark.read.parquet(_spread(spark, sf_dir, name)[0] if large else f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, batch_files: int | None = None) -> DataFrame:
    """One of the two large tables as a file stream, of a copied one at most ``batch_files`` files in a micro-batch.

    The files are in no order of time: where a watermark decides what is late, they must all come in one micro-batch."""
    path, copied = _spread(spark, sf_dir, name)
    live = spark.readStream.schema(spark.read.parquet(path).schema)
    if not copied:
        return live.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return (live.option("maxFilesPerTrigger", batch_files) if batch_files else live).parquet(path)


def _stored(df: DataFrame, column: str) -> DataFrame:
    """Treat a derived column as if it had been read from a file.

    Payloads and lines are input columns in real use. Unfolding a one-element array keeps Catalyst from merging their
    derivation into every expression of the decoder that reads them.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(column)).alias(column))


def _pick(index: Column, values: tuple) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _keyed(lineitem: DataFrame) -> DataFrame:
    """Short names used by all mappings: k, p (part), s (supplier), n (line number), t (epoch second)."""
    return lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber AS k",
        "l_partkey AS p",
        "l_suppkey AS s",
        "cast(l_linenumber AS bigint) AS n",
        f"{BASE} + ((l_orderkey * 8 + l_linenumber) * 97) % {MONTH_SECONDS} AS t",
    )


def _dotted(number: str) -> str:
    octets = ", ".join(f"shiftright({number}, {shift}) & 255" for shift in (24, 16, 8, 0))
    return f"concat_ws('.', {octets})"


def flows_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Order lines as canonical flows with scaled counters and inferred application, but no geography."""
    protocol = "element_at(array(1, 6, 17), cast(n % 3 + 1 AS int))"
    port = f"element_at(array{PORTS}, cast(p % 8 + 1 AS int))"
    flows = _keyed(lineitem).selectExpr(
        "timestamp_seconds(t) AS timestamp",
        "timestamp_seconds(t + k % 61) AS timestamp_end",
        f"{_dotted(f's + {SRC_NET}')} AS src_ip",
        f"{_dotted(f'p + {DST_NET}')} AS dst_ip",
        "cast(if(n % 3 = 0, 0, 32768 + k % 20000) AS int) AS src_port",
        f"if(n % 3 = 0, 0, {port}) AS dst_port",
        f"{protocol} AS protocol",
        "1 + k % 50 AS packets",
        "(1 + k % 50) * (64 + k % 1400) AS bytes",
        "cast(if(s % 2 = 1, 100, 1) AS bigint) AS sampling_rate",
        "cast(if(n % 3 = 1, k % 64, 0) AS int) AS tcp_flags",
        "cast(s % 4 AS int) AS vlan",
        "1 + n % 3 AS input_interface",
        "n AS output_interface",
        "element_at(array('LOCAL_XDP', 'SFLOW', 'NETFLOW'), cast(s % 3 + 1 AS int)) AS source_type",
        "s % 7 AS device_id",
    )
    flows = apply_sampling(flows).withColumn("duration_ms", duration_ms(F.col("timestamp"), F.col("timestamp_end")))
    return enrich_application(conform(flows, FLOW_SCHEMA))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_lineitem(table(spark, sf_dir, "lineitem"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ten suppliers: i, first address a, nation number c and name of the block's first supplier."""
    return (
        table(spark, sf_dir, "supplier")
        .groupBy(F.expr("floor(s_suppkey / 10) AS i"))
        .agg(F.expr("min(struct(s_suppkey, s_nationkey, s_name)) AS f"))
        .selectExpr("i", f"{SRC_NET} + i * 10 AS a", "cast(f.s_nationkey AS bigint) AS c", "f.s_name AS name")
    )


_COUNTRY, _COUNTRY_BACK = (
    f"concat(char(65 + {first} % 26), char(65 + {second} % 26))" for first, second in (("c", "c * 7"), ("c * 7", "c"))
)
_SPECIAL_LINES = (
    r"203.0.113.0\t203.0.113.255\t64496\tJP\tEXAMPLE-JP",
    r"203.0.114.0\t203.0.114.255\t0\tNone\tNot routed",
    r"203.0.115.0\t203.0.118.255\t64497\tDE\tOUTER",
    r"203.0.116.0\t203.0.116.63\t64498\tFR\tINNER",
    r"# a comment\t1\t2\t3\t4",
)
_SPOILED_LINES = (
    "",
    "no tabs here",
    r"1.2.3\t1.2.3.4\t5\tUS\tX",
    r"1.2.3.4\t1.2.3.400\t5\tUS\tX",
    r"1.2.3.4\t1.2.3.5\tAS5\tUS\tX",
)


def asn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a system-range file, good and bad ones. Each region adds one special and one spoiled line."""
    first, last = _dotted("a"), _dotted("a + 7")
    lines = _blocks(spark, sf_dir).selectExpr(
        rf"concat_ws('\t', {first}, {last}, 64512 + i, {_COUNTRY}, name) AS value"
    )
    at = "cast(r_regionkey + 1 AS int)"
    extra = table(spark, sf_dir, "region").selectExpr(
        f"explode(array(element_at(array{_sql(_SPECIAL_LINES)}, {at}), element_at(array{_sql(_SPOILED_LINES)}, {at})))"
        " AS value"
    )
    return _stored(lines.unionByName(extra), "value")


def _sql(lines: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{line}'" for line in lines) + ")"


def asn_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks in the four-column quoted form; every ninth block carries the placeholder number 0."""
    number = "if(i % 9 = 4, 0, 64512 + i)"
    return _blocks(spark, sf_dir).selectExpr(
        f"""concat(concat_ws(',', {_dotted("a")}, {_dotted("a + 7")}, {number}), ',"', name, ', ""Inc""', '"') AS value"""
    )


def city_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks as city ranges: quoted names with commas, some unknown countries, some bad coordinates."""
    ends = f"{_dotted('a')}, {_dotted('a + 7')}"
    country = f"CASE WHEN i % 7 = 3 THEN 'ZZ' WHEN i % 7 = 5 THEN '' ELSE {_COUNTRY_BACK} END"
    latitude = "if(i % 5 = 0, 'bad', cast(i % 90 AS string))"
    good = (
        f"concat(concat_ws(',', {ends}, 'EU', {country}, concat('Region ', c)), ',\"City ', i, ', North\",', "
        f"concat_ws(',', {latitude}, i % 180 - 90))"
    )
    short = f"concat_ws(',', {ends}, 'too short')"
    return _blocks(spark, sf_dir).selectExpr(f"if(i % 13 = 6, {short}, {good}) AS value")


def asn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_asn_lines(asn_lines(spark, sf_dir))


def city_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What loading ``city_lines`` gives, without the detour over a file."""
    return (
        _blocks(spark, sf_dir)
        .where("i % 7 <> 3 AND i % 13 <> 6")
        .selectExpr(
            "a AS start",
            "a + 7 AS end",
            f"if(i % 7 = 5, '', {_COUNTRY_BACK}) AS country",
            "concat('Region ', c) AS region",
            "concat('City ', i, ', North') AS city",
        )
    )


def asn_index(spark: SparkSession, sf_dir: str, **options) -> RangeIndex:
    return build_range_index(asn_ranges(spark, sf_dir), **options)


def city_index(spark: SparkSession, sf_dir: str) -> RangeIndex:
    return build_range_index(city_ranges(spark, sf_dir), ("country", "region", "city"))


def enriched_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with system, country and organisation."""
    return enrich_flows(flows(spark, sf_dir), asn=asn_index(spark, sf_dir))


def geo_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with system, country, organisation, region and city."""
    return enrich_flows(flows(spark, sf_dir), asn=asn_index(spark, sf_dir), city=city_index(spark, sf_dir))


def _detail_table(spark: SparkSession, flows: DataFrame) -> DataFrame:
    path = work_folder(spark, "flows")
    tables.append_flows(flows, path)
    return tables.read_flows(spark, path)


def _rollup_table(spark: SparkSession, flows: DataFrame) -> DataFrame:
    path = work_folder(spark, "rollup")
    tables.append_rollup(build_rollup_1m(flows), path)
    return tables.read_rollup(spark, path)


def _stored_detail(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    return _once(spark, sf_dir, name, make=lambda: _detail_table(spark, make(spark, sf_dir)))


def _stored_tables(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> FlowTables:
    detail = _stored_detail(spark, sf_dir, name, make)
    return FlowTables(detail, _once(spark, sf_dir, f"{name} rollup", make=lambda: _rollup_table(spark, detail)))


def stored_flows(spark: SparkSession, sf_dir: str) -> FlowTables:
    """Detail table and rollup as they lie in storage, written once."""
    return _stored_tables(spark, sf_dir, "stored", flows)


def stored_detail(spark: SparkSession, sf_dir: str) -> FlowTables:
    """The detail table alone, for questions that its rollup cannot answer."""
    return FlowTables(_stored_detail(spark, sf_dir, "stored", flows))


def stored_rollup(spark: SparkSession, sf_dir: str) -> FlowTables:
    """The rollup as it lies in storage, for questions of whole minutes and its dimensions: they never read the detail table,
    so it is not written for them. Anything else is answered from the flows in the form in which they would be stored."""
    detail = tables.stored_form(flows(spark, sf_dir))
    return FlowTables(detail, _once(spark, sf_dir, "stored rollup", make=lambda: _rollup_table(spark, detail)))


def stored_enriched_flows(spark: SparkSession, sf_dir: str) -> FlowTables:
    """Detail table with system, country and organisation, and its rollup."""
    return _stored_tables(spark, sf_dir, "stored enriched", enriched_flows)


def stored_enriched_detail(spark: SparkSession, sf_dir: str) -> FlowTables:
    """That detail table alone, for questions that no rollup can answer."""
    return FlowTables(_stored_detail(spark, sf_dir, "stored enriched", enriched_flows))


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Everything that is prepared once."""
    for name in ("lineitem", "events"):
        table(spark, sf_dir, name)
    stored_flows(spark, sf_dir)
    stored_enriched_flows(spark, sf_dir)


def _event_port() -> Column:
    port = F.lit(0)
    for name, number in EVENT_PORTS.items():
        port = F.when(F.col("event_type") == name, number).otherwise(port)
    return port


def observations_from_events(events: DataFrame) -> DataFrame:
    """Events as single packets."""
    user, event, port = F.col("user_id"), F.col("event_id"), _event_port()
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        ipv4_text(167837696 + user).alias("src_ip"),
        ipv4_text(DST_NET + user % 16).alias("dst_ip"),
        (20000 + user % 7).cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"),
        F.when(F.col("event_type") == "view", 17).otherwise(6).alias("protocol"),
        (40 + F.floor("value")).cast("long").alias("length"),
        (event % 3).alias("packets"),
        F.call_function("shiftleft", F.lit(1), (event % 6).cast("int")).alias("tcp_flags"),
        (user % 4 + 10).cast("int").alias("vlan"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_from_events(table(spark, sf_dir, "events"))


def _bytes(*fields: Column) -> Column:
    return F.unhex(F.concat(*fields))


def _fields(*parts: Column | str | tuple[Column | int, int]) -> Column:
    """Big-endian fields of ``(value, bytes)`` as hex digits, other parts being digits already.

    Neighbours that fill eight bytes are written as one number, which costs a fraction of one string for each field.
    """
    digits: list[Column] = []
    group: list[tuple[Column | int, int]] = []

    def close() -> None:
        width, fixed, number = sum(w for _, w in group), 0, None
        below = width
        for value, w in group:
            below -= w
            if isinstance(value, int):
                fixed |= value << 8 * below
                continue
            cut = value.cast("long")
            cut = cut if w == 8 else F.shiftleft(cut.bitwiseAND((1 << 8 * w) - 1), 8 * below)
            number = cut if number is None else number.bitwiseOR(cut)
        if number is None:
            digits.append(F.lit(f"{fixed:0{2 * width}X}"))
        elif group:
            fixed -= 1 << 64 if fixed >> 63 else 0
            digits.append(hex_field(number.bitwiseOR(F.lit(fixed).cast("long")) if fixed else number, width))
        group.clear()

    for part in parts:
        if not isinstance(part, tuple) or sum(w for _, w in group) + part[1] > 8:
            if group:
                close()
        if isinstance(part, tuple):
            group.append(part)
        else:
            digits.append(F.lit(part) if isinstance(part, str) else part)
    if group:
        close()
    return F.concat(*digits)


def _exporter(s: Column, n: Column) -> Column:
    return F.when(n == 7, F.concat(F.lit("2001:db8::"), F.lower(F.hex(s % 250 + 1)))).otherwise(
        F.concat(F.lit("10.9.0."), s % 250)
    )


def netflow_payloads(lineitem: DataFrame) -> DataFrame:
    """Each order line as one NetFlow v5 datagram of one to three records; some datagrams are damaged."""
    k, p, s, n, t = (F.col(c) for c in "kpsnt")
    count = 1 + n % 3
    uptime = 100000 + k % 50000
    protocol = _pick(n % 3, (1, 6, 17))
    first = F.when(k % 5 == 0, 0).when(k % 5 == 1, uptime + 1).otherwise(uptime - 5000 - k % 1000)

    def record(j: int) -> Column:
        packets = 1 + k % 50 + j
        return _fields(
            (s + SRC_NET, 4), (p + (DST_NET + j), 4), (0, 4), (n, 2), (j, 2),
            (packets, 4), (packets * (64 + k % 1400), 4), (first, 4), (uptime - k % 100, 4),
            (32768 + k % 20000, 2), (_pick(p % 8, PORTS), 2), (0, 1), (k % 64, 1), (protocol, 1), (0, 1), (0, 8),
        )

    # At most three records, each written out: a lambda over their numbers would be interpreted row by row.
    records = F.concat(record(0), *[F.when(count > j, record(j)).otherwise("") for j in (1, 2)])
    sampling = F.when(s % 2 == 1, 16384 + k % 4 * 100).otherwise(k % 4 * 100)
    header = _fields(
        (F.when(k % 101 == 0, 9).otherwise(5), 2), (F.when(k % 103 == 0, 31).when(k % 109 == 0, 0).otherwise(count), 2),
        (uptime, 4), (t, 4), (k % 1000 * 1000000, 4), (0, 6), (sampling, 2),
    )
    # The size follows from the number of records; asking the bytes for it would build them twice.
    size = 24 + 48 * count
    kept = F.when(k % 113 == 0, 10).when(k % 107 == 0, size - 1).otherwise(size).cast("int")
    payload = F.substring(_bytes(header, records), F.lit(1), kept)
    return _stored(_keyed(lineitem).select(payload.alias("payload"), _exporter(s, n).alias("exporter")), "payload")


def _ipv4_packet(ihl: Column, frag: Column, total: Column, proto: Column, src: Column, dst: Column, l4: Column):
    version = F.lit(4) * 16 + ihl
    options = F.rpad(F.lit(""), (ihl.cast("int") - 5) * 8, F.lit("0"))
    return _fields(
        (version, 1), (0, 1), (total, 2), (0, 2), (frag, 2), (64, 1), (proto, 1), (0, 2), (src, 4), (dst, 4), options, l4
    )


def _transport(proto: Column, k: Column, p: Column, short: Column) -> Column:
    """Ports, then for a whole TCP header the fields up to flags and a few more."""
    ports = _fields((32768 + k % 20000, 2), (_pick(p % 8, PORTS), 2))
    rest = _fields((0, 8), (k % 64 + 20480, 2), (0, 6))
    return F.when(short, ports).otherwise(F.concat(ports, rest))


def frames_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Each order line as one captured frame of one of four link types; some frames cannot be used."""
    k, p, s, n, t = (F.col(c) for c in "kpsnt")
    link = _pick(n % 4, (1, 0, 108, 12))
    proto = _pick(k % 4, (6, 17, 1, 47))
    ihl = F.when(k % 2 == 1, 8).otherwise(5)
    packet = _ipv4_packet(
        ihl,
        F.when(k % 50 == 7, 185).otherwise(16384),
        60 + k % 1400,
        proto,
        s + SRC_NET,
        p + DST_NET,
        _transport(proto, k, p, k % 3 == 0),
    )
    macs = F.concat(hex_field(p, 6), hex_field(s + 256, 6))
    kind = F.when(k % 51 == 3, F.lit("86DD")).otherwise(F.lit("0800"))
    tag = F.when(s % 4 > 0, F.concat(F.when(s % 4 == 1, "88A8").otherwise("8100"), hex_field(4096 * 3 + s % 4, 2)))
    ethernet = F.concat(macs, F.coalesce(tag, F.lit("")), kind, packet)
    family = F.when(link == 0, F.lit("02000000")).otherwise(F.lit("00000002"))
    family = F.when(k % 53 == 5, F.lit("1E000000")).otherwise(family)
    digits = F.when(link == 1, ethernet).when(link == 12, packet).otherwise(F.concat(family, packet))
    whole = F.unhex(digits)
    frame = F.when(k % 59 == 11, F.substring(whole, F.lit(1), F.lit(13))).otherwise(whole)
    frames = _keyed(lineitem).select(
        k.alias("k"), F.timestamp_seconds(t).alias("ts"), frame.alias("frame"), link.alias("link_type")
    )
    return _stored(frames, "frame")


def sflow_payloads(lineitem: DataFrame) -> DataFrame:
    """Each order line as one sFlow v5 datagram: a counter sample, a plain and an expanded flow sample.

    The plain sample carries an Ethernet header, the expanded one a foreign record and a bare IPv4 header without a
    reported frame length. Some datagrams are damaged at different depths.
    """
    k, p, s, n, t = (F.col(c) for c in "kpsnt")
    proto = _pick(k % 2, (6, 17))

    def words(*values: Column | int) -> list[tuple[Column | int, int]]:
        return [(value, 4) for value in values]

    packet = _ipv4_packet(
        F.lit(5), F.lit(0), 60 + k % 1400, proto, s + SRC_NET, p + DST_NET, _transport(proto, k, p, F.lit(False))
    )
    packet_size, ethernet_size = 40, 54
    ethernet = _fields((p, 6), (s + 256, 6), "0800", packet)

    def raw_header(protocol: int, frame_length: Column | int, header: Column, size: int) -> tuple[list, int]:
        """The parts of a record and their bytes. Opaque data is followed by zeros up to a multiple of four bytes."""
        padding = -size % 4
        body = 16 + size + padding
        parts = words(1, body, protocol, frame_length, 0, size)
        return [*parts, header, *(["00" * padding] if padding else [])], 8 + body

    foreign, foreign_size = [*words(1001, 16), "00" * 16], 24
    records = F.when(k % 103 == 0, 65).otherwise(1)
    plain_header, plain_size = raw_header(1, 78 + k % 1400, ethernet, ethernet_size)
    expanded_header, expanded_size = raw_header(11, 0, packet, packet_size)
    plain = [*words(k, 0, k % 3 * 500, 0, 0, n, n + 1, records), *plain_header]
    expanded = [*words(k, 0, 7, 1 + k % 400, 0, 0, 0, n + 10, 0, n + 11, 2), *foreign, *expanded_header]
    plain_size, expanded_size = 32 + plain_size, 44 + foreign_size + expanded_size
    agent = F.when(n == 7, _fields((2, 4), "20010DB8" + "0" * 16, (s + 5, 4))).otherwise(
        _fields((1, 4), (F.when(n == 6, 0).otherwise(SRC_NET + 655360 + s), 4))
    )
    counter = [*words(2, 8), (0, 8)]
    digits = _fields(
        (F.when(k % 101 == 0, 4).otherwise(5), 4), agent, *words(0, k, 1000, F.when(k % 109 == 0, 1025).otherwise(3)),
        *counter, *words(1, plain_size), *plain, *words(3, expanded_size), *expanded,
    )
    size = F.when(n == 7, 20).otherwise(8) + (20 + 16 + 8 + plain_size + 8 + expanded_size)
    payload = F.substring(F.unhex(digits), F.lit(1), F.when(k % 107 == 0, size - 1).otherwise(size))
    datagrams = _keyed(lineitem).select(
        payload.alias("payload"), _exporter(s, n).alias("exporter"), F.timestamp_seconds(t).alias("recv_ts")
    )
    return _stored(datagrams, "payload")


def sample_event_payloads(events: DataFrame) -> DataFrame:
    """Events as 20-byte sample records with their time."""

    def little(value: Column) -> Column:
        return F.concat(hex_field(value % 256, 1), hex_field(F.floor(value / 256), 1))

    user, event = F.col("user_id"), F.col("event_id")
    port = _event_port()
    digits = F.concat(
        hex_field(167837696 + user, 4),
        hex_field(DST_NET + user % 16, 4),
        little(20000 + user % 7),
        little(port.cast("long")),
        little(40 + F.floor("value")),
        hex_field(F.when(F.col("event_type") == "view", 17).otherwise(6), 1),
        hex_field(event % 2, 1),
        little(event % 3),
        F.lit("0000"),
    )
    whole = F.unhex(digits)
    payload = F.when(event % 97 == 0, F.substring(whole, F.lit(1), F.lit(19))).otherwise(whole)
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), payload.alias("payload"))
    return _stored(rows, "payload")
