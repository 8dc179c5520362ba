"""Every operator as a query over the given tables, next to the SQL that must give the same rows.

A query takes ``(spark, sf_dir)``. Times leave as unix seconds or microseconds, so both engines compare plain numbers.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.functions.ip import canonical_ip, ip_key, ipv4_number, ipv4_text, plain_ipv4_number, render_ip
from fluxlens.functions.names import classify_application, protocol_name
from fluxlens.functions.time import duration_ms, exporter_time, unix_seconds
from fluxlens.model import DIMENSIONS, FLOW_SCHEMA, ROLLUP_DIMENSIONS, conform
from fluxlens.operators import enrich, observations as ob, tiers, upkeep, versions
from fluxlens.operators.distinct import approx_uniq_addresses, build_address_sketches, build_port_rollup, merge_port_rollup, uniq_ports
from fluxlens.operators.observations import windows_to_flows
from fluxlens.operators.query import DETAIL, ROLLUP, FlowTables, flow_detail, flow_query
from fluxlens.operators.topk import top_query
from fluxlens.operators.rollup import build_rollup_1m, compact_rollup
from fluxlens.plans import reports
from fluxlens.session import apply_settings, state_per_core, work_folder
from fluxlens.sources import frames, latest, netflow, ranges, sample_events, sflow, tables
from fluxlens.streaming import ingest, keyed, windows
from fluxlens.streaming.late import start_corrected_rollup
from workload import derive as d
from workload import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FROM, TO = d.FROM, d.TO
ALL = dict(time_from=FROM, time_to=TO)
_DAYS_END = FROM + timedelta(days=3)
T0, T1 = d.BASE, d.BASE + d.MONTH_SECONDS


def query(name: str, pieces: str | None = None, select: str | None = None):
    """Register a query, with its SQL when SQL can say it."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(apply_settings(spark), sf_dir)

        QUERIES[name] = run
        if select is not None:
            ORACLE[name] = sql.statement(pieces, select) if pieces else select.strip()
        return run

    return add


def _micros(*columns: str) -> list:
    return [F.unix_micros(c).alias(f"{c}_us") for c in columns]


def _scope(flows: DataFrame | FlowTables, **more) -> reports.Scope:
    return reports.Scope(flows if isinstance(flows, FlowTables) else FlowTables(flows), FROM, TO, **more)


def _sums(*metrics: str) -> str:
    form = {"flows": "count(*) AS flows"}
    for side in ("src_ip", "dst_ip", "dst_port"):
        form[f"uniq_{side}"] = f"count(DISTINCT {side}) AS uniq_{side}"
    return ", ".join(form.get(m, f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}") for m in metrics)


# ---------------------------------------------------------------------------------------------------------------------
# Sources, decoding and sinks

_FLOW_OUT = (
    "src_ip, dst_ip, src_port, dst_port, protocol, packets, bytes, observed_packets, observed_bytes, sampling_rate, "
    "tcp_flags, input_interface, output_interface, duration_ms, source_type, device_id"
)
_FLOW_OUT_COLUMNS = _FLOW_OUT.split(", ")
_FLOW_OUT_DECODED = _FLOW_OUT.replace("duration_ms", "greatest(end_us - start_us, 0) // 1000 AS duration_ms")


@query(
    "s01_read_flows",
    sql.FLOWS,
    f"""SELECT ts, ts_end, {_FLOW_OUT}, application, vlan FROM flows
    WHERE ts >= {T0 + 4 * 86400 + 3600} AND ts < {T0 + 11 * 86400}""",
)
def s01(spark, sf):
    path = work_folder(spark, "flows")
    tables.append_flows(d.flows(spark, sf), path)
    stored = tables.read_flows(spark, path, FROM + timedelta(days=4, hours=1), FROM + timedelta(days=11))
    return stored.select(
        unix_seconds(F.col("timestamp")).alias("ts"),
        unix_seconds(F.col("timestamp_end")).alias("ts_end"),
        *_FLOW_OUT_COLUMNS,
        "application",
        "vlan",
    )


@query(
    "s02_append_flows",
    sql.FLOWS,
    f"""SELECT ts, CASE WHEN observed_packets % 11 = 0 THEN '::'
      WHEN observed_packets % 13 = 0 THEN '2001:db8::' || lower(to_hex(observed_bytes % 65535 + 1))
      ELSE src_ip END AS src_ip,
    CASE WHEN observed_packets % 11 = 0 THEN repeat('0', 32)
      WHEN observed_packets % 13 = 0 THEN
        '20010db8' || repeat('0', 20) || lower(lpad(to_hex(observed_bytes % 65535 + 1), 4, '0'))
      ELSE repeat('0', 20) || 'ffff' || lower(lpad(to_hex(src_n), 8, '0')) END AS src_key,
    dst_ip, bytes, CAST((ts - {T0}) // 86400 AS INTEGER) AS day FROM flows""",
)
def s02(spark, sf):
    """Writing a batch again under its number leaves one copy; addresses that do not parse become ``::``."""
    mark = F.col("observed_packets")
    v6 = F.concat(F.lit("2001:DB8:0:0::0:"), F.hex(F.col("observed_bytes") % 65535 + 1))
    spelled = F.when(mark % 11 == 0, "10.0.0").when(mark % 13 == 0, v6).otherwise(F.col("src_ip"))
    batch = d.flows(spark, sf).withColumn("src_ip", spelled)
    path = work_folder(spark, "flows")
    for _ in range(2):
        tables.append_flows(batch, path, stream="again", batch_id=7)
    stored = tables.read_flows(spark, path)
    return stored.select(
        unix_seconds(F.col("timestamp")).alias("ts"),
        "src_ip",
        F.lower(F.hex("src_ip_key")).alias("src_key"),
        "dst_ip",
        "bytes",
        F.date_diff("flow_date", F.lit(FROM.date())).alias("day"),
    )


def _as_file(lines: DataFrame, purpose: str, **options) -> str:
    path = work_folder(lines.sparkSession, purpose)
    lines.write.options(**options).text(path)
    return path


@query("s03_load_asn_tsv", sql.RANGES, 'SELECT lo AS "start", hi AS "end", asn, country, org FROM asn_ranges')
def s03(spark, sf):
    return ranges.load_asn_tsv(spark, _as_file(d.asn_lines(spark, sf), "asn-tsv", compression="gzip"))


@query(
    "s04_load_asn_csv",
    sql.BLOCKS,
    """SELECT a AS "start", a + 7 AS "end", 64512 + i AS asn, '' AS country, name || ', "Inc"' AS org
    FROM blocks WHERE i % 9 <> 4""",
)
def s04(spark, sf):
    return ranges.load_asn_csv(spark, _as_file(d.asn_csv_lines(spark, sf), "asn-csv"))


@query(
    "s05_load_city_csv",
    sql.BLOCKS,
    """SELECT a AS "start", a + 7 AS "end", CASE WHEN i % 7 = 5 THEN '' ELSE
      chr(CAST(65 + c * 7 % 26 AS INTEGER)) || chr(CAST(65 + c % 26 AS INTEGER)) END AS country,
      'Region ' || c AS region, 'City ' || i || ', North' AS city,
      CAST(CASE WHEN i % 5 = 0 THEN 0 ELSE i % 90 END AS FLOAT) AS latitude, CAST(i % 180 - 90 AS FLOAT) AS longitude
    FROM blocks WHERE i % 7 <> 3 AND i % 13 <> 6""",
)
def s05(spark, sf):
    return ranges.load_city_csv(spark, _as_file(d.city_lines(spark, sf), "city-csv"))


def _lineitem(spark, sf):
    return d.table(spark, sf, "lineitem")


@query("s06_decode_netflow_v5", sql.NETFLOW_RAW, f"SELECT start_us AS timestamp_us, {_FLOW_OUT_DECODED} FROM netflow")
def s06(spark, sf):
    decoded = netflow.decode_netflow_v5(d.netflow_payloads(_lineitem(spark, sf)))
    return decoded.select(*_micros("timestamp"), *_FLOW_OUT_COLUMNS)


@query(
    "s06_netflow_datagram_status",
    sql.TIMED,
    """SELECT CASE WHEN k % 113 = 0 THEN 'too_short' WHEN k % 101 = 0 THEN 'bad_version'
      WHEN k % 103 = 0 THEN 'too_many_records' WHEN k % 109 = 0 THEN 'empty' WHEN k % 107 = 0 THEN 'truncated'
      ELSE 'ok' END AS status, count(*) AS datagrams FROM timed GROUP BY ALL""",
)
def s06_status(spark, sf):
    return netflow.count_datagrams(d.netflow_payloads(_lineitem(spark, sf)))


@query(
    "s07_decode_sflow_v5",
    sql.SFLOW_RAW,
    f"SELECT start_us AS timestamp_us, {_FLOW_OUT_DECODED}, src_mac, dst_mac FROM sflow",
)
def s07(spark, sf):
    decoded = sflow.decode_sflow_v5(d.sflow_payloads(_lineitem(spark, sf)))
    return decoded.select(*_micros("timestamp"), *_FLOW_OUT_COLUMNS, "src_mac", "dst_mac")


@query(
    "s07_sflow_datagram_status",
    sql.TIMED,
    """SELECT CASE WHEN k % 101 = 0 THEN 'bad_version' WHEN k % 109 = 0 THEN 'too_many_samples'
      WHEN k % 107 = 0 THEN 'sample_overrun' ELSE 'ok' END AS status, count(*) AS datagrams FROM timed GROUP BY ALL""",
)
def s07_status(spark, sf):
    return sflow.count_datagrams(d.sflow_payloads(_lineitem(spark, sf)))


@query(
    "s08_decode_frames",
    sql.FRAMES,
    f"""SELECT k, CAST(link AS INTEGER) AS link_type, {sql.dotted("167772160 + s")} AS src_ip,
      {sql.dotted("3405803776 + p")} AS dst_ip,
      CAST(CASE WHEN proto IN (6, 17) THEN 32768 + k % 20000 ELSE 0 END AS INTEGER) AS src_port,
      CAST(CASE WHEN proto IN (6, 17) THEN {sql.PORT_OF_PART} ELSE 0 END AS INTEGER) AS dst_port,
      CAST(proto AS INTEGER) AS protocol,
      CAST(CASE WHEN proto = 6 AND k % 3 <> 0 THEN k % 64 ELSE 0 END AS INTEGER) AS tcp_flags,
      60 + k % 1400 AS length, CASE WHEN link = 1 THEN {sql.mac("s + 256")} ELSE '' END AS src_mac,
      CASE WHEN link = 1 THEN {sql.mac("p")} ELSE '' END AS dst_mac,
      CAST(CASE WHEN link = 1 THEN s % 4 ELSE 0 END AS INTEGER) AS vlan FROM frames WHERE reject IS NULL""",
)
def s08(spark, sf):
    return frames.decode_frames(d.frames_from_lineitem(_lineitem(spark, sf))).drop("ts")


@query(
    "s08_frame_rejects",
    sql.FRAMES,
    "SELECT reject, count(*) AS frames FROM frames WHERE reject IS NOT NULL GROUP BY ALL",
)
def s08_rejects(spark, sf):
    return frames.count_rejects(d.frames_from_lineitem(_lineitem(spark, sf)))


@query(
    "s09_decode_sample_events",
    sql.OBSERVATIONS,
    """SELECT e AS event_id, us AS ts_us, src_ip, dst_ip, src_port, dst_port, length, protocol, e % 2 = 1 AS egress, packets
    FROM obs WHERE e % 97 <> 0""",
)
def s09(spark, sf):
    decoded = sample_events.decode_sample_events(d.sample_event_payloads(d.table(spark, sf, "events")))
    return decoded.withColumn("ts_us", F.unix_micros("ts")).drop("ts", "tcp_flags", "vlan")


@query(
    "s10_addresses",
    None,
    f"""WITH a AS (SELECT p_partkey AS p, {sql.dotted("3405803776 + p_partkey")} AS t FROM part)
    SELECT p, t AS rendered, 3405803776 + p AS number,
      repeat('0', 20) || 'ffff' || lower(lpad(to_hex(3405803776 + p), 8, '0')) AS mapped_key,
      CAST(NULL AS BIGINT) AS bad_number, '::' AS bad_text,
      '20010db8' || repeat('0', 16) || lower(lpad(to_hex(p % 4096 + 1), 8, '0')) AS v6_key,
      '2001:db8::' || lower(to_hex(p % 4096 + 1)) AS v6_text,
      CASE WHEN p % 256 < 100 THEN 3405803776 + p ELSE NULL END AS octet_up_to_99 FROM a""",
)
def s10(spark, sf):
    p = F.col("p_partkey")
    dotted = ipv4_text(d.DST_NET + p)
    mapped = F.concat(F.lit("::ffff:"), dotted)
    v6 = F.concat(F.lit("2001:0DB8::0000:0:0:"), F.hex(p % 4096 + 1))
    part = d.table(spark, sf, "part").select(
        p.alias("p"),
        dotted.alias("dotted"),
        mapped.alias("mapped"),
        v6.alias("v6"),
        F.concat_ws(".", F.lit("203.0"), p % 7, F.lit("256")).alias("bad"),
        # A fourth octet of three digits behind a further dot is no address.
        F.when(p % 256 < 100, dotted).otherwise(F.concat(dotted, F.lit(".1"))).alias("maybe"),
    )
    return part.select(
        "p",
        render_ip(F.col("mapped")).alias("rendered"),
        ipv4_number(F.col("dotted")).alias("number"),
        F.lower(F.hex(ip_key(F.col("mapped")))).alias("mapped_key"),
        plain_ipv4_number(F.col("bad")).alias("bad_number"),
        canonical_ip(F.col("bad")).alias("bad_text"),
        F.lower(F.hex(ip_key(F.col("v6")))).alias("v6_key"),
        canonical_ip(F.col("v6")).alias("v6_text"),
        ipv4_number(F.col("maybe")).alias("octet_up_to_99"),
    )


@query("s11_unix_seconds", None, "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events")
def s11(spark, sf):
    events = d.table(spark, sf, "events")
    return events.select("event_id", unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))


# ---------------------------------------------------------------------------------------------------------------------
# Observations to flows


@query(
    "o01_sample_one_in_n",
    sql.OBSERVATIONS,
    f"""SELECT us AS ts_us, {sql.FIVE_TUPLE}, length, CAST(raw_packets AS BIGINT) AS packets, tcp_flags, vlan FROM obs
    WHERE CAST('0x' || substr(md5(concat_ws('|', {sql.FIVE_TUPLE}, us)), 1, 8) AS BIGINT) % 4 = 0""",
)
def o01(spark, sf):
    sample = ob.sample_one_in_n(d.observations(spark, sf), 4)
    return sample.select(F.unix_micros("ts").alias("ts_us"), *sql.FIVE_TUPLE.split(", "), "length", "packets", "tcp_flags", "vlan")


_WINDOW_FLOWS = f"""SELECT first_us AS timestamp_us, last_us AS timestamp_end_us, {sql.FIVE_TUPLE},
  packets * {{rate}} AS packets, bytes * {{rate}} AS bytes, packets AS observed_packets, bytes AS observed_bytes,
  (last_us - first_us) // 1000 AS duration_ms, CAST(tcp_flags AS INTEGER) AS tcp_flags, vlan,
  'LOCAL_XDP' AS source_type FROM {{source}}"""
_WINDOW_COLUMNS = (
    *sql.FIVE_TUPLE.split(", "),
    "packets",
    "bytes",
    "observed_packets",
    "observed_bytes",
    "duration_ms",
    "tcp_flags",
    "vlan",
    "source_type",
)


def _window_flows(flows: DataFrame) -> DataFrame:
    return flows.select(*_micros("timestamp", "timestamp_end"), *_WINDOW_COLUMNS)


@query("o02_aggregate_flows", sql.WINDOWS, _WINDOW_FLOWS.format(rate=100, source="windows"))
def o02(spark, sf):
    return _window_flows(ob.aggregate_flows(d.observations(spark, sf), sampling_rate=100))


_HOURLY = sql.WINDOWS.replace("us - us % 10000000 AS slot", "us - us % 3600000000 AS slot")


@query(
    "o03_tcp_flag_union",
    _HOURLY,
    f"SELECT slot AS window_us, {sql.FIVE_TUPLE}, CAST(tcp_flags AS INTEGER) AS tcp_flags FROM windows",
)
def o03(spark, sf):
    hourly = ob.aggregate_windows(d.observations(spark, sf), "1 hour")
    return hourly.select(F.unix_micros("window_start").alias("window_us"), *ob.FIVE_TUPLE, "tcp_flags")


@query(
    "o04_packets_per_observation",
    sql.OBSERVATIONS,
    "SELECT src_ip, CAST(sum(packets) AS BIGINT) AS packets, count(*) AS observations FROM obs GROUP BY ALL",
)
def o04(spark, sf):
    per_host = d.observations(spark, sf).groupBy("src_ip")
    return per_host.agg(
        F.sum(ob.packets_represented(F.col("packets"))).alias("packets"), F.count(F.lit(1)).alias("observations")
    )


_CAP = 5
_RANKED = f"""{_HOURLY},
ranked AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY first_us, {sql.FIVE_TUPLE}) AS position FROM windows)"""


@query("o05_flow_cap", _RANKED, _WINDOW_FLOWS.format(rate=1, source="ranked") + f" WHERE position <= {_CAP}")
def o05(spark, sf):
    return _window_flows(ob.aggregate_flows(d.observations(spark, sf), "1 hour", max_flows=_CAP))


_DROPPED = f"""SELECT slot AS window_us, count(*) FILTER (position <= {_CAP}) AS flows,
      CAST(coalesce(sum(observations) FILTER (position > {_CAP}), 0) AS BIGINT) AS dropped FROM ranked GROUP BY ALL"""


@query("o05_dropped_observations", _RANKED, _DROPPED)
def o05_dropped(spark, sf):
    hourly = ob.aggregate_windows(d.observations(spark, sf), "1 hour")
    dropped = ob.dropped_observations(hourly, _CAP)
    return dropped.select(F.unix_micros("window_start").alias("window_us"), "flows", "dropped")


def _keyed(spark, sf):
    return d._keyed(_lineitem(spark, sf))


@query(
    "o06_apply_sampling",
    sql.TIMED,
    """SELECT k, n, s % 4 - 1 AS sampling_rate, p AS observed_packets, p * 100 AS observed_bytes,
      p * greatest(s % 4 - 1, 1) AS packets, p * 100 * greatest(s % 4 - 1, 1) AS bytes FROM timed""",
)
def o06(spark, sf):
    raw = _keyed(spark, sf).selectExpr("k", "n", "s % 4 - 1 AS sampling_rate", "p AS packets", "p * 100 AS bytes")
    return ob.apply_sampling(raw)


@query(
    "o07_duration_ms",
    sql.TIMED,
    """SELECT k, n, CASE WHEN k % 1000 = 0 THEN 4294967295 ELSE greatest(k % 61 - 30, 0) * 1000 END AS duration_ms
    FROM timed""",
)
def o07(spark, sf):
    end = F.col("t") + F.when(F.col("k") % 1000 == 0, 60 * 86400).otherwise(F.col("k") % 61 - 30)
    return _keyed(spark, sf).select(
        "k", "n", duration_ms(F.timestamp_seconds("t"), F.timestamp_seconds(end)).alias("duration_ms")
    )


@query(
    "o08_exporter_clock",
    sql.TIMED,
    """SELECT k, n, CASE WHEN s % 5 = 0 OR p = 0 OR p * 10 > k THEN t * 1000000 ELSE t * 1000000 - (k - p * 10) * 1000 END AS at_us
    FROM timed""",
)
def o08(spark, sf):
    stamp = F.when(F.col("s") % 5 == 0, 0).otherwise(F.col("p") * 10)
    at = exporter_time(F.col("t") * 1_000_000, F.col("k"), stamp)
    return _keyed(spark, sf).select("k", "n", F.unix_micros(at).alias("at_us"))


@query(
    "o09_sampling_word",
    sql.TIMED,
    """SELECT k, n, CASE WHEN k * 7919 % 65536 < 16384 OR k * 7919 % 16384 = 0 THEN 1
      ELSE k * 7919 % 16384 END AS sampling_rate FROM timed""",
)
def o09(spark, sf):
    rate = netflow.exporter_sampling_rate(F.col("k") * 7919 % 65536)
    return _keyed(spark, sf).select("k", "n", rate.alias("sampling_rate"))


@query("o10_device_id", sql.TIMED, f"SELECT k, n, {sql.EXPORTER_NUMBER} AS device_id FROM timed")
def o10(spark, sf):
    exporter = d._exporter(F.col("s"), F.col("n"))
    return _keyed(spark, sf).select("k", "n", exporter.alias("e")).select(
        "k", "n", netflow.device_id(F.col("e")).alias("device_id")
    )


@query(
    "o11_sflow_byte_rule",
    sql.SFLOW_RAW,
    """SELECT start_us AS timestamp_us, end_us AS timestamp_end_us, src_ip, observed_packets, observed_bytes, bytes
    FROM sflow""",
)
def o11(spark, sf):
    decoded = sflow.decode_sflow_v5(d.sflow_payloads(_lineitem(spark, sf)))
    return decoded.select(
        *_micros("timestamp", "timestamp_end"), "src_ip", "observed_packets", "observed_bytes", "bytes"
    )


# ---------------------------------------------------------------------------------------------------------------------
# Enrichment

_ENDS = "ts, src_ip, dst_ip, bytes"


def _ends(flows: DataFrame, *more: str) -> DataFrame:
    return flows.select(unix_seconds(F.col("timestamp")).alias("ts"), "src_ip", "dst_ip", "bytes", *more)


_ASN_OUT = ("src_asn", "src_country", "src_org", "dst_asn", "dst_country", "dst_org")
_CITY_OUT = ("src_country", "src_region", "src_city", "dst_country", "dst_region", "dst_city")


@query("e01_enrich_asn", sql.ENRICHED, f"SELECT {_ENDS}, {', '.join(_ASN_OUT)} FROM enriched")
def e01(spark, sf):
    return _ends(d.enriched_flows(spark, sf), *_ASN_OUT)


@query("e01_enrich_asn_shuffled", sql.ENRICHED, f"SELECT {_ENDS}, {', '.join(_ASN_OUT)} FROM enriched")
def e01_shuffled(spark, sf):
    """The way for range tables too large to broadcast."""
    index = d.asn_index(spark, sf, max_broadcast_bytes=0)
    return _ends(enrich.enrich_asn(d.flows(spark, sf), index), *_ASN_OUT)


@query(
    "e01_enrich_asn_half_ipv6",
    sql.ENRICHED,
    """SELECT v6, src_asn, src_country, CAST(count(*) AS BIGINT) AS flows FROM
    (SELECT observed_packets % 2 = 1 AS v6, CASE WHEN observed_packets % 2 = 1 THEN 0 ELSE src_asn END AS src_asn,
      CASE WHEN observed_packets % 2 = 1 THEN '' ELSE src_asn_country END AS src_country FROM cities) GROUP BY ALL""",
)
def e01_half_ipv6(spark, sf):
    """Half the flows have no IPv4 address: misses that must not meet in one task of the shuffled lookup."""
    v6 = F.col("observed_packets") % 2 == 1
    flows = d.flows(spark, sf).withColumn("v6", v6).withColumn("src_ip", F.when(F.col("v6"), "2001:db8::1").otherwise(F.col("src_ip")))
    found = enrich.enrich_asn(flows, d.asn_index(spark, sf, max_broadcast_bytes=0))
    return found.groupBy("v6", "src_asn", "src_country").agg(F.count(F.lit(1)).alias("flows"))


@query("e02_enrich_city", sql.ENRICHED, f"SELECT {_ENDS}, {', '.join(_CITY_OUT)} FROM cities")
def e02(spark, sf):
    return _ends(d.geo_flows(spark, sf), *_CITY_OUT)


@query("e03_as_of_lookup", sql.ENRICHED, f"SELECT {_ENDS}, dst_asn, dst_country, dst_org FROM enriched")
def e03(spark, sf):
    names = {"asn": "dst_asn", "country": "dst_country", "org": "dst_org"}
    flows = d.flows(spark, sf)
    found = enrich.lookup_ranges_as_of(flows, plain_ipv4_number(F.col("dst_ip")), d.asn_index(spark, sf), names)
    return _ends(found, "dst_asn", "dst_country", "dst_org")


@query(
    "e04_geo_precedence",
    sql.ENRICHED,
    f"""SELECT {_ENDS}, src_country AS override_country, src_asn_country AS premium_country, src_city AS premium_city
    FROM cities""",
)
def e04(spark, sf):
    flows, city = d.enriched_flows(spark, sf), d.city_index(spark, sf)
    overridden = enrich.enrich_city(flows, city, "override").withColumn("override_country", F.col("src_country"))
    # The premium table leaves the country as the system table gave it.
    back = overridden.withColumns({"src_country": F.lit(""), "dst_country": F.lit("")})
    both = enrich.enrich_city(enrich.enrich_asn(back, d.asn_index(spark, sf)), city, "premium")
    premium = [F.col(f"src_{c}").alias(f"premium_{c}") for c in ("country", "city")]
    return _ends(both, "override_country", *premium)


_CLASSIFIED = f"""{sql.TIMED}, {sql.NAMES},
cases AS (SELECT k, n, CAST(([6, 17, 1, 58, 6, 17, 47, 132, 200, 89, 51, 50, 2])[k % 13 + 1] AS INTEGER) AS protocol,
  CAST(k * 31 % 65536 AS INTEGER) AS src_port, CAST(p % 9300 AS INTEGER) AS dst_port FROM timed),
named AS ({sql.classified("cases")})"""


def _cases(spark, sf):
    k, n, p = F.col("k"), F.col("n"), F.col("p")
    protocol = d._pick(k % 13, (6, 17, 1, 58, 6, 17, 47, 132, 200, 89, 51, 50, 2))
    return _keyed(spark, sf).select(
        k,
        n,
        protocol.alias("protocol"),
        (k * 31 % 65536).cast("int").alias("src_port"),
        (p % 9300).cast("int").alias("dst_port"),
    )


@query("e05_classify_application", _CLASSIFIED, "SELECT k, n, protocol, src_port, dst_port, application FROM named")
def e05(spark, sf):
    name = classify_application(F.col("protocol"), F.col("src_port"), F.col("dst_port"))
    return _cases(spark, sf).withColumn("application", name)


@query(
    "e06_protocol_name",
    _CLASSIFIED,
    """SELECT protocol, CASE protocol WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 47 THEN 'gre'
      WHEN 50 THEN 'esp' WHEN 58 THEN 'icmpv6' WHEN 132 THEN 'sctp' ELSE 'other' END AS short,
    CASE protocol WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'IPv6'
      WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' WHEN 58 THEN 'ICMPv6' WHEN 89 THEN 'OSPF'
      WHEN 132 THEN 'SCTP' ELSE 'protocol ' || protocol END AS display, count(*) AS flows FROM cases GROUP BY ALL""",
)
def e06(spark, sf):
    short, display = protocol_name(F.col("protocol")), protocol_name(F.col("protocol"), "display")
    counted = _cases(spark, sf).groupBy("protocol").agg(F.count(F.lit(1)).alias("flows"))
    return counted.select("protocol", short.alias("short"), display.alias("display"), "flows")


def _drain(started) -> None:
    started.awaitTermination()


@query("e07_stream_static_enrichment", sql.ENRICHED, f"SELECT {_ENDS}, {', '.join(_ASN_OUT)} FROM enriched")
def e07(spark, sf):
    """A stream of flows joined with the static range table on its way into the detail table."""
    path, checkpoint = work_folder(spark, "flows"), work_folder(spark, "stream")
    flows = d.flows_from_lineitem(d.stream(spark, sf, "lineitem"))
    index = d.asn_index(spark, sf)
    _drain(
        ingest.start_flow_ingest(
            flows, path, checkpoint, stream="lines", enrich=lambda f: enrich.enrich_flows(f, asn=index), available_now=True
        )
    )
    return _ends(tables.read_flows(spark, path), *_ASN_OUT)


_VERSION_STARTS = (FROM + timedelta(days=5), FROM + timedelta(days=12, seconds=77), FROM + timedelta(days=21))


def _versioned_ranges(spark, sf) -> DataFrame:
    """Three loads of the range table: later ones have other numbers, and each lacks some blocks."""
    base = d.asn_ranges(spark, sf)
    loads = [
        base.where(F.pmod(F.floor("start").cast("long"), F.lit(4)) != i)
        .withColumns({"asn": F.col("asn") + i * 1000, "org": F.concat("org", F.lit(f" v{i}")), "valid_from": F.lit(at)})
        for i, at in enumerate(_VERSION_STARTS)
    ]
    return loads[0].unionByName(loads[1]).unionByName(loads[2])


def _as_of_sql(moment: str) -> str:
    starts = [int(t.timestamp()) for t in _VERSION_STARTS]
    version = " + ".join(f"CASE WHEN {moment} >= {t} THEN 1 ELSE 0 END" for t in starts)
    return f"""{sql.FLOWS}, {sql.RANGES},
versioned AS (SELECT v, lo, hi, asn + (v - 1) * 1000 AS asn, country, org || ' v' || (v - 1) AS org
  FROM asn_ranges, (VALUES (1), (2), (3)) AS t(v) WHERE lo % 4 <> v - 1),
asked AS (SELECT *, {version} AS v FROM plain),
found AS (SELECT f.*, CASE WHEN f.src_n <= a.hi THEN a.asn ELSE 0 END AS src_asn, CASE WHEN f.src_n <= a.hi THEN a.org ELSE '' END AS src_org,
  CASE WHEN f.dst_n <= b.hi THEN b.asn ELSE 0 END AS dst_asn, CASE WHEN f.dst_n <= b.hi THEN b.country ELSE '' END AS dst_country
  FROM asked f ASOF LEFT JOIN versioned a ON f.v = a.v AND f.src_n >= a.lo ASOF LEFT JOIN versioned b ON f.v = b.v AND f.dst_n >= b.lo)"""


_AS_OF = "SELECT ts, src_ip, dst_ip, bytes, src_asn, src_org, dst_asn, dst_country FROM found"


@query("e07_versions_by_flow_time", _as_of_sql("ts"), _AS_OF)
def e07_versions(spark, sf):
    """History keeps the range table of its time; flows before the first load find nothing."""
    versioned = versions.build_versioned_index(_versioned_ranges(spark, sf))
    found = versions.enrich_asn_as_of(d.flows(spark, sf), versioned)
    return found.select(unix_seconds(F.col("timestamp")).alias("ts"), "src_ip", "dst_ip", "bytes", "src_asn", "src_org", "dst_asn", "dst_country")


@query("e07_enriched_as_of_a_date", _as_of_sql(str(T0 + 15 * 86400)), _AS_OF)
def e07_as_of(spark, sf):
    """All flows enriched anew as of one date."""
    versioned = versions.build_versioned_index(_versioned_ranges(spark, sf))
    found = versions.enrich_asn_as_of(d.flows(spark, sf), versioned, F.lit(FROM + timedelta(days=15)))
    return found.select(unix_seconds(F.col("timestamp")).alias("ts"), "src_ip", "dst_ip", "bytes", "src_asn", "src_org", "dst_asn", "dst_country")


# ---------------------------------------------------------------------------------------------------------------------
# Predicates


def _leaf(field: str, operator: str, value: object) -> dict:
    return {"field": field, "operator": operator, "value": value}


def _group(op: str, *conditions: dict) -> dict:
    return {"op": op, "conditions": list(conditions)}


def _filtered(name: str, tree: dict, where: str, group: str = "application", source: str = "flows"):
    """A filtered question over all flows, grouped so that every kept flow counts."""

    @query(
        name,
        sql.ENRICHED if source == "cities" else sql.FLOWS,
        f"""SELECT {group}, {_sums("bytes", "packets", "flows")} FROM {"cities" if source == "cities" else "flows"}
        WHERE {where} GROUP BY ALL""",
    )
    def run(spark, sf):
        flows = {"cities": d.geo_flows, "stored": d.stored_flows}.get(source, d.flows)(spark, sf)
        return flow_query(flows, **ALL, filters=tree, group_by=[group])

    return run


@query(
    "p01_time_range",
    sql.FLOWS,
    f"""SELECT application, {_sums("bytes", "packets", "flows")} FROM flows
    WHERE ts >= {T0 + 4 * 86400 + 23415} AND ts < {T0 + 11 * 86400} GROUP BY ALL""",
)
def p01(spark, sf):
    start, end = FROM + timedelta(days=4, seconds=23415), FROM + timedelta(days=11)
    return flow_query(d.stored_flows(spark, sf), time_from=start, time_to=end, group_by=["application"])


_filtered(
    "p02_eq_ne",
    _group("AND", _leaf("src_ip", "eq", "10.0.0.7"), _leaf("dst_port", "ne", 443), _leaf("application", "ne", "dns")),
    "src_ip = '10.0.0.7' AND dst_port <> 443 AND application <> 'dns'",
    source="stored",
)
_filtered(
    "p03_comparisons",
    _group(
        "AND",
        _leaf("bytes", "gt", 5000),
        _leaf("dst_port", "lte", 3306),
        _leaf("packets", "gte", 10),
        _leaf("tcp_flags", "lt", 32),
    ),
    "bytes > 5000 AND dst_port <= 3306 AND packets >= 10 AND tcp_flags < 32",
)
_filtered(
    "p04_in_not_in",
    _group(
        "AND",
        _leaf("dst_port", "in", [443, 80.0, 9999, 0]),
        _leaf("src_ip", "not_in", ["10.0.0.1", "10.0.0.2", "::ffff:10.0.0.3"]),
    ),
    "dst_port IN (443, 80, 9999, 0) AND src_ip NOT IN ('10.0.0.1', '10.0.0.2', '10.0.0.3')",
)
_filtered("p05_like", _leaf("application", "like", "%t_p%"), r"application LIKE '%t_p%' ESCAPE '\'")
_filtered(
    "p06_contains",
    _group("OR", _leaf("application", "contains", "p/"), _leaf("application", "contains", "%s")),
    "contains(application, 'p/') OR contains(application, '%s')",
)
_filtered("p07_prefix", _leaf("source_type", "prefix", "S"), "starts_with(source_type, 'S')", group="src_ip")
_filtered(
    "p08_cidr",
    _group(
        "OR",
        _leaf("src_ip", "cidr", "10.0.0.5/30"),
        _leaf("dst_ip", "cidr", "203.0.115.0/24"),
        _leaf("dst_ip", "cidr", "::ffff:203.0.118.0/121"),
        _leaf("src_ip", "cidr", "2001:db8::/32"),
    ),
    """src_n BETWEEN 167772164 AND 167772167 OR dst_n BETWEEN 3405804288 AND 3405804543
      OR dst_n BETWEEN 3405805056 AND 3405805183""",
    group="dst_ip",
    source="stored",
)
@query(
    "p08_cidr_clustered",
    sql.FLOWS,
    f"""SELECT dst_ip, {_sums("bytes", "flows")} FROM flows WHERE src_n BETWEEN 167772164 AND 167772167
      OR dst_n BETWEEN 3405804288 AND 3405804543 OR dst_n BETWEEN 3405805056 AND 3405805183 GROUP BY ALL""",
)
def p08_clustered(spark, sf):
    """The same blocks on a table whose closed days are laid out by time and addresses."""
    path = work_folder(spark, "clustered")
    tables.append_flows(d.flows(spark, sf).where(F.col("timestamp") < F.lit(_DAYS_END)), path)
    tables.compact_flows(spark, path, before=_DAYS_END.date(), by_address=True)
    tables.append_flows(d.flows(spark, sf).where(F.col("timestamp") >= F.lit(_DAYS_END)), path)
    blocks = ("src_ip", "10.0.0.4/30"), ("dst_ip", "203.0.115.0/24"), ("dst_ip", "203.0.118.0/25")
    leaves = [_leaf(field, "cidr", block) for field, block in blocks]
    return flow_query(tables.read_flows(spark, path), **ALL, filters=_group("OR", *leaves), group_by=("dst_ip",), metrics=("bytes", "flows"))


_filtered(
    "p09_tree",
    _group(
        "AND",
        _leaf("dst_country", "eq", "JP"),
        _group("OR", _leaf("dst_port", "eq", 443), _leaf("dst_port", "eq", 80)),
        _group("NOT", _leaf("src_asn", "eq", 64512)),
        {},
    ),
    "dst_country = 'JP' AND (dst_port = 443 OR dst_port = 80) AND NOT src_asn = 64512",
    group="src_ip",
    source="cities",
)


# ---------------------------------------------------------------------------------------------------------------------
# Aggregation, time buckets, rollup


def _grouped(name: str, metrics: tuple[str, ...], group: tuple[str, ...], source: str = "flows"):
    dimensions = ", ".join(group)

    @query(
        name,
        sql.ENRICHED if source == "cities" else sql.FLOWS,
        f"SELECT {dimensions}, {_sums(*metrics)} FROM {source} GROUP BY ALL",
    )
    def run(spark, sf):
        flows = d.geo_flows(spark, sf) if source == "cities" else d.flows(spark, sf)
        return flow_query(flows, **ALL, group_by=group, metrics=metrics)

    return run


_grouped("a01_bytes", ("bytes",), ("src_ip",))
_grouped("a02_packets", ("packets",), ("dst_port",))
_grouped("a03_flows", ("flows",), ("source_type", "protocol"))
_grouped("a04_observed", ("observed_bytes", "observed_packets"), ("device_id",))
_grouped("a05_distinct", ("uniq_src_ip", "uniq_dst_ip", "uniq_dst_port"), ("application",))


def _port_rollup(spark, sf) -> DataFrame:
    """The hourly port rollup as two batches store it."""
    path = work_folder(spark, "ports")
    flows = d.flows(spark, sf)
    for flag in (F.col("src_port") % 2 == 0, F.col("src_port") % 2 == 1):
        build_port_rollup(flows.where(flag), ("application", "source_type")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(
    "a05_distinct_ports_from_rollup",
    sql.FLOWS,
    f"SELECT application, count(DISTINCT dst_port) AS uniq_dst_port FROM flows WHERE ts < {T0} + 20 * 86400 GROUP BY ALL",
)
def a05_ports(spark, sf):
    """Twenty days merged from hourly bitmaps; the detail table is not read again."""
    return uniq_ports(_port_rollup(spark, sf), time_from=FROM, time_to=FROM + timedelta(days=20), group_by=("application",))


@query(
    "a05_distinct_source_ports_per_day",
    sql.FLOWS,
    "SELECT day, source_type, count(DISTINCT src_port) AS uniq_src_port FROM (SELECT *, ts - ts % 86400 AS day FROM flows) GROUP BY ALL",
)
def a05_source_ports(spark, sf):
    """Many different ports: hourly bitmaps merged to days."""
    hourly = build_port_rollup(d.flows(spark, sf), ("source_type",), port="src_port")
    day = F.expr("unix_seconds(ts_bucket) - unix_seconds(ts_bucket) % 86400").alias("day")
    daily = merge_port_rollup(hourly).select("*", day)
    return uniq_ports(daily, time_from=FROM, time_to=TO, group_by=("day", "source_type"), name="uniq_src_port")


@query(
    "a05_approximate_addresses",
    sql.FLOWS,
    """SELECT application, count(DISTINCT src_ip) AS uniq_src_ip, count(DISTINCT dst_ip) AS uniq_dst_ip, true AS src_within, true AS dst_within
    FROM flows GROUP BY ALL""",
)
def a05_sketches(spark, sf):
    """Estimates from merged hourly sketches next to exact counts: each within four standard errors."""
    flows = d.flows(spark, sf)
    asked = dict(**ALL, group_by=("application",))
    estimates = approx_uniq_addresses(build_address_sketches(flows, ("application",)), **asked)
    exact = flow_query(flows, **asked, metrics=("uniq_src_ip", "uniq_dst_ip"))

    def near(side: str) -> Column:
        return F.abs(F.col(f"approx_uniq_{side}_ip") - F.col(f"uniq_{side}_ip")) <= F.greatest(0.065 * F.col(f"uniq_{side}_ip"), F.lit(1))

    return exact.join(estimates, "application").select("application", "uniq_src_ip", "uniq_dst_ip", *[near(s).alias(f"{s}_within") for s in ("src", "dst")])


_grouped("a06_group_by", ("bytes", "flows"), ("source_type", "device_id", "vlan", "input_interface"))
_grouped("a06_group_by_all_dimensions", ("bytes", "packets", "flows"), DIMENSIONS, source="cities")


def _bucketed(interval: str, seconds: int, group: tuple[str, ...], days: int):
    dimensions = "".join(f", {g}" for g in group)

    @query(
        f"a07_bucket_{interval}",
        sql.FLOWS,
        f"""SELECT ts - ts % {seconds} AS ts{dimensions}, {_sums("bytes", "flows")} FROM flows
        WHERE ts >= {T0} AND ts < {T0 + days * 86400} GROUP BY ALL""",
    )
    def run(spark, sf):
        return flow_query(
            d.flows(spark, sf),
            time_from=FROM,
            time_to=FROM + timedelta(days=days),
            interval=interval,
            group_by=group,
            metrics=("bytes", "flows"),
            sort=("ts", False),
        )

    return run


_bucketed("minute", 60, (), 30)
_bucketed("hour", 3600, ("protocol", "source_type"), 30)
_bucketed("day", 86400, ("application",), 30)


@query("a08_global", sql.FLOWS, f"SELECT {_sums('bytes', 'packets', 'flows', 'observed_bytes', 'uniq_src_ip')} FROM flows")
def a08(spark, sf):
    metrics = ("bytes", "packets", "flows", "observed_bytes", "uniq_src_ip")
    return flow_query(d.flows(spark, sf), **ALL, metrics=metrics)


def _rollup_out(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("ts_minute", unix_seconds(F.col("ts_minute")))


@query("a09_build_rollup_1m", sql.ENRICHED, sql.ROLLUP_SELECT.format(source="enriched"))
def a09(spark, sf):
    return _rollup_out(build_rollup_1m(d.enriched_flows(spark, sf)))


@query("a10_compact_rollup", sql.FLOWS, sql.ROLLUP_SELECT.format(source="flows"))
def a10(spark, sf):
    """Three ingest batches, each with its own partial sums, merged into one stored rollup."""
    parts, merged = work_folder(spark, "rollup-parts"), work_folder(spark, "rollup")
    lines = _lineitem(spark, sf)
    for batch, flag in enumerate(("A", "N", "R")):
        batch_flows = d.flows_from_lineitem(lines.where(F.col("l_returnflag") == flag))
        tables.append_rollup(build_rollup_1m(batch_flows), parts, "lines", batch)
    tables.write_compacted_rollup(tables.read_rollup(spark, parts), merged)
    return _rollup_out(tables.read_rollup(spark, merged).drop("month"))


@query("a10_compact_in_rounds", sql.FLOWS, sql.ROLLUP_SELECT.format(source="flows"))
def a10_rounds(spark, sf):
    """Parts that arrive after a first merge are merged in a second; one table holds everything at all times."""
    path = work_folder(spark, "rollup")
    lines = _lineitem(spark, sf)
    for batch, flag in enumerate(("A", "N", "R")):
        batch_flows = d.flows_from_lineitem(lines.where(F.col("l_returnflag") == flag))
        tables.append_rollup(build_rollup_1m(batch_flows), path, "lines", batch)
        if flag != "A":
            tables.compact_rollup_months(spark, path)
    return _rollup_out(tables.read_rollup(spark, path).drop("month"))


_UNALIGNED = dict(time_from=FROM + timedelta(days=2, seconds=3630), time_to=FROM + timedelta(days=9, seconds=17))


@query(
    "a11_query_on_rollup",
    sql.ENRICHED,
    f"""SELECT ts - ts % 60 - (ts - ts % 60) % 3600 AS ts, application, dst_country, {_sums("bytes", "packets", "flows")}
    FROM enriched WHERE ts - ts % 60 >= {T0 + 2 * 86400 + 3630} AND ts - ts % 60 < {T0 + 9 * 86400 + 17}
    GROUP BY ALL""",
)
def a11(spark, sf):
    """In a rollup that is named explicitly, unaligned bounds select whole minutes by their start."""
    flows = d.enriched_flows(spark, sf)
    return flow_query(
        FlowTables(flows, build_rollup_1m(flows)),
        **_UNALIGNED,
        interval="hour",
        group_by=["application", "dst_country"],
        table=ROLLUP,
    )


@query(
    "a12_table_choice",
    sql.FLOWS,
    f"""SELECT source, protocol, bytes, packets, flows FROM
    (SELECT protocol, {_sums("bytes", "packets", "flows")} FROM flows GROUP BY ALL),
    (VALUES ('auto'), ('flows'), ('flows_1m')) AS names(source)""",
)
def a12(spark, sf):
    """Detail, rollup and the automatic choice agree on a range aligned to minutes."""
    flows = d.flows(spark, sf)
    both = FlowTables(flows, build_rollup_1m(flows))
    answers = [
        flow_query(both, **ALL, group_by=["protocol"], table=table).withColumn("source", F.lit(name))
        for name, table in (("auto", None), (DETAIL, DETAIL), (ROLLUP, ROLLUP))
    ]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


_LONG = (T0 + 86400 + 7_261, T0 + 28 * 86400 - 4_001)


@query(
    "a12_fewest_cells",
    sql.FLOWS,
    f"""SELECT 'all' AS span, application, CAST(0 AS BIGINT) AS ts, {_sums("bytes", "packets", "flows")} FROM flows
      WHERE ts >= {_LONG[0]} AND ts < {_LONG[1]} GROUP BY ALL
    UNION ALL SELECT 'daily', application, CAST(ts - ts % 86400 AS BIGINT), {_sums("bytes", "packets", "flows")} FROM flows
      WHERE ts >= {_LONG[0]} AND ts < {_LONG[1]} GROUP BY ALL""",
)
def a12_cells(spark, sf):
    """A month with odd bounds from days, hours, minutes and parts of minutes."""
    flows = d.flows(spark, sf)
    minute = build_rollup_1m(flows)
    hour = tiers.build_tier(minute, "hour")
    stored = tiers.TieredTables(flows, minute, hour, tiers.build_tier(hour, "day"))
    span = dict(zip(("time_from", "time_to"), (datetime.fromtimestamp(t, UTC) for t in _LONG), strict=True))
    whole = tiers.tiered_query(stored, **span, group_by=["application"]).withColumns({"span": F.lit("all"), "ts": F.lit(0).cast("long")})
    daily = tiers.tiered_query(stored, **span, group_by=["application"], interval="day").withColumn("span", F.lit("daily"))
    return whole.unionByName(daily)


def _unaligned(days: int) -> tuple[int, int]:
    return T0 + 2 * 86400 + 3630, T0 + (2 + days) * 86400 + 17


@query(
    "a12_unaligned_range",
    sql.FLOWS,
    " UNION ALL ".join(
        f"""SELECT '{days} days' AS span, CAST(ts - ts % 3600 AS BIGINT) AS ts, protocol, {_sums("bytes", "packets", "flows")} FROM flows
        WHERE ts >= {_unaligned(days)[0]} AND ts < {_unaligned(days)[1]} GROUP BY ALL
        UNION ALL SELECT '{days} days in all', 0, protocol, {_sums("bytes", "packets", "flows")} FROM flows
        WHERE ts >= {_unaligned(days)[0]} AND ts < {_unaligned(days)[1]} GROUP BY ALL"""
        for days in (2, 4)
    ),
)
def a12_unaligned(spark, sf):
    """The automatic choice answers as the detail table does, whatever the bounds and the length of the range."""
    flows = d.flows(spark, sf)
    both = FlowTables(flows, build_rollup_1m(flows))
    answers = []
    for days in (2, 4):
        start, end = (datetime.fromtimestamp(t, UTC) for t in _unaligned(days))
        series = flow_query(both, time_from=start, time_to=end, group_by=["protocol"], interval="hour")
        total = flow_query(both, time_from=start, time_to=end, group_by=["protocol"])
        answers.append(series.withColumn("span", F.lit(f"{days} days")))
        answers.append(total.withColumns({"span": F.lit(f"{days} days in all"), "ts": F.lit(0).cast("long")}))
    result = answers[0]
    for answer in answers[1:]:
        result = result.unionByName(answer)
    return result


# ---------------------------------------------------------------------------------------------------------------------
# Sort, limit, detail, upkeep


@query(
    "d01_bounded_top_k",
    sql.FLOWS,
    f"""SELECT src_ip, dst_ip, dst_port, {_sums("bytes", "flows")} FROM flows GROUP BY ALL ORDER BY bytes DESC, src_ip, dst_ip, dst_port LIMIT 40""",
)
def d01_bounded(spark, sf):
    """The 40 heaviest host pairs and ports; only keys that can still be among them are grouped."""
    return top_query(d.flows(spark, sf), **ALL, group_by=("src_ip", "dst_ip", "dst_port"), metrics=("bytes", "flows"), limit=40)


@query(
    "r06_bounded_conversations",
    sql.FLOWS,
    f"""SELECT src_ip, dst_ip, {_sums("flows", "bytes", "packets")} FROM flows GROUP BY ALL ORDER BY flows DESC, src_ip, dst_ip LIMIT 100""",
)
def r06_bounded(spark, sf):
    """Pairs with most flows, where many pairs have equally many; from the rollup as stored."""
    return top_query(d.stored_rollup(spark, sf), **ALL, group_by=("src_ip", "dst_ip"), metrics=("flows", "bytes", "packets"), limit=100)


@query(
    "d01_sort_and_top_k",
    sql.FLOWS,
    f"""SELECT src_ip, dst_port, {_sums("bytes", "flows")} FROM flows GROUP BY ALL
    ORDER BY flows, src_ip, dst_port LIMIT 250""",
)
def d01(spark, sf):
    return flow_query(
        d.flows(spark, sf),
        **ALL,
        group_by=["src_ip", "dst_port"],
        metrics=["bytes", "flows"],
        sort=("flows", False),
        limit=250,
    )


_DETAIL_SQL = (
    "ts, ts_end, src_ip, dst_ip, src_port, dst_port, protocol, bytes, packets, observed_bytes, observed_packets, "
    "sampling_rate, tcp_flags, application, src_country, dst_country, src_asn, dst_asn, src_org, dst_org, "
    "source_type, device_id, input_interface, vlan, duration_ms"
)


@query(
    "d02_flow_detail",
    sql.ENRICHED,
    f"SELECT {_DETAIL_SQL} FROM enriched WHERE dst_asn > 0 ORDER BY ts DESC, {_DETAIL_SQL} LIMIT 1000",
)
def d02(spark, sf):
    return flow_detail(d.enriched_flows(spark, sf), **ALL, filters=_leaf("dst_asn", "gt", 0), limit=1000)


@query(
    "d03_latest_per_key",
    None,
    """SELECT user_id AS ip, epoch_us(ts) AS updated_us, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) = 1""",
)
def d03(spark, sf):
    events = d.table(spark, sf, "events")
    updated = F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_us")
    metadata = events.select(F.col("user_id").alias("ip"), updated, "event_type", "value")
    return upkeep.latest_per_key(metadata, "ip", "updated_us")


@query(
    "d03_kept_latest",
    None,
    """SELECT user_id AS ip, epoch_us(ts) AS updated_us, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) = 1""",
)
def d03_kept(spark, sf):
    """A table kept by batches whose versions arrive in no order, some of them twice, merged in between."""
    path = work_folder(spark, "latest")
    updated = F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_us")
    rows = d.table(spark, sf, "events").select(F.col("user_id").alias("ip"), updated, "event_type", "value", "event_id")
    for batch in (2, 0, 1, 0):
        part = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch).drop("event_id")
        latest.upsert_latest(part, path, "metadata", batch, version="updated_us", buckets=16)
        if batch == 1:
            latest.merge_latest(spark, path, version="updated_us")
    return latest.read_latest(spark, path, version="updated_us")


_NOW = datetime(2024, 1, 31, 6, 0, tzinfo=UTC)


@query(
    "d04_retention",
    sql.FLOWS,
    f"""SELECT ts - ts % 86400 AS day, {_sums("bytes", "flows")} FROM flows
    WHERE ts >= {int(_NOW.timestamp()) - 10 * 86400} GROUP BY ALL""",
)
def d04(spark, sf):
    """Expired days are deleted as partitions, what is left of the oldest day is filtered."""
    path = work_folder(spark, "flows")
    tables.append_flows(d.flows(spark, sf), path)
    tables.drop_expired_days(spark, path, now=_NOW, days=10)
    kept = upkeep.retain(tables.read_flows(spark, path), now=_NOW, days=10)
    day = unix_seconds(F.col("flow_date").cast("timestamp"))
    return kept.groupBy(day.alias("day")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))


@query(
    "d04_rollup_retention",
    sql.FLOWS,
    f"""SELECT CAST(strftime(make_timestamp(ts * 1000000), '%Y%m') AS INTEGER) AS month, {_sums("bytes", "flows")} FROM flows
    WHERE ts >= {T0 - 31 * 86400} GROUP BY ALL""",
)
def d04_rollup(spark, sf):
    """Months of the rollup that lie wholly before the cutoff are deleted as partitions."""
    path = work_folder(spark, "rollup")
    rollup = build_rollup_1m(d.flows(spark, sf))
    earlier = rollup.withColumn("ts_minute", F.col("ts_minute") - F.expr("INTERVAL 90 DAYS"))
    tables.append_rollup(rollup.unionByName(earlier), path)
    tables.drop_expired_months(spark, path, now=_NOW, days=40)
    return tables.read_rollup(spark, path).groupBy("month").agg(F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"))


@query(
    "d04_compact_flows",
    sql.FLOWS,
    f"SELECT ts - ts % 86400 AS day, 1 AS streams, {_sums('bytes', 'flows')} FROM flows GROUP BY ALL",
)
def d04_compact(spark, sf):
    """Closed days written by several batches become one set of files each; the rows stay."""
    path = work_folder(spark, "flows")
    for batch in range(2):
        tables.append_flows(d.flows(spark, sf).where(F.col("observed_packets") % 2 == batch), path, stream="lines", batch_id=batch)
    tables.compact_flows(spark, path, before=TO.date())
    stored = spark.read.parquet(path)
    day = unix_seconds(F.col("flow_date").cast("timestamp"))
    sums = (F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))
    return stored.groupBy(day.alias("day")).agg(F.count_distinct("stream", "batch_id").cast("int").alias("streams"), *sums)


@query("d05_table_profile", sql.FLOWS, "SELECT count(*) AS rows, min(ts) AS oldest, max(ts) AS newest FROM flows")
def d05(spark, sf):
    return upkeep.table_profile(d.flows(spark, sf))


# ---------------------------------------------------------------------------------------------------------------------
# Reports


@query(
    "r01_kpi_summary",
    sql.FLOWS,
    f"""SELECT *, CASE WHEN observed_bytes > 0 THEN bytes / observed_bytes ELSE 1.0 END AS ratio FROM
    (SELECT {_sums("bytes", "packets", "flows", "observed_bytes", "uniq_src_ip", "uniq_dst_port")} FROM flows)""",
)
def r01(spark, sf):
    return reports.kpi_summary(_scope(d.stored_detail(spark, sf)))


def _board_sql(dimension: str, limit: int, metric: str = "bytes", source: str = "flows", where: str = "true") -> str:
    return f"""SELECT {dimension}, {metric}, CAST({metric} AS DOUBLE) / CAST(max({metric}) OVER () AS DOUBLE) * 100.0 AS pct
    FROM (SELECT {dimension}, {_sums(metric)} FROM {source} WHERE {where} GROUP BY ALL
      ORDER BY {metric} DESC, {dimension} LIMIT {limit})"""


@query("r02_top_talkers", sql.FLOWS, _board_sql("src_ip", 10))
def r02(spark, sf):
    return reports.top_board(_scope(d.stored_rollup(spark, sf)), "src_ip")


@query("r02_top_ports_by_flows", sql.FLOWS, _board_sql("dst_port", 10, "flows"))
def r02_ports(spark, sf):
    return reports.top_board(_scope(d.stored_detail(spark, sf)), "dst_port", "flows")


@query(
    "r03_traffic_trend",
    sql.FLOWS,
    f"SELECT ts - ts % 86400 AS ts, {_sums('bytes')} FROM flows GROUP BY ALL",
)
def r03(spark, sf):
    return reports.traffic_trend(_scope(d.stored_rollup(spark, sf)))


_STACK = """top AS (SELECT {dim} AS key, row_number() OVER (ORDER BY {metric} DESC, {dim}) AS position FROM
    (SELECT {dim}, {agg} AS {metric} FROM flows GROUP BY ALL ORDER BY {metric} DESC, {dim} LIMIT 6)),
series AS (SELECT ts - ts % {seconds} AS ts, {dim} AS key, {agg} AS value FROM flows WHERE {dim} IN (SELECT key FROM top)
  GROUP BY ALL)"""


def _stacked(name: str, dimension: str, metric: str, agg: str, interval: str | None, seconds: int):
    pieces = _STACK.format(dim=dimension, metric=metric, agg=agg, seconds=seconds)

    @query(
        name,
        f"{sql.FLOWS}, {pieces}",
        f"""SELECT b.ts, top.key AS {dimension}, CAST(coalesce(series.value, 0) AS BIGINT) AS {metric}
        FROM (SELECT DISTINCT ts FROM series) b CROSS JOIN top LEFT JOIN series ON series.ts = b.ts AND series.key = top.key""",
    )
    def run(spark, sf):
        stored = d.stored_rollup if dimension in ROLLUP_DIMENSIONS else d.stored_detail
        return reports.stacked_trend(_scope(stored(spark, sf)), dimension, metric, interval)

    return run


_stacked("r04_stacked_trend", "application", "bytes", "sum(bytes)", None, 86400)
_stacked("r04_stacked_trend_by_port", "dst_port", "flows", "count(*)", "hour", 3600)


@query(
    "r05_composition",
    sql.FLOWS,
    f"""SELECT protocol, bytes, CAST(bytes AS DOUBLE) / CAST(sum(bytes) OVER () AS DOUBLE) * 100.0 AS share,
      CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AS label
    FROM (SELECT protocol, {_sums("bytes")} FROM flows GROUP BY ALL ORDER BY bytes DESC, protocol LIMIT 8)""",
)
def r05(spark, sf):
    return reports.composition(_scope(d.stored_rollup(spark, sf)), "protocol")


@query(
    "r06_conversations",
    sql.FLOWS,
    f"""SELECT src_ip, dst_ip, {_sums("bytes", "packets", "flows")} FROM flows GROUP BY ALL
    ORDER BY bytes DESC, src_ip, dst_ip LIMIT 40""",
)
def r06(spark, sf):
    return reports.conversations(_scope(d.stored_rollup(spark, sf)))


_PANELS = {
    "peer": "dst_ip",
    "port": "dst_port",
    "application": "application",
    "peer_country": "dst_country",
    "peer_asn": "dst_asn",
    "protocol": "protocol",
}


@query(
    "r07_host_drilldown",
    sql.ENRICHED,
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{panel}' AS panel, CAST({column} AS VARCHAR) AS key, {_sums("bytes")},
        CAST(row_number() OVER (ORDER BY sum(bytes) DESC, CAST({column} AS VARCHAR)) AS INTEGER) AS position
        FROM enriched WHERE src_ip = '10.0.0.5' GROUP BY {column}) WHERE position <= 10"""
        for panel, column in _PANELS.items()
    ),
)
def r07(spark, sf):
    return reports.host_drilldown(_scope(d.stored_enriched_detail(spark, sf)), "10.0.0.5")


@query(
    "r08_country_map",
    sql.ENRICHED,
    f"""SELECT dst_country, bytes, round(log10(bytes + 1), 9) AS log_value FROM
    (SELECT dst_country, {_sums("bytes")} FROM cities GROUP BY ALL)
    WHERE length(dst_country) = 2""",
)
def r08(spark, sf):
    board = reports.country_map(_scope(d.geo_flows(spark, sf)), "dst_country")
    return board.withColumn("log_value", F.round("log_value", 9))


_BACK_PANELS = {"peer": "src_ip", "port": "dst_port", "application": "application", "peer_country": "src_country", "peer_asn": "src_asn", "protocol": "protocol"}


@query(
    "r07_host_drilldown_by_destination",
    sql.ENRICHED,
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{panel}' AS panel, CAST({column} AS VARCHAR) AS key, {_sums("flows")},
        CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR)) AS INTEGER) AS position
        FROM enriched WHERE dst_ip = '203.0.113.9' GROUP BY {column}) WHERE position <= 10"""
        for panel, column in _BACK_PANELS.items()
    ),
)
def r07_back(spark, sf):
    return reports.host_drilldown(_scope(d.stored_enriched_detail(spark, sf)), "203.0.113.9", "dst_ip", "flows")


@query(
    "r04_pivoted_series",
    sql.FLOWS,
    f"""SELECT ts - ts % 86400 AS ts, {", ".join(f"CAST(coalesce(sum(bytes) FILTER (protocol = {p}), 0) AS BIGINT) AS p{p}" for p in (1, 6, 17))}
    FROM flows GROUP BY ALL""",
)
def r04_pivot(spark, sf):
    """One column for each protocol, zero where a day has none."""
    series = reports.stacked_trend(_scope(d.stored_rollup(spark, sf)), "protocol", "bytes", "day")
    wide = reports.pivot_series(series, "protocol", "bytes", [1, 6, 17])
    return wide.select("ts", *(F.col(str(p)).alias(f"p{p}") for p in (1, 6, 17)))


def _geo_board(dimension: str):
    @query(f"r09_board_{dimension}", sql.ENRICHED, _board_sql(dimension, 15, source="cities"))
    def run(spark, sf):
        return reports.geo_boards(_scope(d.geo_flows(spark, sf)))[dimension]

    return run


for _dimension in ("src_country", "dst_country", "src_asn", "src_org", "src_city"):
    _geo_board(_dimension)


@query(
    "r10_explorer",
    sql.ENRICHED,
    f"""SELECT src_org, {_sums("packets")} FROM enriched WHERE application = 'https' OR dst_asn = 64497 OR bytes > 4000000
    GROUP BY ALL ORDER BY packets DESC, src_org LIMIT 50""",
)
def r10(spark, sf):
    conditions = [
        _leaf("application", "eq", "https"),
        _leaf("dst_asn", "eq", "64497"),
        _leaf("bytes", "gt", 4_000_000),
    ]
    return reports.explorer(_scope(d.enriched_flows(spark, sf)), conditions, "OR", "src_org", "packets", 50)


@query(
    "shared_filter_board",
    sql.ENRICHED,
    _board_sql("dst_port", 10, source="enriched", where="dst_country = 'JP' AND protocol = 6"),
)
def shared_filter(spark, sf):
    """The common filter of a screen is added to every panel's own."""
    scope = _scope(d.enriched_flows(spark, sf), filters=_leaf("dst_country", "eq", "JP"))
    return reports.top_board(scope, "dst_port", filters=_leaf("protocol", "eq", 6))


# ---------------------------------------------------------------------------------------------------------------------
# Streams

_NETFLOW_ENRICHED = f"""{sql.NETFLOW_RAW}, {sql.NAMES}, {sql.RANGES},
named AS ({sql.classified("netflow")}), ingested AS ({sql.with_asn("named")})"""


@query(
    "t01_micro_batch_ingest",
    _NETFLOW_ENRICHED,
    """SELECT start_us // 1000 AS ts_ms, src_ip, dst_ip, bytes, device_id, application, src_asn, dst_country FROM ingested""",
)
def t01(spark, sf):
    """NetFlow payloads as a stream, decoded, enriched and stored."""
    path, checkpoint = work_folder(spark, "flows"), work_folder(spark, "stream")
    payloads = d.netflow_payloads(d.stream(spark, sf, "lineitem"))
    index = d.asn_index(spark, sf)
    _drain(
        ingest.start_flow_ingest(
            netflow.decode_netflow_v5(payloads),
            path,
            checkpoint,
            stream="netflow",
            enrich=lambda f: enrich.enrich_flows(f, asn=index),
            available_now=True,
        )
    )
    stored = tables.read_flows(spark, path)
    at = F.unix_millis("timestamp").alias("ts_ms")
    return stored.select(at, "src_ip", "dst_ip", "bytes", "device_id", "application", "src_asn", "dst_country")


def _observations_with_marker(spark, sf) -> tuple[DataFrame, str]:
    """The stream of events as observations, joined by a folder that takes the end marker."""
    folder = work_folder(spark, "marker")
    spark.createDataFrame([], d.observations(spark, sf).schema).write.parquet(folder)
    marker = spark.readStream.schema(d.observations(spark, sf).schema).parquet(folder)
    live = d.observations_from_events(d.stream(spark, sf, "events"))
    return live.unionByName(marker), folder


_END = datetime(2024, 3, 1, tzinfo=UTC)


_SIZED = f"""{sql.TIMED},
sized AS (SELECT k, CASE WHEN k % 113 = 0 THEN 10 WHEN k % 107 = 0 THEN 71 + 48 * (n % 3) ELSE 72 + 48 * (n % 3) END AS n_bytes FROM timed)"""


@query(
    "t01_rejected_payloads",
    _SIZED,
    """SELECT CASE WHEN k % 113 = 0 THEN 'too_short' WHEN k % 101 = 0 THEN 'bad_version' WHEN k % 103 = 0 THEN 'too_many_records'
      ELSE 'truncated' END AS reason, CAST(n_bytes AS INTEGER) AS n_bytes, count(*) AS datagrams FROM sized
    WHERE k % 113 = 0 OR k % 101 = 0 OR k % 103 = 0 OR (k % 107 = 0 AND k % 109 <> 0) GROUP BY ALL""",
)
def t01_rejects(spark, sf):
    """What a live stream of payloads refuses, kept next to the flows of the same micro-batches."""
    rejects = work_folder(spark, "rejects")
    payloads = d.netflow_payloads(d.stream(spark, sf, "lineitem"))
    _drain(
        ingest.start_payload_ingest(
            payloads, ingest.NETFLOW_V5, work_folder(spark, "flows"), rejects, work_folder(spark, "stream"), stream="netflow", available_now=True
        )
    )
    return spark.read.parquet(rejects).groupBy("reason", "n_bytes").agg(F.count(F.lit(1)).alias("datagrams"))


def _capped_stream(spark, sf) -> tuple[str, str]:
    """Events through the flow cap in two runs, the second from the first one's checkpoint."""
    path, report, checkpoint = (work_folder(spark, n) for n in ("flows", "report", "stream"))
    obs, marker = _observations_with_marker(spark, sf)

    def run() -> None:
        _drain(keyed.start_capped_ingest(obs, path, report, checkpoint, stream="local", window="1 hour", max_flows=_CAP, available_now=True))

    run()
    windows.write_end_marker(spark, marker, _END)
    run()
    return path, report


_STORED_FLOWS = _WINDOW_FLOWS.replace("first_us AS", "first_us // 1000 * 1000 AS").replace("last_us AS", "last_us // 1000 * 1000 AS")


@query("o05_stream_flow_cap", _RANKED, _STORED_FLOWS.format(rate=1, source="ranked") + f" WHERE position <= {_CAP}")
def o05_stream(spark, sf):
    """The first flows of each window of a live stream, as stored."""
    return _window_flows(tables.read_flows(spark, _capped_stream(spark, sf)[0]))


@query("o05_stream_dropped_observations", _RANKED, _DROPPED)
def o05_stream_dropped(spark, sf):
    """What the cap refused, as reported window by window."""
    report = spark.read.parquet(_capped_stream(spark, sf)[1])
    return report.select(F.unix_micros("window_start").alias("window_us"), F.col("flows").cast("long").alias("flows"), "dropped")


@query("t05_quiet_stream", sql.WINDOWS, _WINDOW_FLOWS.format(rate=1, source="windows"))
def t05_quiet(spark, sf):
    """Windows of a stream that falls silent, all of them emitted without a marker."""
    path = work_folder(spark, "flows")
    live = d.observations_from_events(d.stream(spark, sf, "events"))
    flows = windows_to_flows(keyed.stream_windows_until_silent(live, idle_seconds=5)).select(*_micros("timestamp", "timestamp_end"), *_WINDOW_COLUMNS)
    sink = flows.writeStream.format("parquet").option("path", path).option("checkpointLocation", work_folder(spark, "stream"))
    with state_per_core(spark):
        running = sink.trigger(processingTime="4 seconds").start()
    try:
        while running.isActive and not (_silent(running) and not running.status["isTriggerActive"]):
            time.sleep(0.2)
    finally:
        running.stop()
    return spark.read.schema(flows.schema).parquet(path)


def _silent(running) -> bool:
    """Whether a stream has had input and holds no state any more."""
    progress = running.recentProgress
    state = progress[-1]["stateOperators"] if progress else []
    return bool(state) and state[0]["numRowsTotal"] == 0 and sum(p["numInputRows"] for p in progress) > 0


@query("t02_stream_windows", sql.WINDOWS, _WINDOW_FLOWS.format(rate=1, source="windows"))
def t02(spark, sf):
    """Tumbling 10-second windows on a stream; a second run with the end marker closes the last ones."""
    path, checkpoint = work_folder(spark, "flows"), work_folder(spark, "stream")
    obs, marker = _observations_with_marker(spark, sf)
    flows = windows.stream_flows(obs).select(*_micros("timestamp", "timestamp_end"), *_WINDOW_COLUMNS)

    def run() -> None:
        sink = flows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        _drain(sink.outputMode("append").trigger(availableNow=True).start())

    run()
    windows.write_end_marker(spark, marker, _END)
    run()
    return spark.read.parquet(path)


_INPUTS = f"""{sql.WINDOWS}, {sql.NETFLOW_RAW}, {sql.SFLOW_RAW.replace(sql.TIMED + ",", "")},
inputs AS (
  SELECT 'LOCAL_XDP' AS source_type, protocol, bytes, packets FROM windows
  UNION ALL SELECT source_type, protocol, bytes, packets FROM netflow
  UNION ALL SELECT source_type, protocol, bytes, packets FROM sflow)"""


@query(
    "t04_separate_streams",
    f"""{_INPUTS}, flows0 AS (SELECT 'LOCAL_XDP' AS source_type, protocol, bytes, packets FROM windows),
    stored AS (SELECT source_type, protocol, bytes, packets FROM netflow
      UNION ALL SELECT source_type, protocol, bytes, packets FROM sflow UNION ALL SELECT * FROM flows0)""",
    f"""SELECT source_type, protocol, {_sums("bytes", "packets", "flows")} FROM stored GROUP BY ALL""",
)
def t04_separate(spark, sf):
    """NetFlow and sFlow as two queries of their own and a batch of local flows, all into one table."""
    path, rollup = work_folder(spark, "flows"), work_folder(spark, "rollup")
    lines = d.stream(spark, sf, "lineitem", d.BATCH_FILES)
    inputs = {
        "netflow": netflow.decode_netflow_v5(d.netflow_payloads(lines)),
        "sflow": sflow.decode_sflow_v5(d.sflow_payloads(lines)),
    }
    started = [
        ingest.start_flow_ingest(flows, path, work_folder(spark, "stream"), stream=name, rollup_path=rollup, available_now=True)
        for name, flows in inputs.items()
    ]
    for running in started:
        _drain(running)
    local = ob.aggregate_flows(d.observations(spark, sf))
    tables.append_flows(local, path)
    tables.append_rollup(build_rollup_1m(tables.stored_form(local)), rollup)
    stored = tables.read_flows(spark, path).groupBy("source_type", "protocol")
    sums = [F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")]
    detail = stored.agg(*sums, F.count(F.lit(1)).alias("flows"))
    minutes = tables.read_rollup(spark, rollup).groupBy("source_type", "protocol").agg(*sums, F.sum("flows").alias("flows"))
    return detail.join(minutes, detail.columns, "left_semi")


@query(
    "t03_rollup_of_dirty_addresses",
    sql.FLOWS,
    f"""SELECT src, {_sums("bytes", "flows")} FROM (SELECT bytes, CASE WHEN observed_packets % 11 = 0 THEN '::'
      WHEN observed_packets % 13 = 0 THEN '2001:db8::' || lower(to_hex(observed_bytes % 65535 + 1)) ELSE src_ip END AS src FROM flows)
    GROUP BY ALL""",
)
def t03_dirty(spark, sf):
    """Bad, mapped and upper-case addresses are the same hosts in the rollup as in the detail table."""
    path, rollup = work_folder(spark, "flows"), work_folder(spark, "rollup")
    mark = F.col("observed_packets")
    v6 = F.concat(F.lit("2001:DB8:0:0::0:"), F.hex(F.col("observed_bytes") % 65535 + 1))
    mapped = F.when(mark % 7 == 0, F.concat(F.lit("::FFFF:"), F.col("src_ip"))).otherwise(F.col("src_ip"))
    spelled = F.when(mark % 11 == 0, "10.0.0").when(mark % 13 == 0, v6).otherwise(mapped)
    flows = d.flows_from_lineitem(d.stream(spark, sf, "lineitem")).withColumn("src_ip", spelled)
    _drain(ingest.start_flow_ingest(flows, path, work_folder(spark, "stream"), stream="lines", rollup_path=rollup, available_now=True))
    detail = tables.read_flows(spark, path).groupBy(F.col("src_ip").alias("src")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))
    minutes = tables.read_rollup(spark, rollup).groupBy(F.col("src_ip").alias("src")).agg(F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"))
    return detail.join(minutes, detail.columns, "left_semi")


@query("t03_incremental_rollup", sql.FLOWS, sql.ROLLUP_SELECT.format(source="flows"))
def t03(spark, sf):
    """Partial sums of every micro-batch, merged afterwards."""
    parts, merged = work_folder(spark, "rollup-parts"), work_folder(spark, "rollup")
    flows = d.flows_from_lineitem(d.stream(spark, sf, "lineitem"))
    _drain(ingest.start_rollup(flows, parts, work_folder(spark, "stream"), stream="lines", available_now=True))
    tables.write_compacted_rollup(tables.read_rollup(spark, parts), merged)
    return _rollup_out(tables.read_rollup(spark, merged).drop("month"))


@query("t03_late_flows_corrected", sql.FLOWS, sql.ROLLUP_SELECT.format(source="flows"))
def t03_late(spark, sf):
    """A shuffled input in four batches: most flows come after their minute was closed, and the rollup is whole all the same."""
    path, late, marks, checkpoint, folder = (work_folder(spark, n) for n in ("rollup", "late", "marks", "stream", "lines"))
    flows = d.flows(spark, sf)
    for part in range(4):
        flows.where(F.pmod(F.xxhash64("timestamp", "src_ip", "bytes"), F.lit(4)) == part).write.mode("append").parquet(folder)
        live = spark.readStream.schema(FLOW_SCHEMA).parquet(folder)
        _drain(start_corrected_rollup(live, path, late, marks, checkpoint, stream="lines", available_now=True))
    return _rollup_out(compact_rollup(tables.read_rollup(spark, path)))


@query(
    "t04_multiple_inputs",
    _INPUTS,
    f"SELECT source_type, protocol, {_sums('bytes', 'packets', 'flows')} FROM inputs GROUP BY ALL",
)
def t04(spark, sf):
    """Local packets, sFlow and NetFlow in one stream into one table."""
    path, checkpoint = work_folder(spark, "flows"), work_folder(spark, "stream")
    obs, marker = _observations_with_marker(spark, sf)
    lines = d.stream(spark, sf, "lineitem")
    inputs = ingest.union_inputs(
        windows.stream_flows(obs),
        netflow.decode_netflow_v5(d.netflow_payloads(lines)),
        sflow.decode_sflow_v5(d.sflow_payloads(lines)),
    )
    with state_per_core(spark):
        first = ingest.start_flow_ingest(inputs, path, checkpoint, stream="all", available_now=True)
    _drain(first)
    windows.write_end_marker(spark, marker, _END)
    _drain(ingest.start_flow_ingest(inputs, path, checkpoint, stream="all", available_now=True))
    stored = tables.read_flows(spark, path)
    return stored.groupBy("source_type", "protocol").agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count(F.lit(1)).alias("flows")
    )


@query(
    "t05_end_of_input_flush",
    sql.FLOWS,
    sql.ROLLUP_SELECT.format(source="flows"),
)
def t05(spark, sf):
    """Minute windows in append mode, closed at the end of the input by a marker flow."""
    path, checkpoint = work_folder(spark, "rollup"), work_folder(spark, "stream")
    folder = work_folder(spark, "marker")
    schema = FLOW_SCHEMA
    spark.createDataFrame([], schema).write.parquet(folder)
    live = d.flows_from_lineitem(d.stream(spark, sf, "lineitem"))
    both = live.unionByName(spark.readStream.schema(schema).parquet(folder))

    def run() -> None:
        rollup = windows.stream_rollup_1m(both)
        sink = rollup.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        _drain(sink.outputMode("append").trigger(availableNow=True).start())

    run()
    last = spark.createDataFrame([(_END,)], "timestamp timestamp").withColumn("timestamp_end", F.col("timestamp"))
    conform(last, FLOW_SCHEMA).write.mode("append").parquet(folder)
    run()
    return _rollup_out(spark.read.parquet(path))


@query("rollup_parts_resummed", sql.FLOWS, sql.ROLLUP_SELECT.format(source="flows"))
def resummed(spark, sf):
    """Parts summed on reading, without having been merged in storage."""
    lines = _lineitem(spark, sf)
    flags = [F.col("l_linestatus") == "O", F.col("l_linestatus") != "O"]
    parts = [build_rollup_1m(d.flows_from_lineitem(lines.where(flag))) for flag in flags]
    return _rollup_out(compact_rollup(parts[0].unionByName(parts[1])))
