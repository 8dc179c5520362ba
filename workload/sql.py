"""The derivations of ``derive.py`` stated once more in SQL, as named pieces of a WITH clause."""

from __future__ import annotations

# Fixed values, stated here independently of the library so that the SQL can contradict it.
_PORT_ROWS = """
(6, 20, 'ftp-data'), (6, 21, 'ftp'), (6, 22, 'ssh'), (6, 23, 'telnet'), (6, 25, 'smtp'), (6, 53, 'dns'),
(6, 80, 'http'), (6, 110, 'pop3'), (6, 111, 'rpcbind'), (6, 119, 'nntp'), (6, 135, 'msrpc'),
(6, 139, 'netbios-ssn'), (6, 143, 'imap'), (6, 179, 'bgp'), (6, 389, 'ldap'), (6, 443, 'https'),
(6, 445, 'smb'), (6, 465, 'smtps'), (6, 514, 'syslog'), (6, 587, 'smtp-submission'), (6, 636, 'ldaps'),
(6, 873, 'rsync'), (6, 989, 'ftps-data'), (6, 990, 'ftps'), (6, 993, 'imaps'), (6, 995, 'pop3s'),
(6, 1080, 'socks'), (6, 1194, 'openvpn'), (6, 1433, 'mssql'), (6, 1521, 'oracle'), (6, 1723, 'pptp'),
(6, 2049, 'nfs'), (6, 2181, 'zookeeper'), (6, 2375, 'docker'), (6, 2376, 'docker-tls'), (6, 2379, 'etcd'),
(6, 3000, 'grafana'), (6, 3128, 'http-proxy'), (6, 3306, 'mysql'), (6, 3389, 'rdp'), (6, 4444, 'metasploit'),
(6, 5000, 'upnp'), (6, 5060, 'sip'), (6, 5432, 'postgresql'), (6, 5433, 'pgbouncer'), (6, 5601, 'kibana'),
(6, 5672, 'amqp'), (6, 5900, 'vnc'), (6, 5985, 'winrm'), (6, 5986, 'winrm-tls'), (6, 6379, 'redis'),
(6, 6443, 'kubernetes-api'), (6, 8000, 'http-alt'), (6, 8080, 'http-proxy'), (6, 8086, 'influxdb'),
(6, 8123, 'clickhouse-http'), (6, 8443, 'https-alt'), (6, 8888, 'http-alt'), (6, 9000, 'clickhouse'),
(6, 9042, 'cassandra'), (6, 9092, 'kafka'), (6, 9100, 'node-exporter'), (6, 9200, 'elasticsearch'),
(6, 9300, 'elasticsearch-transport'), (6, 11211, 'memcached'), (6, 15672, 'rabbitmq-mgmt'),
(6, 27017, 'mongodb'), (17, 53, 'dns'), (17, 67, 'dhcp'), (17, 68, 'dhcp'), (17, 69, 'tftp'), (17, 123, 'ntp'),
(17, 137, 'netbios-ns'), (17, 138, 'netbios-dgm'), (17, 161, 'snmp'), (17, 162, 'snmp-trap'),
(17, 443, 'quic'), (17, 500, 'ike'), (17, 514, 'syslog'), (17, 520, 'rip'), (17, 1194, 'openvpn'),
(17, 1701, 'l2tp'), (17, 1812, 'radius'), (17, 1813, 'radius-acct'), (17, 2055, 'netflow'),
(17, 4500, 'ipsec-nat-t'), (17, 4789, 'vxlan'), (17, 5060, 'sip'), (17, 6081, 'geneve'), (17, 6343, 'sflow'),
(17, 51820, 'wireguard')"""
_PORTLESS_ROWS = """
(1, 'icmp'), (2, 'igmp'), (47, 'gre'), (50, 'esp'), (51, 'ah'), (58, 'icmpv6'), (89, 'ospf'), (132, 'sctp')"""


def dotted(number: str) -> str:
    return f"({number})//16777216 || '.' || ({number})//65536%256 || '.' || ({number})//256%256 || '.' || ({number})%256"


def mac(number: str) -> str:
    digits = f"lower(lpad(to_hex({number}), 12, '0'))"
    return " || ':' || ".join(f"substr({digits}, {1 + 2 * i}, 2)" for i in range(6))


PORT_OF_PART = "([443, 80, 53, 22, 3306, 9999, 8080, 0])[p % 8 + 1]"
PROTOCOL_OF_LINE = "([1, 6, 17])[n % 3 + 1]"

TIMED = """
keyed AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey AS p, l_suppkey AS s,
                 CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
timed AS (SELECT *, 1704067200 + (k * 97) % 2592000 AS t FROM keyed)"""

NAMES = f"""
ports(proto, port, name) AS (VALUES {_PORT_ROWS}),
portless(proto, name) AS (VALUES {_PORTLESS_ROWS})"""


def classified(source: str) -> str:
    """SELECT that adds ``application`` to the rows of ``source``."""
    return f"""SELECT f.*, CASE f.protocol
    WHEN 6 THEN coalesce(d.name, o.name, CASE WHEN f.dst_port = 0 THEN 'tcp' ELSE 'tcp/' || f.dst_port END)
    WHEN 17 THEN coalesce(d.name, o.name, CASE WHEN f.dst_port = 0 THEN 'udp' ELSE 'udp/' || f.dst_port END)
    ELSE coalesce(x.name, 'proto/' || f.protocol) END AS application
  FROM {source} f
  LEFT JOIN ports d ON d.proto = f.protocol AND d.port = f.dst_port
  LEFT JOIN ports o ON o.proto = f.protocol AND o.port = f.src_port
  LEFT JOIN portless x ON x.proto = f.protocol"""


FLOWS = f"""{TIMED}, {NAMES},
unnamed AS (SELECT k, t AS ts, t + k % 61 AS ts_end, 167772160 + s AS src_n, 3405803776 + p AS dst_n,
  {dotted("167772160 + s")} AS src_ip, {dotted("3405803776 + p")} AS dst_ip,
  CAST(CASE WHEN n % 3 = 0 THEN 0 ELSE 32768 + k % 20000 END AS INTEGER) AS src_port,
  CAST(CASE WHEN n % 3 = 0 THEN 0 ELSE {PORT_OF_PART} END AS INTEGER) AS dst_port,
  CAST({PROTOCOL_OF_LINE} AS INTEGER) AS protocol,
  (1 + k % 50) * (CASE WHEN s % 2 = 1 THEN 100 ELSE 1 END) AS packets,
  (1 + k % 50) * (64 + k % 1400) * (CASE WHEN s % 2 = 1 THEN 100 ELSE 1 END) AS bytes,
  1 + k % 50 AS observed_packets, (1 + k % 50) * (64 + k % 1400) AS observed_bytes,
  CAST(CASE WHEN s % 2 = 1 THEN 100 ELSE 1 END AS BIGINT) AS sampling_rate,
  CAST(CASE WHEN n % 3 = 1 THEN k % 64 ELSE 0 END AS INTEGER) AS tcp_flags,
  CAST(s % 4 AS INTEGER) AS vlan, 1 + n % 3 AS input_interface, n AS output_interface,
  (k % 61) * 1000 AS duration_ms,
  (['LOCAL_XDP', 'SFLOW', 'NETFLOW'])[s % 3 + 1] AS source_type, s % 7 AS device_id,
  CAST(0 AS BIGINT) AS sensor_id, CAST(0 AS BIGINT) AS site_id
  FROM timed),
plain AS ({classified("unnamed")}),
flows AS (SELECT *, '' AS src_country, '' AS dst_country, '' AS src_region, '' AS dst_region, '' AS src_city,
  '' AS dst_city, CAST(0 AS BIGINT) AS src_asn, CAST(0 AS BIGINT) AS dst_asn, '' AS src_org, '' AS dst_org FROM plain)"""

BLOCKS = """
blocks AS (SELECT s_suppkey // 10 AS i, 167772160 + 10 * (s_suppkey // 10) AS a,
  CAST(arg_min(s_nationkey, s_suppkey) AS BIGINT) AS c, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY ALL)"""

RANGES = f"""{BLOCKS},
asn_ranges AS (SELECT a AS lo, a + 7 AS hi, 64512 + i AS asn,
    chr(CAST(65 + c % 26 AS INTEGER)) || chr(CAST(65 + c * 7 % 26 AS INTEGER)) AS country, name AS org FROM blocks
  UNION ALL VALUES (3405803776, 3405804031, 64496, 'JP', 'EXAMPLE-JP'),
    (3405804288, 3405805311, 64497, 'DE', 'OUTER'), (3405804544, 3405804607, 64498, 'FR', 'INNER')),
city_ranges AS (SELECT a AS lo, a + 7 AS hi, CASE WHEN i % 7 = 5 THEN '' ELSE
    chr(CAST(65 + c * 7 % 26 AS INTEGER)) || chr(CAST(65 + c % 26 AS INTEGER)) END AS country,
    'Region ' || c AS region, 'City ' || i || ', North' AS city FROM blocks WHERE i % 7 <> 3 AND i % 13 <> 6)"""


def with_asn(source: str) -> str:
    """SELECT that adds system, country and organisation by the rule itself: last start, then the end is checked."""
    pieces = []
    for side, r in (("src", "a"), ("dst", "b")):
        hit = f"f.{side}_n <= {r}.hi"
        pieces += [
            f"CASE WHEN {hit} THEN {r}.asn ELSE 0 END AS {side}_asn",
            f"CASE WHEN {hit} THEN {r}.country ELSE '' END AS {side}_country",
            f"CASE WHEN {hit} THEN {r}.org ELSE '' END AS {side}_org",
        ]
    return f"""SELECT f.*, {", ".join(pieces)} FROM {source} f
  ASOF LEFT JOIN asn_ranges a ON f.src_n >= a.lo ASOF LEFT JOIN asn_ranges b ON f.dst_n >= b.lo"""


ENRICHED = f"""{FLOWS}, {RANGES},
enriched AS ({with_asn("plain")}),
cities AS (SELECT f.* EXCLUDE (src_country, dst_country),
  CASE WHEN f.src_n <= a.hi AND a.country <> '' THEN a.country ELSE f.src_country END AS src_country,
  CASE WHEN f.dst_n <= b.hi AND b.country <> '' THEN b.country ELSE f.dst_country END AS dst_country,
  f.src_country AS src_asn_country,
  CASE WHEN f.src_n <= a.hi THEN a.region ELSE '' END AS src_region,
  CASE WHEN f.src_n <= a.hi THEN a.city ELSE '' END AS src_city,
  CASE WHEN f.dst_n <= b.hi THEN b.region ELSE '' END AS dst_region,
  CASE WHEN f.dst_n <= b.hi THEN b.city ELSE '' END AS dst_city
  FROM enriched f ASOF LEFT JOIN city_ranges a ON f.src_n >= a.lo ASOF LEFT JOIN city_ranges b ON f.dst_n >= b.lo)"""

_ROLLUP_DIMENSIONS = (
    "src_ip, dst_ip, protocol, application, source_type, device_id, input_interface, "
    "src_country, dst_country, src_asn, dst_asn"
)
ROLLUP_SELECT = f"""SELECT ts - ts % 60 AS ts_minute, {_ROLLUP_DIMENSIONS}, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(sum(packets) AS BIGINT) AS packets, count(*) AS flows FROM {{source}} GROUP BY ALL"""

OBSERVATIONS = f"""
packets0 AS (SELECT event_id AS e, user_id AS u, epoch_us(ts) AS us, event_type, CAST(floor(value) AS BIGINT) AS v
  FROM events),
obs AS (SELECT e, us, us - us % 10000000 AS slot, {dotted("167837696 + u")} AS src_ip,
  {dotted("3405803776 + u % 16")} AS dst_ip, CAST(20000 + u % 7 AS INTEGER) AS src_port,
  CAST(CASE event_type WHEN 'signup' THEN 443 WHEN 'purchase' THEN 80 WHEN 'view' THEN 53 WHEN 'click' THEN 22
    WHEN 'error' THEN 8080 ELSE 0 END AS INTEGER) AS dst_port,
  CAST(CASE WHEN event_type = 'view' THEN 17 ELSE 6 END AS INTEGER) AS protocol,
  40 + v AS length, e % 3 AS raw_packets, greatest(e % 3, 1) AS packets,
  CAST(1 << CAST(e % 6 AS INTEGER) AS INTEGER) AS tcp_flags, CAST(u % 4 + 10 AS INTEGER) AS vlan FROM packets0)"""

FIVE_TUPLE = "src_ip, dst_ip, src_port, dst_port, protocol"
WINDOWS = f"""{OBSERVATIONS},
windows AS (SELECT slot, {FIVE_TUPLE}, min(us) AS first_us, max(us) AS last_us, CAST(sum(packets) AS BIGINT) AS packets,
  CAST(sum(length) AS BIGINT) AS bytes, bit_or(tcp_flags) AS tcp_flags, arg_min(vlan, us * 256 + vlan) AS vlan,
  count(*) AS observations FROM obs GROUP BY ALL)"""

EXPORTER_NUMBER = "CASE WHEN n = 7 THEN s % 250 + 1 ELSE 168361984 + s % 250 END"

NETFLOW_RAW = f"""{TIMED},
netflow_records AS (SELECT k, p, s, n, t, j, t * 1000000 + k % 1000 * 1000 AS export_us,
    1 + k % 50 + j AS observed_packets, CASE WHEN s % 2 = 1 AND k % 4 > 0 THEN k % 4 * 100 ELSE 1 END AS sampling_rate
  FROM timed, unnest(range(0, 1 + n % 3)) AS r(j)
  WHERE k % 101 <> 0 AND k % 103 <> 0 AND k % 107 <> 0 AND k % 109 <> 0 AND k % 113 <> 0),
netflow AS (SELECT CASE WHEN k % 5 IN (0, 1) THEN export_us ELSE export_us - (5000 + k % 1000) * 1000 END AS start_us,
  export_us - k % 100 * 1000 AS end_us,
  167772160 + s AS src_n, 3405803776 + p + j AS dst_n,
  {dotted("167772160 + s")} AS src_ip, {dotted("3405803776 + p + j")} AS dst_ip,
  CAST(32768 + k % 20000 AS INTEGER) AS src_port, CAST({PORT_OF_PART} AS INTEGER) AS dst_port,
  CAST({PROTOCOL_OF_LINE} AS INTEGER) AS protocol, observed_packets * sampling_rate AS packets,
  observed_packets * (64 + k % 1400) * sampling_rate AS bytes, observed_packets,
  observed_packets * (64 + k % 1400) AS observed_bytes, sampling_rate, CAST(k % 64 AS INTEGER) AS tcp_flags,
  n AS input_interface, CAST(j AS BIGINT) AS output_interface, {EXPORTER_NUMBER} AS device_id, 'NETFLOW' AS source_type
  FROM netflow_records)"""

SFLOW_RAW = f"""{TIMED},
datagrams AS (SELECT *, CASE WHEN n = 7 THEN s + 5 WHEN n = 6 THEN 168361984 + s % 250
    ELSE 168427520 + s END AS device_id FROM timed WHERE k % 101 <> 0 AND k % 107 <> 0 AND k % 109 <> 0),
sampled AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN 1 ELSE k % 3 * 500 END AS sampling_rate, 78 + k % 1400 AS observed_bytes,
    n AS input_interface, n + 1 AS output_interface, {mac("s + 256")} AS src_mac, {mac("p")} AS dst_mac
  FROM datagrams WHERE k % 103 <> 0
  UNION ALL BY NAME
  SELECT *, 1 + k % 400 AS sampling_rate, 60 + k % 1400 AS observed_bytes, n + 10 AS input_interface,
    n + 11 AS output_interface, '' AS src_mac, '' AS dst_mac FROM datagrams),
sflow AS (SELECT t * 1000000 AS start_us, t * 1000000 AS end_us, 167772160 + s AS src_n, 3405803776 + p AS dst_n,
  {dotted("167772160 + s")} AS src_ip, {dotted("3405803776 + p")} AS dst_ip,
  CAST(32768 + k % 20000 AS INTEGER) AS src_port, CAST({PORT_OF_PART} AS INTEGER) AS dst_port,
  CAST(CASE WHEN k % 2 = 0 THEN 6 ELSE 17 END AS INTEGER) AS protocol, sampling_rate AS packets,
  observed_bytes * sampling_rate AS bytes, CAST(1 AS BIGINT) AS observed_packets, observed_bytes, sampling_rate,
  CAST(CASE WHEN k % 2 = 0 THEN k % 64 ELSE 0 END AS INTEGER) AS tcp_flags, src_mac, dst_mac, input_interface,
  output_interface, device_id, 'SFLOW' AS source_type FROM sampled)"""

FRAMES = f"""{TIMED},
frames0 AS (SELECT *, ([1, 0, 108, 12])[n % 4 + 1] AS link, ([6, 17, 1, 47])[k % 4 + 1] AS proto FROM timed),
frames AS (SELECT *, CASE
    WHEN link = 1 AND k % 59 = 11 THEN 'too_short'
    WHEN link = 1 AND k % 51 = 3 THEN 'not_ipv4'
    WHEN link IN (0, 108) AND k % 53 = 5 THEN 'not_ipv4'
    WHEN k % 59 = 11 THEN 'too_short'
    WHEN k % 50 = 7 THEN 'fragment' END AS reject FROM frames0)"""


def statement(pieces: str, select: str) -> str:
    """A whole statement from pieces of a WITH clause and a SELECT."""
    return f"WITH {pieces.strip()}\n{select.strip()}"
