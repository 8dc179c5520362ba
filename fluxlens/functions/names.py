"""Names for protocols and applications. Lookups are literal maps, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol names in lower case, anything else is "other".
PROTOCOL_SHORT = {1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 58: "icmpv6", 132: "sctp"}

# Protocol names for display, anything else shows its number.
PROTOCOL_DISPLAY = {
    1: "ICMP",
    2: "IGMP",
    6: "TCP",
    17: "UDP",
    41: "IPv6",
    47: "GRE",
    50: "ESP",
    51: "AH",
    58: "ICMPv6",
    89: "OSPF",
    132: "SCTP",
}

# Applications of protocols that have no ports.
PORTLESS_APPLICATIONS = {
    1: "icmp",
    2: "igmp",
    47: "gre",
    50: "esp",
    51: "ah",
    58: "icmpv6",
    89: "ospf",
    132: "sctp",
}

# TCP service ports.
TCP_APPLICATIONS = {
    20: "ftp-data",
    21: "ftp",
    22: "ssh",
    23: "telnet",
    25: "smtp",
    53: "dns",
    80: "http",
    110: "pop3",
    111: "rpcbind",
    119: "nntp",
    135: "msrpc",
    139: "netbios-ssn",
    143: "imap",
    179: "bgp",
    389: "ldap",
    443: "https",
    445: "smb",
    465: "smtps",
    514: "syslog",
    587: "smtp-submission",
    636: "ldaps",
    873: "rsync",
    989: "ftps-data",
    990: "ftps",
    993: "imaps",
    995: "pop3s",
    1080: "socks",
    1194: "openvpn",
    1433: "mssql",
    1521: "oracle",
    1723: "pptp",
    2049: "nfs",
    2181: "zookeeper",
    2375: "docker",
    2376: "docker-tls",
    2379: "etcd",
    3000: "grafana",
    3128: "http-proxy",
    3306: "mysql",
    3389: "rdp",
    4444: "metasploit",
    5000: "upnp",
    5060: "sip",
    5432: "postgresql",
    5433: "pgbouncer",
    5601: "kibana",
    5672: "amqp",
    5900: "vnc",
    5985: "winrm",
    5986: "winrm-tls",
    6379: "redis",
    6443: "kubernetes-api",
    8000: "http-alt",
    8080: "http-proxy",
    8086: "influxdb",
    8123: "clickhouse-http",
    8443: "https-alt",
    8888: "http-alt",
    9000: "clickhouse",
    9042: "cassandra",
    9092: "kafka",
    9100: "node-exporter",
    9200: "elasticsearch",
    9300: "elasticsearch-transport",
    11211: "memcached",
    15672: "rabbitmq-mgmt",
    27017: "mongodb",
}

# UDP service ports.
UDP_APPLICATIONS = {
    53: "dns",
    67: "dhcp",
    68: "dhcp",
    69: "tftp",
    123: "ntp",
    137: "netbios-ns",
    138: "netbios-dgm",
    161: "snmp",
    162: "snmp-trap",
    443: "quic",
    500: "ike",
    514: "syslog",
    520: "rip",
    1194: "openvpn",
    1701: "l2tp",
    1812: "radius",
    1813: "radius-acct",
    2055: "netflow",
    4500: "ipsec-nat-t",
    4789: "vxlan",
    5060: "sip",
    6081: "geneve",
    6343: "sflow",
    51820: "wireguard",
}


def _lookup(table: dict[int, str], key: Column) -> Column:
    entries = ", ".join(f"{number}, '{name}'" for number, name in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key.cast("int"))


def _port_application(name: str, table: dict[int, str], src_port: Column, dst_port: Column) -> Column:
    by_number = F.when(dst_port == 0, F.lit(name)).otherwise(F.concat(F.lit(name + "/"), dst_port.cast("string")))
    return F.coalesce(_lookup(table, dst_port), _lookup(table, src_port), by_number)


def classify_application(protocol: Column, src_port: Column, dst_port: Column) -> Column:
    """Application as suggested by the ports: destination first, then source, then the number itself."""
    return (
        F.when(protocol == 6, _port_application("tcp", TCP_APPLICATIONS, src_port, dst_port))
        .when(protocol == 17, _port_application("udp", UDP_APPLICATIONS, src_port, dst_port))
        .otherwise(
            F.coalesce(
                _lookup(PORTLESS_APPLICATIONS, protocol), F.concat(F.lit("proto/"), protocol.cast("string"))
            )
        )
    )


def protocol_name(protocol: Column, style: str = "short") -> Column:
    """Protocol name: ``short`` for analysis ("tcp", otherwise "other"), ``display`` for boards ("TCP", else the number)."""
    if style == "short":
        return F.coalesce(_lookup(PROTOCOL_SHORT, protocol), F.lit("other"))
    if style == "display":
        return F.coalesce(
            _lookup(PROTOCOL_DISPLAY, protocol), F.concat(F.lit("protocol "), protocol.cast("string"))
        )
    raise ValueError(f"unknown style {style!r} (short, display)")
