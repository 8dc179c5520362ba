"""Flows, packets and datagrams for tests, built with ``struct`` independently of the library."""

from __future__ import annotations

import ipaddress
import struct
from datetime import UTC, datetime

from fluxlens.model import FLOW_SCHEMA, conform


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def flows(spark, *rows: dict):
    """Flows from partial dicts; ``timestamp`` defaults to the start of the test day."""
    names = sorted({name for row in rows for name in row} | {"timestamp"})
    kinds = {f.name: f.dataType.simpleString() for f in FLOW_SCHEMA}
    start = at("2026-08-01T00:00:00")
    data = [tuple(row.get(n, start if n == "timestamp" else None) for n in names) for row in rows]
    df = spark.createDataFrame(data, ", ".join(f"{n} {kinds[n]}" for n in names))
    if "timestamp_end" not in names:
        df = df.withColumn("timestamp_end", df["timestamp"])
    return conform(df)


def packed(address: str) -> bytes:
    return ipaddress.ip_address(address).packed


def netflow(count, uptime, seconds, sampling, *records) -> bytes:
    out = struct.pack(">HHIIIIBBH", 5, count, uptime, seconds, 0, 0, 0, 0, sampling)
    for r in records:
        out += packed(r["src"]) + packed(r["dst"]) + bytes(4)
        out += struct.pack(">HHIIII", r.get("input", 0), r.get("output", 0), r["packets"], r["bytes"], r["first"], r["last"])
        out += struct.pack(">HHBBB", r.get("sport", 0), r.get("dport", 0), 0, r.get("flags", 0), r["proto"]) + bytes(9)
    return out


def ipv4(proto=6, sport=40000, dport=443, words=5, frag=0, total=None, l4=20, flags=0x18) -> bytes:
    """An IPv4 packet with ``l4`` bytes of transport header."""
    body = struct.pack(">HH", sport, dport) + bytes(8) + struct.pack(">H", flags) + bytes(100)
    body = body[:l4]
    total = words * 4 + len(body) if total is None else total
    head = struct.pack(">BBHHHBBH", 0x40 | words, 0, total, 0, frag, 64, proto, 0)
    return head + packed("203.0.113.7") + packed("198.51.100.1") + bytes(words * 4 - 20) + body


def ethernet(payload: bytes, vlan: int = 0, kind: int = 0x0800) -> bytes:
    tag = struct.pack(">HH", 0x8100, vlan) if vlan else b""
    return bytes.fromhex("001122334455aabbccddeeff") + tag + struct.pack(">H", kind) + payload


def words(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def raw_header(frame: bytes, frame_length: int, protocol: int = 1) -> bytes:
    body = words(protocol, frame_length, 0, len(frame)) + frame
    return words(1, len(body)) + body


def sample(records: bytes, rate: int = 1000, count: int = 1, expanded: bool = False) -> bytes:
    if expanded:
        body = words(1, 0, 0, rate, 0, 0, 0, 3, 0, 5, count) + records
        return words(3, len(body)) + body
    body = words(1, 0, rate, 0, 0, 3, 5, count) + records
    return words(1, len(body)) + body


def sflow(*samples: bytes, agent: str = "10.0.0.9", count: int | None = None, version: int = 5) -> bytes:
    address = packed(agent)
    head = words(version, 1 if len(address) == 4 else 2) + address
    return head + words(0, 1, 1000, len(samples) if count is None else count) + b"".join(samples)
