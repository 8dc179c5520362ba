from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from fluxlens.functions.ip import (
    canonical_ip,
    cidr_bounds,
    ip_key,
    ipv4_block,
    ipv4_number,
    ipv4_text,
    literal_ip,
    plain_ipv4_number,
    render_ip,
)


def expected_key(text: str) -> bytes:
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return bytes(16)
    return address.packed if address.version == 6 else bytes(10) + b"\xff\xff" + address.packed


def expected_text(key: bytes) -> str:
    address = ipaddress.IPv6Address(key)
    return str(address.ipv4_mapped or address)


def sample_texts() -> list[str]:
    rng = random.Random(7)
    texts = [
        "10.0.0.1", "255.255.255.255", "0.0.0.0", "1.2.3", "1.2.3.4.5", "1.2.3.256", "01.2.3.4", "1..2.3", "a.b.c.d",
        " 1.2.3.4", "1.2.3.4 ", "+1.2.3.4", "", ":", "::", "::1", "1::", "1::2", ":::", "1:::2", "::ffff:1.2.3.4",
        "::FFFF:1.2.3.4", "::1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:8",
        "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "2001:DB8:0:0:1:0:0:1",
        "2001:db8::1:0:0:1:0", "fe80::12345", "g::1", "1:0:0:2:0:0:0:3", "0:0:0:0:0:0:0:0", "::1.2.3.400", "1.2.3.4:80",
        "2001:db8:0:0:0:0:2:1", "1::2::3", "::ffff:0:0",
    ]
    for _ in range(150):
        groups = [rng.choice([0, 0, 0, rng.randrange(65536)]) for _ in range(8)]
        texts.append(str(ipaddress.IPv6Address(b"".join(g.to_bytes(2, "big") for g in groups))))
        texts.append(":".join(f"{g:x}" for g in groups))
    return texts


def test_keys_and_canonical_text_agree_with_the_standard_library(spark):
    texts = sample_texts()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", ip_key(F.col("t")).alias("key"), canonical_ip(F.col("t")).alias("text")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert bytes(row["key"]) == expected_key(row["t"]), row["t"]
        assert row["text"] == expected_text(expected_key(row["t"])), row["t"]


def test_numbers_and_rendering(spark):
    rows = [("1.2.3.4",), ("001.2.3.4",), ("1.2.3.999",), ("1.2.3.",), ("::ffff:1.2.3.4",), ("99999999999.1.1.1",)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(
        ipv4_number(F.col("t")).alias("loose"),
        plain_ipv4_number(F.col("t")).alias("plain"),
        render_ip(F.col("t")).alias("shown"),
    ).collect()
    n = 0x01020304
    assert [r["loose"] for r in out] == [n, n, None, None, None, None]
    assert [r["plain"] for r in out] == [n, None, None, None, n, None]
    assert out[4]["shown"] == "1.2.3.4"
    back = spark.createDataFrame([(n,), (2**32 - 1,), (0,)], "n bigint").select(ipv4_text(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in back] == ["1.2.3.4", "255.255.255.255", "0.0.0.0"]


def test_blocks():
    first, last = cidr_bounds("10.1.2.3/22")
    assert ipv4_block(first, last) == (0x0A010000, 0x0A0103FF, "10.1.")
    assert ipv4_block(*cidr_bounds("0.0.0.0/0")) == (0, 2**32 - 1, "")
    assert ipv4_block(*cidr_bounds("1.2.3.4/32"))[2] == "1.2.3."
    assert ipv4_block(*cidr_bounds("2001:db8::/32")) is None
    assert literal_ip("::ffff:1.2.3.4") == "1.2.3.4"
    with pytest.raises(ValueError):
        cidr_bounds("10.0.0.0")
