"""The derived payloads hold the right bytes and are built without interpreted lambdas or one string for each field."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from fluxlens.sources.netflow import device_id
from workload import derive as d


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _lines(spark, sf_dir):
    return d._keyed(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def test_payloads_are_built_from_whole_numbers(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for df, most in ((d.netflow_payloads(lines), 30), (d.sflow_payloads(lines), 60)):
        plan = _plan(df)
        assert "lambda" not in plan
        assert plan.count("lpad(") <= most


def test_fields_fill_their_bytes(spark):
    row = spark.range(1).select(F.lit(5).alias("a"), F.lit((1 << 40) + 7).cast("long").alias("b"))
    digits = d._fields((255, 1), (F.col("a"), 2), (3, 1), (F.col("b"), 4), "AB", (F.col("a"), 8), (0, 3), (F.col("b"), 4), (1, 8))
    want = bytes([255, 0, 5, 3, 0, 0, 0, 7, 0xAB]) + struct.pack(">Q", 5) + bytes(3) + struct.pack(">I", 7) + struct.pack(">Q", 1)
    assert bytes(row.select(F.unhex(digits)).first()[0]) == want


def test_netflow_payload_bytes(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, p, s, n, t = _lines(spark, sf_dir).where("k % 113 > 0 AND k % 107 > 0 AND k % 103 > 0 AND k % 109 > 0 AND k % 101 > 0 AND n % 3 = 2").orderBy("k").first()
    one = lines.where((F.col("l_orderkey") * 8 + F.col("l_linenumber")) == k)
    payload = bytes(d.netflow_payloads(one).first()["payload"])
    count, uptime = 1 + n % 3, 100000 + k % 50000
    sampling = 16384 + k % 4 * 100 if s % 2 else k % 4 * 100
    want = struct.pack(">HHIII", 5, count, uptime, t, k % 1000 * 1000000) + bytes(6) + struct.pack(">H", sampling)
    first = 0 if k % 5 == 0 else uptime + 1 if k % 5 == 1 else uptime - 5000 - k % 1000
    for j in range(count):
        packets = 1 + k % 50 + j
        want += struct.pack(
            ">IIIHHIIIIHHBBBB", s + d.SRC_NET, p + d.DST_NET + j, 0, n, j, packets, packets * (64 + k % 1400), first, uptime - k % 100,
            32768 + k % 20000, d.PORTS[p % 8], 0, k % 64, (1, 6, 17)[n % 3], 0,
        ) + bytes(8)
    assert payload == want


def test_device_of_any_spelling(spark):
    rows = [("10.9.0.7",), ("::ffff:10.9.0.7",), ("::FFFF:a09:7",), ("2001:db8::fa",), ("10.9.0",), ("",), (None,)]
    found = spark.createDataFrame(rows, "a string").select(device_id(F.col("a")))
    number = (10 << 24) + (9 << 16) + 7
    assert [r[0] for r in found.collect()] == [number, number, number, 0xFA, 0, 0, 0]
