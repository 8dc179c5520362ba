from __future__ import annotations

import random
from collections import defaultdict
from datetime import timedelta

from pyspark.sql import functions as F

from builders import at
from fluxlens.functions.time import duration_ms
from fluxlens.model import OBSERVATION_SCHEMA
from fluxlens.operators import observations as ob

START = at("2026-08-01T00:00:00")


def observe(spark, *rows):
    """(seconds, src, dst, sport, dport, proto, length, packets, flags, vlan)"""
    data = [(START + timedelta(seconds=r[0]), *r[1:]) for r in rows]
    return spark.createDataFrame(data, OBSERVATION_SCHEMA)


def packet(second, dport, length=100, packets=None, flags=0, vlan=0):
    return (second, "203.0.113.7", "198.51.100.1", 40000, dport, 6, length, packets, flags, vlan)


def test_same_tuple_is_one_flow(spark):
    obs = observe(
        spark, packet(1.0, 443, flags=2, vlan=7), packet(0.5, 443, flags=16, vlan=9), packet(2.0, 443, flags=1),
        packet(1.0, 8443, 50),
    )
    rows = {r["dst_port"]: r for r in ob.aggregate_flows(obs, sampling_rate=100).collect()}
    assert len(rows) == 2
    f = rows[443]
    assert (f["observed_packets"], f["observed_bytes"], f["packets"], f["bytes"]) == (3, 300, 300, 30000)
    assert (f["tcp_flags"], f["vlan"], f["duration_ms"], f["source_type"]) == (19, 9, 1500, "LOCAL_XDP")


def test_windows_tumble(spark):
    assert ob.aggregate_flows(observe(spark, packet(9.9, 1), packet(10.0, 1), packet(19.9, 1))).count() == 2


def test_segments_count_as_packets(spark):
    row = ob.aggregate_flows(observe(spark, packet(0, 1, 64000, 44), packet(1, 1, 100, 0))).first()
    assert (row["packets"], row["bytes"]) == (45, 64100)


def test_cap_keeps_first_flows_whole(spark):
    obs = observe(spark, *[packet(i / 50, 1000 + i) for i in range(100)])
    windows = ob.aggregate_windows(obs)
    assert ob.admit_first_flows(windows, 10).count() == 10
    assert ob.dropped_observations(windows, 10).first()["dropped"] == 90
    known = observe(spark, packet(0, 1), packet(1, 2), packet(2, 1), packet(3, 1))
    assert [(r["dst_port"], r["packets"]) for r in ob.aggregate_flows(known, max_flows=1).collect()] == [(1, 3)]
    dropped = ob.dropped_observations(ob.aggregate_windows(known), 1).first()
    assert (dropped["flows"], dropped["dropped"]) == (1, 1)


def test_cap_agrees_with_admission_in_arrival_order(spark):
    rng = random.Random(3)
    rows = [packet(i * 0.05, rng.randrange(40), 10) for i in range(600)]
    kept, dropped = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for row in rows:
        window, key = int(row[0] // 10), row[4]
        if key in kept[window] or len(kept[window]) < 8:
            kept[window][key] += 1
        else:
            dropped[window] += 1
    windows = ob.aggregate_windows(observe(spark, *rows))
    got = defaultdict(dict)
    for r in ob.admit_first_flows(windows, 8).collect():
        got[int((r["window_start"].timestamp() - START.timestamp()) // 10)][r["dst_port"]] = r["packets"]
    assert {w: dict(v) for w, v in kept.items()} == dict(got)
    refused = {
        int((r["window_start"].timestamp() - START.timestamp()) // 10): r["dropped"]
        for r in ob.dropped_observations(windows, 8).collect()
    }
    assert refused == {w: dropped[w] for w in kept}


def test_sampling_is_repeatable_and_about_one_in_n(spark):
    obs = observe(spark, *[packet(i / 1000, i % 60000) for i in range(20000)])
    first, again = (sorted(map(tuple, ob.sample_one_in_n(obs.repartition(n), 10).collect())) for n in (2, 5))
    assert first == again and 1700 < len(first) < 2300
    assert ob.sample_one_in_n(obs, 1).count() == 20000


def test_apply_sampling_and_duration(spark):
    df = spark.createDataFrame([(10, 1500, 100), (10, 1500, 0), (10, 1500, None)], "packets bigint, bytes bigint, sampling_rate bigint")
    rows = ob.apply_sampling(df).collect()
    assert [(r["packets"], r["bytes"], r["observed_packets"], r["observed_bytes"]) for r in rows] == [
        (1000, 150000, 10, 1500), (10, 1500, 10, 1500), (10, 1500, 10, 1500),
    ]
    spans = [(START, START + timedelta(seconds=1.5)), (START, START - timedelta(1)), (START, START + timedelta(60))]
    df = spark.createDataFrame(spans, "a timestamp, b timestamp")
    assert [r[0] for r in df.select(duration_ms(F.col("a"), F.col("b"))).collect()] == [1500, 0, 2**32 - 1]
