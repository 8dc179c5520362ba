from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from builders import flows
from fluxlens.functions.ip import any_ipv4_number
from fluxlens.functions.names import classify_application, protocol_name
from fluxlens.operators import enrich

SCHEMA = "start bigint, end bigint, asn bigint, country string, org string"
NAMES = {"asn": "asn", "country": "country", "org": "org"}


def by_rule(ranges, number):
    """Last start at or before the address, then its end; of equal starts the highest row."""
    best = None
    for row in ranges:
        if row[0] <= number and (best is None or (row[0], row[1:]) > (best[0], best[1:])):
            best = row
    return best[2:] if best and number <= best[1] else (0, "", "")


def random_ranges(seed):
    """Nested, overlapping, duplicate and far-apart ranges, from single addresses to whole continents."""
    rng = random.Random(seed)
    rows = [(0, 5, 1, "ZZ", "low"), (2**32 - 3, 2**32 - 1, 2, "YY", "high"), (1 << 24, (3 << 24) - 1, 3, "XX", "huge")]
    for i in range(200):
        start = rng.choice([rng.randrange(2**32), 0x0A000000 + rng.randrange(2000), (1 << 24) + rng.randrange(2**25)])
        rows.append((start, min(start + rng.choice([0, 7, 300, 70000, 2**22]), 2**32 - 1), 10 + i, f"C{i % 7}", f"o{i}"))
    rows += [(r[0], r[1] + 1, r[2] + 1000, "DD", "twin") for r in rows[5:15]]
    edges = [n for r in rows for n in (r[0] - 1, r[0], r[1], r[1] + 1) if 0 <= n < 2**32]
    return rows, edges + [rng.randrange(2**32) for _ in range(300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_lookups_agree_with_the_rule(spark, seed):
    rows, asked = random_ranges(seed)
    ranges = spark.createDataFrame(rows, SCHEMA)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(asked)] + [(-1, None)], "i bigint, n bigint")
    want = {i: by_rule(rows, n) for i, n in enumerate(asked)} | {-1: (0, "", "")}
    small, large = enrich.build_range_index(ranges), enrich.build_range_index(ranges, max_broadcast_bytes=0)
    assert small.broadcast and not large.broadcast
    for found in (
        enrich.lookup_ranges(df, F.col("n"), small, NAMES),
        enrich.lookup_ranges(df, F.col("n"), large, NAMES),
        enrich.lookup_ranges_as_of(df, F.col("n"), small, NAMES),
    ):
        assert {r["i"]: (r["asn"], r["country"], r["org"]) for r in found.collect()} == want


def test_large_index_is_merged_at_default_settings(spark):
    rows, _ = random_ranges(3)
    index = enrich.build_range_index(spark.createDataFrame(rows, SCHEMA), max_broadcast_bytes=0)
    addresses = spark.createDataFrame([("10.0.0.1", "::1")], "src_ip string, dst_ip string")
    plan = enrich.enrich_asn(addresses, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_addresses_without_ipv4_do_not_meet(spark):
    rows, _ = random_ranges(4)
    index = enrich.build_range_index(spark.createDataFrame(rows, SCHEMA), max_broadcast_bytes=0)
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(None).cast("long")).otherwise(F.lit(0x0A000001)).alias("n"))
    keys = df.select(F.coalesce(F.shiftright("n", index.shift), enrich._no_match(df.columns)).alias("k"), "n").where("n IS NULL")
    assert keys.select("k").distinct().count() > 1900 and keys.where("k >= 0").isEmpty()


def crowded_ranges():
    """Blocks of a few addresses side by side, as thousands of small networks in one /16, within wider ones."""
    rng = random.Random(6)
    rows = [(0x0A000000 + i * 10, 0x0A000000 + i * 10 + 7, i + 1, f"C{i % 7}", f"o{i}") for i in range(6000)]
    rows += [(0x0B000000 + i * 3, 0x0B000000 + i * 3, i + 1, "D", f"single {i}") for i in range(300)]
    rows += [(0x0B000500, 0x0B00FFFF, 7, "E", "rest"), (0x09F00000, 0x09FFFFFF, 8, "F", "before"), (2**32 - 9, 2**32 - 1, 9, "G", "end")]
    rows += [(2**32 - 3000 + i * 8, 2**32 - 3000 + i * 8 + 5, i, "H", "high") for i in range(370)]
    edges = [n for r in rng.sample(rows, 700) + rows[6000:] for n in (r[0] - 1, r[0], r[1], r[1] + 1) if 0 <= n < 2**32]
    return rows, edges + [0x0A000000 + rng.randrange(70000) for _ in range(500)] + [0x0B000000 + rng.randrange(70000) for _ in range(500)]


def test_crowded_buckets_are_cut(spark):
    rows, asked = crowded_ranges()
    ranges = spark.createDataFrame(rows, SCHEMA)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(asked)] + [(-1, None)], "i bigint, n bigint")
    ordered = sorted(rows)
    starts = [r[0] for r in ordered]

    def rule(n):
        at = bisect.bisect_right(starts, n)
        return by_rule(ordered[at - 1 : at], n)

    want = {i: rule(n) for i, n in enumerate(asked)} | {-1: (0, "", "")}
    for index in (enrich.build_range_index(ranges), enrich.build_range_index(ranges, max_broadcast_bytes=0)):
        assert index.crowded is not None
        assert index.buckets.groupBy("cell").count().agg(F.max("count")).first()[0] <= 16  # the widest comparison
        assert index.buckets.count() <= 4 * len(rows) + 2 ** (32 - index.shift)
        for lookup in (enrich.lookup_ranges, enrich.lookup_ranges_as_of):
            assert {r["i"]: (r["asn"], r["country"], r["org"]) for r in lookup(df, F.col("n"), index, NAMES).collect()} == want


def test_mapped_spellings_are_ipv4(spark):
    texts = ["1.0.0.7", "::ffff:1.0.0.7", "::FFFF:100:7", "0:0:0:0:0:ffff:1.0.0.7", "0:0:0:0:0:FFFF:0100:0007", "::1.0.0.7", "1:0:0:0:0:ffff:100:7", "x", None]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(any_ipv4_number(F.col("t")).alias("n")).collect()]
    assert got == [0x01000007] * 5 + [None] * 4


def test_city_leaves_other_addresses_alone(spark):
    index = enrich.build_range_index(spark.createDataFrame(CITY, "start long, end long, country string, region string, city string"), enrich.CITY_VALUES)
    old = {"src_region": "R0", "src_city": "C0", "src_country": "K0"}
    rows = [{"src_ip": ip, **old} for ip in ("2001:db8::1", "0.0.0.0", "bad", "1.0.0.9", "9.9.9.9")]
    for mode, country in (("override", "CN"), ("premium", "K0")):
        got = {r["src_ip"]: (r["src_country"], r["src_region"], r["src_city"]) for r in enrich.enrich_city(flows(spark, *rows), index, mode).collect()}
        assert {got[ip] for ip in ("2001:db8::1", "0.0.0.0", "bad")} == {("K0", "R0", "C0")}
        assert got["1.0.0.9"] == (country, "Shandong", "Jinan") and got["9.9.9.9"] == ("K0", "", "")


def test_index_size_is_bounded(spark):
    rows, _ = random_ranges(5)
    index = enrich.build_range_index(spark.createDataFrame(rows, SCHEMA))
    assert index.buckets.count() <= len(rows) + 2 ** (32 - index.shift)


A = [(0x01000000, 0x010000FF, 65001, "US", "ORG")]
CITY = [(0x01000000, 0x010000FF, "CN", "Shandong", "Jinan"), (0x02000000, 0x020000FF, "", "R", "C")]


def test_geo_precedence_and_unknowns(spark):
    asn = enrich.build_range_index(spark.createDataFrame(A, SCHEMA))
    city = enrich.build_range_index(
        spark.createDataFrame(CITY, "start bigint, end bigint, country string, region string, city string"),
        enrich.CITY_VALUES,
    )
    rows = flows(
        spark,
        {"src_ip": "1.0.0.5", "dst_ip": "2.0.0.1", "src_port": 1},
        {"src_ip": "2001:db8::1", "dst_ip": "0.0.0.0", "src_port": 2},
        {"src_ip": "::ffff:1.0.0.5", "dst_ip": "192.168.0.1", "src_port": 3},
    )
    got = {r["src_port"]: r for r in enrich.enrich_flows(rows, asn=asn, city=city).collect()}
    f = got[1]
    assert (f["src_country"], f["src_region"], f["src_city"]) == ("CN", "Shandong", "Jinan")
    assert (f["src_asn"], f["src_org"], f["dst_city"], f["dst_country"]) == (65001, "ORG", "C", "")
    assert (got[2]["src_asn"], got[2]["src_country"], got[2]["src_city"], got[2]["dst_city"]) == (0, "", "", "")
    assert (got[3]["src_asn"], got[3]["src_city"]) == (65001, "")
    premium = {r["src_port"]: r for r in enrich.enrich_flows(rows, asn=asn, city=city, premium_city=city).collect()}
    assert (premium[1]["src_country"], premium[1]["src_city"]) == ("US", "Jinan")
    assert enrich.enrich_flows(rows, asn=asn).columns == rows.columns


def test_classification(spark):
    cases = [
        (6, 54321, 443, "https"), (6, 443, 54321, "https"), (17, 40000, 443, "quic"), (6, 40000, 9999, "tcp/9999"),
        (6, 0, 0, "tcp"), (17, 0, 0, "udp"), (17, 5, 65535, "udp/65535"), (6, 22, 80, "http"), (1, 0, 0, "icmp"),
        (132, 0, 0, "sctp"), (200, 0, 0, "proto/200"), (2, 1, 1, "igmp"), (6, 1, 5433, "pgbouncer"),
    ]
    df = spark.createDataFrame(cases, "p int, s int, d int, want string")
    got = df.withColumn("got", classify_application(F.col("p"), F.col("s"), F.col("d"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_protocol_names(spark):
    df = spark.createDataFrame([(6,), (253,), (2,)], "p int")
    rows = df.select(protocol_name(F.col("p")), protocol_name(F.col("p"), "display")).collect()
    assert [tuple(r) for r in rows] == [("tcp", "TCP"), ("other", "protocol 253"), ("other", "IGMP")]


def test_city_lookup_reuses_numbers_of_the_system_lookup(spark):
    """Addresses are parsed once for both lookups, and odd spellings still mean to each lookup what they mean to it alone."""
    asn = enrich.build_range_index(spark.createDataFrame(A, SCHEMA))
    city = enrich.build_range_index(spark.createDataFrame(CITY, "start long, end long, country string, region string, city string"), enrich.CITY_VALUES)
    texts = ["1.0.0.5", "001.0.0.05", "::ffff:1.0.0.5", "::ffff:100:5", "0.0.0.0", "2.0.0.1", "2001:db8::1", "1.0.0", ""]
    rows = flows(spark, *[{"src_ip": t, "dst_ip": u} for t, u in zip(texts, reversed(texts), strict=True)])
    for mode, tables in (("override", {"city": city}), ("premium", {"premium_city": city})):
        both = enrich.enrich_flows(rows, asn=asn, **tables)
        apart = enrich.enrich_application(enrich.enrich_city(enrich.enrich_asn(rows, asn), city, mode))
        assert both.columns == rows.columns
        assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
        plan = both._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE(src_ip") == 2 and "_src_number" in plan
