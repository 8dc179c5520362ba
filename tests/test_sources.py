from __future__ import annotations

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from builders import at, ethernet, ipv4, netflow, raw_header, sample, sflow, words
from fluxlens.operators.enrich import build_range_index, lookup_ranges
from fluxlens.sources import frames, netflow as nf, ranges, sample_events, sflow as sf

ASN_TSV = (
    "20.1.0.0\t20.1.0.255\t64601\tDE\tNORDNETZ\n"
    "20.1.1.0\t20.1.3.255\t0\tNone\tUnassigned\n"
    "44.7.8.0\t44.7.8.127\t64602\tBR\tRIO-FIBRA\n"
    "198.18.5.0\t198.18.5.255\t64603\tKE\tSAVANNAH\n"
)
CITY_CSV = """0.0.0.0,0.127.255.255,ZZ,ZZ,,,0,0
20.1.0.0,20.1.0.255,EU,DE,Bremen,Bremen,53.0793,8.8017
20.1.1.0,20.1.3.255,EU,PL,Pomerania,"Gdansk Port",54.4069,18.6635
44.7.8.0,44.7.8.127,SA,BR,Bahia,"Feira de Santana",-12.2664,-38.9663
198.18.5.0,198.18.5.255,AF,KE,Nakuru,"Naivasha, South",-0.7172,36.4310
"""


def test_asn_tsv_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(ASN_TSV)
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write(ASN_TSV)
    for name in ("a.tsv", "b.tsv.gz"):
        rows = ranges.load_asn_tsv(spark, str(tmp_path / name)).orderBy("start").collect()
        assert [r["asn"] for r in rows] == [64601, 64602, 64603]
        assert rows[1].asDict() == {
            "start": 0x2C070800, "end": 0x2C07087F, "asn": 64602, "country": "BR", "org": "RIO-FIBRA",
        }


def test_asn_tsv_dirty_and_empty(spark, tmp_path):
    dirty = "# comment\nnot a tsv line\n" + ASN_TSV.split("\n")[0] + "\nbad.ip\t1.0.0.1\t5\tUS\tX\n1.1.1.0\t1.1.1.1\tAS5\tUS\tX\n\n"
    (tmp_path / "d.tsv").write_text(dirty + ASN_TSV.split("\n")[2] + "\n")
    assert ranges.load_asn_tsv(spark, str(tmp_path / "d.tsv")).count() == 2
    for i, text in enumerate(("", "<html>error</html>\n")):
        (tmp_path / f"e{i}.tsv").write_text(text)
        with pytest.raises(ValueError, match="no valid row"):
            ranges.load_asn_tsv(spark, str(tmp_path / f"e{i}.tsv"))


def test_asn_csv_has_no_country(spark, tmp_path):
    text = '20.1.0.0,20.1.0.255,64601,"Nordnetz, AG"\n20.1.1.0,20.1.1.255,0,none\n20.1.2.0,20.1.2.255\n'
    (tmp_path / "a.csv").write_text(text)
    rows = ranges.load_asn_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["asn"], r["country"], r["org"]) for r in rows] == [(64601, "", "Nordnetz, AG")]


def test_city_csv(spark, tmp_path):
    extra = "9.9.9.0,9.9.9.255,EU,DE,,,x,\n7.7.7.0,7.7.7.255,EU,DE,short\n6.6.6.0,6.6.6.999,EU,DE,A,B,1,2\n"
    (tmp_path / "c.csv").write_text(CITY_CSV + extra)
    rows = {r["start"] >> 24: r for r in ranges.load_city_csv(spark, str(tmp_path / "c.csv")).orderBy("start").collect()}
    assert len(rows) == 4  # 20.x holds two ranges
    assert rows[198]["city"] == "Naivasha, South" and rows[198]["country"] == "KE"
    assert rows[44]["latitude"] == pytest.approx(-12.2664, rel=1e-6)
    assert (rows[9]["latitude"], rows[9]["longitude"], rows[9]["city"]) == (0.0, 0.0, "")
    (tmp_path / "bad.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        ranges.load_city_csv(spark, str(tmp_path / "bad.csv"))


def test_loaded_ranges_answer_lookups(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(ASN_TSV)
    index = build_range_index(ranges.load_asn_tsv(spark, str(tmp_path / "a.tsv")))
    asked = [(0x2C070808, 64602), (0x2C070701, 0), (0x2C070880, 0), (1, 0), (0x14010201, 0), (0xC6120507, 64603)]
    df = spark.createDataFrame(asked, "n bigint, want bigint")
    names = {"asn": "asn", "country": "country", "org": "org"}
    assert all(r["asn"] == r["want"] for r in lookup_ranges(df, F.col("n"), index, names).collect())


RECORD = dict(
    src="192.0.2.77", dst="198.18.0.9", sport=51515, dport=8443, proto=6, flags=0x12,
    packets=37, bytes=5550, first=41000, last=47500, input=12, output=34,
)


def _netflow(spark, *payloads, exporter="10.44.0.5"):
    df = spark.createDataFrame([(p, exporter) for p in payloads], "payload binary, exporter string")
    return df, nf.decode_netflow_v5(df).collect()


def test_netflow_basic(spark):
    _, rows = _netflow(spark, netflow(1, 50000, 1700000500, 0, RECORD))
    f = rows[0]
    assert (f["src_ip"], f["dst_ip"], f["src_port"], f["dst_port"]) == ("192.0.2.77", "198.18.0.9", 51515, 8443)
    assert (f["protocol"], f["tcp_flags"], f["input_interface"], f["output_interface"]) == (6, 0x12, 12, 34)
    assert (f["packets"], f["observed_packets"], f["sampling_rate"], f["source_type"]) == (37, 37, 1, "NETFLOW")
    assert f["timestamp"].timestamp() == 1700000500 - 9 and f["timestamp_end"].timestamp() == 1700000500 - 2.5
    assert f["duration_ms"] == 6500 and f["device_id"] == 0x0A2C0005


def test_netflow_wraparound_sampling_and_v6_exporter(spark):
    wrapped = {**RECORD, "first": 4294000000, "last": 0}
    _, rows = _netflow(spark, netflow(1, 1000, 1700000500, (1 << 14) | 20, wrapped), exporter="2001:db8::1:5")
    f = rows[0]
    assert f["timestamp"].timestamp() == f["timestamp_end"].timestamp() == 1700000500
    assert (f["packets"], f["observed_packets"], f["bytes"], f["observed_bytes"]) == (740, 37, 111000, 5550)
    assert f["device_id"] == 0x10005


def test_netflow_rejects(spark):
    good = netflow(30, 1, 1, 0, *[RECORD] * 30)
    bad = [
        struct.pack(">H", 9) + good[2:], netflow(100, 1, 1, 0, RECORD), netflow(31, 1, 1, 0, *[RECORD] * 31),
        netflow(2, 1, 1, 0, RECORD), netflow(0, 1, 1, 0), good[:20], b"", None,
    ]
    df, rows = _netflow(spark, good, *bad)
    assert len(rows) == 30
    status = {r["status"]: r["datagrams"] for r in nf.count_datagrams(df).collect()}
    assert status == {"ok": 1, "bad_version": 1, "too_many_records": 2, "truncated": 1, "empty": 1, "too_short": 3}


def _sflow(spark, *payloads, exporter="192.0.2.99", **options):
    received = at("2026-08-01T12:00:00")
    df = spark.createDataFrame(
        [(p, exporter, received) for p in payloads], "payload binary, exporter string, recv_ts timestamp"
    )
    return df, sf.decode_sflow_v5(df, **options).collect()


FRAME = ethernet(ipv4(total=1500, flags=2))


def test_sflow_basic(spark):
    _, rows = _sflow(spark, sflow(sample(raw_header(FRAME, 1514))))
    f = rows[0]
    assert (f["src_ip"], f["dst_ip"], f["src_port"], f["dst_port"]) == ("203.0.113.7", "198.51.100.1", 40000, 443)
    assert (f["input_interface"], f["output_interface"], f["src_mac"]) == (3, 5, "aa:bb:cc:dd:ee:ff")
    assert (f["sampling_rate"], f["packets"], f["observed_packets"]) == (1000, 1000, 1)
    assert (f["bytes"], f["observed_bytes"], f["duration_ms"]) == (1514000, 1514, 0)
    assert f["device_id"] == 0x0A000009 and f["timestamp"].timestamp() == at("2026-08-01T12:00:00").timestamp()


def test_sflow_variants(spark):
    counter = words(2, 8) + bytes(8)
    foreign = words(1001, 16) + bytes(16)
    bare = raw_header(ipv4(total=1500), 0, protocol=11)
    broken = sample(words(1, 999) + bytes(8))  # a record that overruns its sample
    mixed = sflow(counter, broken, sample(foreign + bare, rate=0, count=2, expanded=True), agent="0.0.0.0")
    _, rows = _sflow(spark, mixed)
    assert len(rows) == 1  # siblings of the broken sample survive
    f = rows[0]
    assert (f["bytes"], f["sampling_rate"], f["input_interface"], f["output_interface"]) == (1500, 1, 3, 5)
    assert f["device_id"] == 0xC0000263  # no agent address: the exporter's
    assert _sflow(spark, sflow(sample(raw_header(FRAME, 100), count=65)))[1] == []
    assert len(_sflow(spark, sflow(sample(raw_header(FRAME, 100)), count=3))[1]) == 1  # fewer samples than announced
    swapped = words(1, 0, 0, 0, 8, 0, 9, 500, 0, 0, 1) + raw_header(FRAME, 100)
    _, rows = _sflow(spark, sflow(words(3, len(swapped)) + swapped), interfaces_first=True)
    assert (rows[0]["sampling_rate"], rows[0]["input_interface"], rows[0]["output_interface"]) == (500, 8, 9)


def test_sflow_rejects_and_truncation(spark):
    good = sflow(sample(raw_header(FRAME, 100)))
    overrun = sflow(sample(raw_header(FRAME, 100)), words(1, 999999) + bytes(8))
    df, rows = _sflow(spark, good, sflow(version=4), sflow(count=999999), overrun, b"", None)
    assert len(rows) == 1
    status = {r["status"]: r["datagrams"] for r in sf.count_datagrams(df).collect()}
    assert status == {"ok": 1, "bad_version": 1, "too_many_samples": 1, "sample_overrun": 1, "too_short": 2}
    _, rows = _sflow(spark, *[good[:n] for n in range(len(good))])
    assert rows == []


def _frames(spark, *cases):
    df = spark.createDataFrame([(i, f, link) for i, (f, link) in enumerate(cases)], "i int, frame binary, link_type int")
    return df, frames.parse_frames(df).orderBy("i").collect()


def test_frames_parse(spark):
    _, rows = _frames(
        spark,
        (ethernet(ipv4()), 1),
        (ethernet(ipv4(), vlan=100), 1),
        (ipv4(words=8, sport=12345, dport=8080), 12),
        (ipv4(total=1500, l4=4), 12),
        (bytes([2, 0, 0, 0]) + ipv4(proto=17, dport=53, l4=8), 0),
        (bytes([0, 0, 0, 2]) + ipv4(proto=1, l4=8), 108),
        (ipv4(proto=47, l4=8), 12),
    )
    assert all(r["reject"] is None for r in rows)
    assert [r["dst_port"] for r in rows] == [443, 443, 8080, 443, 53, 0, 0]
    assert [r["tcp_flags"] for r in rows] == [0x18, 0x18, 0x18, 0, 0, 0, 0]
    assert [r["vlan"] for r in rows] == [0, 100, 0, 0, 0, 0, 0]
    assert rows[3]["length"] == 1500 and rows[6]["length"] == 28
    assert (rows[0]["src_mac"], rows[0]["dst_mac"], rows[2]["src_mac"]) == ("aa:bb:cc:dd:ee:ff", "00:11:22:33:44:55", "")


def test_frames_rejected(spark):
    v6 = bytes([0x60]) + bytes(39)
    cases = [
        (ethernet(v6, kind=0x86DD), 1, "not_ipv4"), (v6, 12, "not_ipv4"), (bytes([30, 0, 0, 0]) + ipv4(), 0, "not_ipv4"),
        (ipv4(frag=1), 12, "fragment"), (ipv4()[:19], 12, "too_short"), (b"", 12, "too_short"),
        (ethernet(ipv4())[:13], 1, "too_short"), (ethernet(ipv4(), vlan=5)[:16], 1, "too_short"), (b"ab", 0, "too_short"),
        (ipv4(l4=3), 12, "too_short"), (ipv4(total=10), 12, "too_short"), (ipv4(words=8)[:28], 12, "too_short"),
        (ipv4(), 99, "unsupported_link"), (ipv4(), None, "unsupported_link"),
    ]
    df, rows = _frames(spark, *[(f, link) for f, link, _ in cases])
    assert [r["reject"] for r in rows] == [want for _, _, want in cases]
    assert sum(r["frames"] for r in frames.count_rejects(df).collect()) == len(cases)
    assert frames.decode_frames(df).count() == 0


def test_sample_events(spark):
    def event(proto, direction, segments):
        return bytes([10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack("<HHHBBHH", 54321, 443, 1420, proto, direction, segments, 0)

    df = spark.createDataFrame([(event(6, 1, 17),), (event(17, 0, 0),), (event(6, 1, 1)[:19],)], "payload binary")
    rows = sample_events.decode_sample_events(df).orderBy("protocol").collect()
    assert [(r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"], r["length"]) for r in rows] == [
        ("10.0.0.1", "10.0.0.2", 54321, 443, 1420)
    ] * 2
    assert [(r["egress"], r["packets"]) for r in rows] == [(True, 17), (False, 1)]


def test_sflow_sample_statuses(spark):
    record = raw_header(FRAME, 1514)
    good, many = sample(record), sample(record * 65, count=65)
    short, counter, overrun = words(1, 4, 7), words(2, 4, 7), sample(words(1, 4000), count=1)
    df, rows = _sflow(spark, sflow(good, many, short, counter, overrun, sample(record, expanded=True)), b"junk")
    assert len(rows) == 2
    found = {r["status"]: r["samples"] for r in sf.count_samples(df).collect()}
    assert found == {"ok": 2, "too_many_records": 1, "too_short": 1, "not_a_flow_sample": 1, "sample_overrun": 1}
