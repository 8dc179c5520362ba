"""Tables kept by streams: late flows, newest rows, range tables that change."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from builders import at, flows
from fluxlens.model import FLOW_SCHEMA
from fluxlens.operators.rollup import build_rollup_1m, compact_rollup
from fluxlens.operators.upkeep import latest_per_key
from fluxlens.operators.versions import build_versioned_index, enrich_asn_as_of
from fluxlens.sources import latest, tables
from fluxlens.streaming import ingest, late

START = at("2026-08-01T00:00:00")


def rows_in(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_shuffled_flows_give_the_rollup_of_sorted_ones(spark, tmp_path, monkeypatch):
    path, side, marks, state, folder = (str(tmp_path / n) for n in ("rollup", "late", "marks", "state", "in"))
    rng = random.Random(3)
    rows = [dict(timestamp=START + timedelta(seconds=rng.randrange(7200)), src_ip=f"10.0.0.{i % 5}", dst_ip="10.1.0.1", bytes=i, packets=1) for i in range(300)]
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(FLOW_SCHEMA).parquet(folder)

    def run():
        late.start_corrected_rollup(live, path, side, marks, state, stream="a", available_now=True).awaitTermination()

    def dies(*_):
        raise OSError("killed")

    for part in range(3):
        flows(spark, *rows[part::3]).coalesce(1).write.mode("append").parquet(folder)
        if part == 1:
            with monkeypatch.context() as patch:
                patch.setattr(late, "write_batch", dies)
                with pytest.raises(StreamingQueryException, match="killed"):
                    run()
        run()
    whole = tables.stored_form(flows(spark, *rows))
    got = compact_rollup(tables.read_rollup(spark, path))
    assert rows_in(got) == rows_in(build_rollup_1m(whole))
    newest, expected = None, 0
    for part in range(3):
        times = [r["timestamp"] for r in rows[part::3]]
        expected += sum(newest is not None and t.replace(second=0) + timedelta(minutes=1) <= newest - timedelta(minutes=1) for t in times)
        newest = max(times) if newest is None else max(newest, *times)
    assert spark.read.parquet(side).count() == expected > 50
    corrections = spark.read.parquet(path).where(F.col("stream") == "a-late").agg(F.sum("flows")).first()[0]
    assert corrections == expected


def test_newest_rows_in_any_order_with_repeats_and_merges(spark, tmp_path):
    path, folder, state = (str(tmp_path / n) for n in ("latest", "in", "state"))
    rng = random.Random(4)
    rows = [(f"10.0.0.{rng.randrange(40)}", rng.randrange(1000), rng.choice("abc"), None if i % 9 else i) for i in range(900)] + [(None, 1, "x", 1), (None, 5, "y", 2)]
    schema = "ip string, updated_at long, name string, port int"
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(schema).parquet(folder)
    rng.shuffle(rows)
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(folder)
        latest.start_latest(live, path, state, stream="meta", buckets=8, available_now=True).awaitTermination()
        latest.upsert_latest(spark.createDataFrame(rows[:50], schema), path, "again", 1, buckets=8)
        if part:
            assert latest.merge_latest(spark, path)
            assert latest.merge_latest(spark, path) == []
    want = latest_per_key(spark.createDataFrame(rows, schema))
    assert rows_in(latest.read_latest(spark, path)) == rows_in(want)
    few = latest.read_latest(spark, path, keys=["10.0.0.1", "10.0.0.7", "none"], buckets=8)
    assert rows_in(few) == rows_in(want.where(F.col("ip").isin("10.0.0.1", "10.0.0.7")))
    assert "PartitionFilters: [bucket" in few._jdf.queryExecution().executedPlan().toString()
    assert latest.read_latest(spark, path, keys=[]).isEmpty()


def test_a_merge_that_dies_changes_no_answer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "latest")
    for batch in range(3):
        latest.upsert_latest(spark.createDataFrame([("a", batch, batch), ("b", -batch, batch)], "ip string, updated_at long, n int"), path, "s", batch, buckets=1)
    with monkeypatch.context() as patch:
        patch.setattr(latest.Folder, "delete", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            latest.merge_latest(spark, path)
    assert rows_in(latest.read_latest(spark, path)) == [("a", 2, 2), ("b", 0, 0)]
    latest.merge_latest(spark, path)
    assert rows_in(latest.read_latest(spark, path)) == [("a", 2, 2), ("b", 0, 0)]


def snapshot(spark, *rows):
    return spark.createDataFrame(list(rows), "valid_from timestamp, start long, end long, asn long, country string, org string")


def test_history_keeps_its_ranges_and_a_stream_takes_new_ones_at_a_batch_border(spark, tmp_path):
    ten = 10 << 24
    first = (START + timedelta(hours=1), ten, ten + 255, 1, "AA", "one")
    second = (START + timedelta(hours=2), ten + 128, ten + 200, 2, "BB", "two")
    asked = flows(spark, *[dict(timestamp=START + timedelta(hours=h), src_ip=ip, dst_ip="::1", bytes=h) for h in (0, 1, 2, 3) for ip in ("10.0.0.1", "10.0.0.150", "::ffff:10.0.0.200", "2001:db8::1")])
    for limit in (0, 1 << 29):  # joined by shuffle and by broadcast
        both = build_versioned_index(snapshot(spark, first, second, (None, 0, 2**32 - 1, 9, "ZZ", "never")), max_broadcast_bytes=limit)
        got = {(r.bytes, r.src_ip): r.src_asn for r in enrich_asn_as_of(asked, both).collect()}
        assert got == {(h, ip): (0 if h == 0 or ip == "2001:db8::1" else 1 if h == 1 else 0 if ip == "10.0.0.1" else 2) for h, ip in got}
    anew = enrich_asn_as_of(asked, both, F.lit(START + timedelta(hours=1, minutes=30)))
    assert {r.src_asn for r in anew.where("src_ip = '10.0.0.150'").collect()} == {1}
    assert enrich_asn_as_of(asked, build_versioned_index(snapshot(spark))).where("src_asn <> 0").isEmpty()

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    known = [first]
    live = spark.readStream.schema(FLOW_SCHEMA)
    for batch in range(2):
        asked.where(f"bytes = {batch + 2}").coalesce(1).write.mode("append").parquet(folder)
        ingest.start_flow_ingest(
            live.parquet(folder), out, state, stream="a", enrich_batch=lambda rows: enrich_asn_as_of(rows, build_versioned_index(snapshot(spark, *known))), available_now=True
        ).awaitTermination()
        known.append(second)
    stored = {(r.bytes, r.src_ip): r.src_asn for r in tables.read_flows(spark, out).where("src_asn <> 0").collect()}
    assert stored == {(2, "10.0.0.1"): 1, (2, "10.0.0.150"): 1, (2, "10.0.0.200"): 1, (3, "10.0.0.150"): 2, (3, "10.0.0.200"): 2}
