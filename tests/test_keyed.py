"""Keyed windows: the flow cap on a stream, restarts, and windows that close in silence."""

from __future__ import annotations

import random
import time
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from fluxlens.model import OBSERVATION_SCHEMA
from fluxlens.operators.observations import FIVE_TUPLE, admit_first_flows, aggregate_windows, dropped_observations, windows_to_flows
from fluxlens.sources import tables
from fluxlens.streaming import keyed, windows
from test_observations import START, observe, packet
from workload import catalog

COLUMNS = ["timestamp", "timestamp_end", *FIVE_TUPLE, "packets", "bytes", "observed_packets", "tcp_flags", "vlan"]


def rows_of(frame, *columns) -> list[tuple]:
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def burst(rng: random.Random, begin: float, count: int, jitter: float) -> list[tuple]:
    """Packets in arrival order; event times run on with some disorder, and some ports come again and again."""
    rows = []
    for i in range(count):
        second = max(0.0, begin + i * 30 / count - rng.random() * jitter)
        rows.append(packet(round(second, 3), rng.choice([443, 80, rng.randrange(1, 500)]), rng.randrange(40, 1500), rng.choice([None, 0, 3]), rng.randrange(64), rng.randrange(9)))
    return rows


@pytest.mark.parametrize("cap", [1, 5, 40])
def test_cap_equals_the_batch_rule_over_many_batches_and_restarts(spark, tmp_path, cap):
    rng = random.Random(cap)
    folder, out, report, state = (str(tmp_path / n) for n in ("in", "flows", "report", "state"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(OBSERVATION_SCHEMA).parquet(folder)

    def run():  # every run is a restart from the checkpoint
        keyed.start_capped_ingest(stream, out, report, state, stream="local", lateness="15 seconds", max_flows=cap, available_now=True).awaitTermination()

    seen = []
    for batch in range(4):
        seen += (rows := burst(rng, batch * 30, 300, 8.0))
        observe(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
        run()
    windows.write_end_marker(spark, folder, START + timedelta(days=1))
    run()
    whole = aggregate_windows(observe(spark, *seen))
    want = windows_to_flows(admit_first_flows(whole, cap))
    assert rows_of(tables.read_flows(spark, out), *COLUMNS) == rows_of(tables.stored_form(want), *COLUMNS)
    assert rows_of(spark.read.parquet(report), "window_start", "flows", "dropped") == rows_of(dropped_observations(whole, cap), "window_start", "flows", "dropped")


def test_batch_that_dies_between_its_two_tables_counts_once(spark, tmp_path, monkeypatch):
    folder, out, report, state = (str(tmp_path / n) for n in ("in", "flows", "report", "state"))
    observe(spark, *[packet(i / 10, i) for i in range(50)]).write.parquet(folder)
    windows.write_end_marker(spark, folder, START + timedelta(days=1))
    live = spark.readStream.schema(OBSERVATION_SCHEMA).parquet(folder)

    def run():
        keyed.start_capped_ingest(live, out, report, state, stream="local", max_flows=7, available_now=True).awaitTermination()

    def dies(rows, *_):
        raise OSError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(keyed, "write_batch", dies)
        with pytest.raises(StreamingQueryException, match="killed"):
            run()
    run()
    assert tables.read_flows(spark, out).count() == 7
    assert rows_of(spark.read.parquet(report), "flows", "dropped") == [(7, 43)]


def test_state_is_bounded_by_cap_and_watermark():
    def flows(count, first):
        ports = range(count)
        return pd.DataFrame({"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": ports, "protocol": 6, "first_us": [first + p for p in ports], "observations": 1})

    assert len(keyed.settled_flows(flows(1000, 0), 10, watermark_us=5)) == 1000  # six are final, so any may still be among ten
    kept = keyed.settled_flows(flows(1000, 0), 10, watermark_us=500)
    assert list(kept["first_us"]) == list(range(10))


def test_partial_sums_equal_sums_of_rows():
    rng = random.Random(9)
    rows = pd.DataFrame(
        [{"src_ip": rng.choice("ab"), "dst_ip": "x", "src_port": 1, "dst_port": rng.randrange(3), "protocol": 6, "first_us": (t := rng.randrange(99)), "vlan_at": t * 65536 + rng.randrange(9),
          "last_us": t, "packets": 1, "bytes": rng.randrange(99), "observations": 1, "tcp_flags": 1 << rng.randrange(6)} for _ in range(500)]
    )
    once = keyed.summed(rows, list(FIVE_TUPLE))
    twice = keyed.summed(pd.concat([keyed.summed(rows[:200], list(FIVE_TUPLE)), rows[200:]]), list(FIVE_TUPLE))
    order = [*FIVE_TUPLE]
    pd.testing.assert_frame_equal(once.sort_values(order, ignore_index=True), twice.sort_values(order, ignore_index=True))
    assert once["observations"].sum() == 500 and keyed.summed(rows[:0], list(FIVE_TUPLE)).empty


def test_quiet_stream_emits_its_last_window_without_a_marker(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = burst(random.Random(1), 0, 200, 5.0)
    observe(spark, *rows).coalesce(2).write.parquet(folder)
    live = spark.readStream.schema(OBSERVATION_SCHEMA).parquet(folder)
    closed = windows_to_flows(keyed.stream_windows_until_silent(live, idle_seconds=2))
    sink = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
    query = sink.trigger(processingTime="1 second").start()
    try:
        want = rows_of(windows_to_flows(aggregate_windows(observe(spark, *rows))), *COLUMNS)
        until = time.time() + 90
        while time.time() < until:
            got = rows_of(spark.read.schema(closed.schema).parquet(out), *COLUMNS) if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(got) >= len(want):
                break
            time.sleep(1)
        assert got == want
    finally:
        query.stop()


def test_quiet_stream_of_many_windows_has_few_states(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [packet(i * 13.7, i % 9, 40 + i % 50) for i in range(3000)]
    observe(spark, *rows).coalesce(2).write.parquet(folder)
    live = spark.readStream.schema(OBSERVATION_SCHEMA).parquet(folder)
    closed = windows_to_flows(keyed.stream_windows_until_silent(live, idle_seconds=2))
    sink = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
    query = sink.trigger(processingTime="1 second").start()
    try:
        until, held = time.time() + 90, []
        while time.time() < until and not (any(held) and held[-1] == 0):
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            time.sleep(0.5)
    finally:
        query.stop()
    assert 0 < max(held) <= keyed.SILENT_SHARES and held[-1] == 0
    want = windows_to_flows(aggregate_windows(observe(spark, *rows)))
    assert rows_of(spark.read.schema(closed.schema).parquet(out), *COLUMNS) == rows_of(want, *COLUMNS)


def test_quiet_stream_has_no_more_state_partitions_than_cores(spark, sf_dir, monkeypatch):
    seen, silent = [], catalog._silent

    def watched(running):
        seen.extend(p["stateOperators"][0]["numShufflePartitions"] for p in running.recentProgress if p["stateOperators"])
        return silent(running)

    monkeypatch.setattr(catalog, "_silent", watched)
    chosen = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        windows_of = catalog.QUERIES["t05_quiet_stream"](spark, sf_dir)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", chosen)
    assert set(seen) == {8}  # four cores, and never fewer than eight
    assert windows_of.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_multiple_inputs_start_with_state_per_core(spark, sf_dir, monkeypatch):
    def started(*_, **__):
        raise InterruptedError(spark.conf.get("spark.sql.shuffle.partitions"))

    monkeypatch.setattr(catalog.ingest, "start_flow_ingest", started)
    chosen = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        with pytest.raises(InterruptedError, match="^8$"):
            catalog.QUERIES["t04_multiple_inputs"](spark, sf_dir)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", chosen)
