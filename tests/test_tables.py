from __future__ import annotations

import shutil
from datetime import date, timedelta

import pytest

from builders import at, flows
from fluxlens import build_rollup_1m
from fluxlens.model import STORED_SCHEMA
from fluxlens.operators.upkeep import latest_per_key, retain, table_profile
from fluxlens.sources import tables

START = at("2026-08-01T23:59:59.123456")


def day_rows(spark):
    return flows(
        spark,
        {"src_ip": "bad", "dst_ip": "10.0.0.1", "bytes": 5, "timestamp": START},
        {"src_ip": "::FFFF:1.2.3.4", "dst_ip": "2001:DB8::0:1", "bytes": 7, "timestamp": START + timedelta(seconds=2)},
    )


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "flows")
    tables.append_flows(day_rows(spark), path)
    tables.append_flows(day_rows(spark), path)
    rows = tables.read_flows(spark, path).orderBy("timestamp").collect()
    assert len(rows) == 4 and {p.name for p in (tmp_path / "flows").glob("flow_date=*")} == {
        "flow_date=2026-08-01", "flow_date=2026-08-02",
    }
    assert rows[0]["src_ip"] == "::" and bytes(rows[0]["src_ip_key"]) == bytes(16)
    assert rows[0]["timestamp"].microsecond == 123000
    assert (rows[3]["src_ip"], rows[3]["dst_ip"]) == ("1.2.3.4", "2001:db8::1")
    assert bytes(rows[3]["src_ip_key"])[10:] == b"\xff\xff\x01\x02\x03\x04"
    part = tables.read_flows(spark, path, START + timedelta(seconds=1), START + timedelta(days=1))
    assert part.count() == 2


def test_repeated_batch_is_harmless(spark, tmp_path):
    path = str(tmp_path / "flows")
    for batch in (1, 2, 2):
        tables.append_flows(day_rows(spark), path, stream="a", batch_id=batch)
    assert tables.read_flows(spark, path).count() == 4
    parts = str(tmp_path / "parts")
    for batch in (1, 2, 2):
        tables.append_rollup(build_rollup_1m(day_rows(spark)), parts, "a", batch)
    assert sum(r["flows"] for r in tables.read_rollup(spark, parts).collect()) == 4
    merged = str(tmp_path / "merged")
    for _ in range(2):
        tables.write_compacted_rollup(tables.read_rollup(spark, parts), merged)
    rows = tables.read_rollup(spark, merged).orderBy("ts_minute").collect()
    assert [(r["bytes"], r["flows"], r["month"]) for r in rows] == [(10, 2, 202608), (14, 2, 202608)]


def test_retention(spark, tmp_path):
    path = str(tmp_path / "flows")
    now = at("2026-08-31T12:00:00")
    days = [{"bytes": 1, "timestamp": now - timedelta(days=d)} for d in range(20)]
    tables.append_flows(flows(spark, *days), path)
    assert len(tables.drop_expired_days(spark, path, now=now, days=5)) == 14
    rows = tables.read_flows(spark, path)
    assert rows.count() == 6 and retain(rows, now=now - timedelta(seconds=-1), days=5).count() == 5
    with pytest.raises(ValueError):
        retain(rows, now=now, days=0)


def test_all_writers_share_one_layout(spark, tmp_path):
    path = str(tmp_path / "flows")
    for stream, batch in (("a", 0), ("b", 0), ("a", 1), (None, None), (None, None)):
        tables.append_flows(day_rows(spark), path, stream, batch)
    rows = tables.read_flows(spark, path)
    assert rows.count() == 10 and rows.columns == STORED_SCHEMA.fieldNames()
    for wrong in (dict(stream="a"), dict(batch_id=1), dict(stream="a/b", batch_id=1), dict(stream="_batch", batch_id=1)):
        with pytest.raises(ValueError):
            tables.append_flows(day_rows(spark), path, **wrong)


def test_compaction_keeps_rows_and_retires_parts(spark, tmp_path):
    path, parts = str(tmp_path / "flows"), str(tmp_path / "rollup")
    for batch in range(3):
        tables.append_flows(day_rows(spark), path, "a", batch)
        tables.append_rollup(build_rollup_1m(day_rows(spark)), parts, "a", batch)
    before = sorted(map(str, tables.read_flows(spark, path).collect()))
    assert tables.compact_flows(spark, path, before=date(2026, 8, 2)) == ["flow_date=2026-08-01"]
    assert tables.compact_flows(spark, path, before=date(2026, 8, 2)) == []
    assert sorted(map(str, tables.read_flows(spark, path).collect())) == before
    assert len(list((tmp_path / "flows" / "flow_date=2026-08-01").glob("*/*"))) == 1
    assert len(list((tmp_path / "flows" / "flow_date=2026-08-02").glob("*/*"))) == 3
    for more in (False, True):
        if more:  # parts that arrive after the first merge
            tables.append_rollup(build_rollup_1m(day_rows(spark)), parts, "a", 3)
        assert tables.compact_rollup_months(spark, parts) == ["month=202608"]
        rows = tables.read_rollup(spark, parts).orderBy("ts_minute").collect()
        assert [r["flows"] for r in rows] == [3 + more, 3 + more]
        assert len(list((tmp_path / "rollup" / "month=202608").glob("*/*"))) == 1
    assert tables.drop_expired_months(spark, parts, now=at("2026-12-01T00:00:00"), days=60) == ["month=202608"]


def test_interrupted_swap_is_finished(spark, tmp_path):
    path = tmp_path / "flows"
    for batch in range(2):
        tables.append_flows(day_rows(spark), str(path), "a", batch)
    before = sorted(map(str, tables.read_flows(spark, str(path)).collect()))
    assert tables.compact_flows(spark, str(path), before=date(2026, 9, 1)) == ["flow_date=2026-08-01", "flow_date=2026-08-02"]
    # as a crash would leave it: one day merged but not in place with the old one set aside, one merge incomplete
    (path / "_compacting").mkdir(exist_ok=True)
    (path / "_retired").mkdir()
    shutil.copytree(path / "flow_date=2026-08-01", path / "_retired" / "flow_date=2026-08-01")
    (path / "flow_date=2026-08-01").rename(path / "_compacting" / "flow_date=2026-08-01")
    (path / "_compacting" / "flow_date=2026-08-01" / "_SUCCESS").touch()
    shutil.copytree(path / "flow_date=2026-08-02", path / "_compacting" / "flow_date=2026-08-02")
    for marker in (path / "_compacting" / "flow_date=2026-08-02").glob("_SUCCESS"):
        marker.unlink()
    assert tables.compact_flows(spark, str(path), before=date(2026, 9, 1)) == []
    assert sorted(map(str, tables.read_flows(spark, str(path)).collect())) == before
    assert not (path / "_retired").exists() and not list((path / "_compacting").iterdir())


def test_profile_and_latest(spark):
    profile = table_profile(day_rows(spark)).first()
    assert (profile["rows"], profile["newest"] - profile["oldest"]) == (2, 2)
    assert tuple(table_profile(day_rows(spark).limit(0)).first()) == (0, None, None)
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "q")], "ip string, updated_at int, city string")
    assert {tuple(r) for r in latest_per_key(rows).collect()} == {("a", 3, "y"), ("b", 1, "q")}


def _shuffled(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_")}


def test_appending_shuffles_nothing_and_jobs_leave_no_shuffle_files(spark, tmp_path):
    path, parts = str(tmp_path / "flows"), str(tmp_path / "rollup")
    before = _shuffled(spark)
    rows = flows(spark, *[{"src_ip": f"10.0.0.{i}", "bytes": i, "timestamp": START + timedelta(hours=i)} for i in range(80)])
    for batch in range(2):
        tables.append_flows(rows.repartition(4, "src_ip"), path, "a", batch)
        tables.append_rollup(build_rollup_1m(tables.read_flows(spark, path)), parts, "a", batch)
    assert len(list((tmp_path / "flows" / "flow_date=2026-08-03").rglob("*.parquet"))) == 8  # each task its own
    for file in (tmp_path / "flows").rglob("*.parquet"):
        times = [r.timestamp for r in spark.read.parquet(str(file)).collect()]
        assert times == sorted(times)
    assert _shuffled(spark) <= before
    assert sum(r["flows"] for r in tables.read_rollup(spark, parts).collect()) == 80 + 160


def test_bloom_filters_of_small_files_are_small(spark, tmp_path):
    path = tmp_path / "flows"
    tables.append_flows(day_rows(spark), str(path), "again", 7)
    tables.append_flows(day_rows(spark), str(path), "again", 7)
    files = list(path.rglob("*.parquet"))
    assert files and max(f.stat().st_size for f in files) < 40_000
