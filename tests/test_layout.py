"""The address layout: same rows, fewer row groups for address ranges."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from builders import at, flows
from fluxlens.functions.ip import cidr_bounds
from fluxlens.model import FLOW_SCHEMA, conform
from fluxlens.operators.query import flow_query
from fluxlens.sources import tables
from fluxlens.sources.layout import Slices, sampled_slices, slice_number, z_key

START = at("2026-08-01T00:00:00")


@pytest.fixture(scope="module")
def day(spark):
    """A day of flows between many hosts, one of them with a third of all rows."""
    raw = spark.range(60_000).selectExpr(
        "timestamp'2026-08-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 86400) AS timestamp",
        "IF(id % 3 = 0, '10.0.7.7', concat('10.', id * 31 % 40, '.', id * 17 % 200, '.', id % 250)) AS src_ip",
        "concat('172.16.', id * 13 % 160, '.', id * 7 % 250) AS dst_ip", "id AS bytes",
    )
    return conform(raw.withColumn("timestamp_end", F.col("timestamp")), FLOW_SCHEMA).persist()


def row_groups(path: str, column: str, block: str) -> tuple[int, int]:
    """Row groups whose minimum and maximum meet a block of addresses, and all row groups."""
    first, last = cidr_bounds(block)
    met = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at_ = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at_).statistics
            total += 1
            met += stats.min <= last and stats.max >= first
    return met, total


def test_fewer_row_groups_for_address_ranges_and_the_same_rows(spark, day, tmp_path):
    plain, path = str(tmp_path / "plain"), str(tmp_path / "clustered")
    # small files stand for the row groups of a large table
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.append_flows(day, plain)
        tables.append_flows(day, path, stream="local", batch_id=3)
        assert tables.compact_flows(spark, path, before=(START + timedelta(days=1)).date(), by_address=True) == ["flow_date=2026-08-01"]
        assert tables.compact_flows(spark, path, before=(START + timedelta(days=1)).date(), by_address=True) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])
    rows = tables.read_flows(spark, path)
    assert rows.exceptAll(tables.read_flows(spark, plain)).isEmpty() and rows.count() == day.count()
    for column, field, block in (("src_ip_key", "src_ip", "10.12.0.0/16"), ("dst_ip_key", "dst_ip", "172.16.40.0/24")):
        before, all_before = row_groups(plain, column, block)
        after, all_after = row_groups(path, column, block)
        assert before == all_before  # by time alone nothing can be skipped
        assert after <= all_after / 3
        asked = dict(time_from=START, time_to=START + timedelta(days=1), group_by=("src_ip",), metrics=("bytes", "flows"), filters={"field": field, "operator": "cidr", "value": block})
        got = flow_query(rows, **asked).collect()
        assert got and got == flow_query(tables.read_flows(spark, plain), **asked).collect()


def test_later_batches_of_a_clustered_day_are_merged_in(spark, tmp_path):
    path = str(tmp_path / "flows")
    before = (START + timedelta(days=1)).date()
    for batch in range(3):
        tables.append_flows(flows(spark, dict(timestamp=START + timedelta(hours=batch), src_ip=f"10.0.0.{batch}", dst_ip="::1")), path, stream="a", batch_id=batch)
        tables.compact_flows(spark, path, before=before, by_address=True)
    assert sorted(r.src_ip for r in tables.read_flows(spark, path).collect()) == ["10.0.0.0", "10.0.0.1", "10.0.0.2"]
    assert [p.name for p in (Path(path) / "flow_date=2026-08-01").iterdir() if p.is_dir()] == ["stream=_clustered"]


def test_slices_and_key(spark):
    values = list(range(0, 300, 3))
    frame = spark.createDataFrame([(v,) for v in range(-1, 310)] + [(None,)], "v long")
    got = {r.v: r.n for r in frame.select("v", slice_number(F.col("v"), values, F.lit(0)).alias("n")).collect()}
    assert all(got[v] == sum(b <= v for b in values) for v in range(-1, 310)) and got[None] == 0
    hot = spark.range(500).select(slice_number(F.lit(5), [1, 5, 5, 5, 9], F.xxhash64("id")).alias("n")).groupBy("n").count().collect()
    assert sorted(r.n for r in hot) == [2, 3, 4] and all(r["count"] > 100 for r in hot)
    rows = tables.stored_form(flows(spark, *[dict(src_ip=f"10.0.{i}.1", dst_ip=f"10.9.{i % 7}.1", timestamp=START + timedelta(seconds=i)) for i in range(200)]))
    slices = sampled_slices(rows, bits=3)
    assert all(len(b) <= 7 for b in slices.bounds.values())
    keys = [r[0] for r in rows.select(z_key(slices, 3)).collect()]
    assert min(keys) >= 0 and max(keys) < 1 << 9 and len(set(keys)) > 20
    empty = Slices({c: [] for c in slices.bounds})
    assert {r[0] for r in rows.select(z_key(empty)).collect()} == {0}
    assert all(b == [] for b in sampled_slices(rows.limit(0)).bounds.values())
