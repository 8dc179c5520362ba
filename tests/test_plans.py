"""Plans, not results: what is read, what is shuffled, what is broadcast."""

from __future__ import annotations

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from builders import at, flows
from fluxlens import FlowTables, Scope, build_rollup_1m, flow_query
from fluxlens.operators import enrich, observations
from fluxlens.plans import reports
from fluxlens.sources import tables
from test_observations import observe, packet

START = at("2026-08-01T00:00:00")
RANGE = dict(time_from=START + timedelta(days=1), time_to=START + timedelta(days=2))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "flows")
    rows = [{"src_ip": f"10.0.0.{i % 9}", "bytes": i, "timestamp": START + timedelta(hours=i)} for i in range(72)]
    tables.append_flows(flows(spark, *rows), path)
    return tables.read_flows(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str) -> list[str]:
    return re.findall(r"FileScan parquet.*", text)


def test_time_range_prunes_days_and_columns(stored):
    text = plan(flow_query(stored, **RANGE, group_by=["src_ip"], metrics=["bytes"], limit=100))
    (scan,) = scans(text)
    assert "PartitionFilters: [" in scan and "flow_date#" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp," in scan and "LessThan(timestamp," in scan
    assert re.search(r"ReadSchema: struct<timestamp:timestamp,src_ip:string,bytes:bigint>", scan)
    assert text.count("Exchange ") == 1 and "TakeOrderedAndProject" in text


def test_filters_reach_the_scan(stored):
    tree = {"op": "AND", "conditions": [
        {"field": "src_ip", "operator": "eq", "value": "10.0.0.3"}, {"field": "dst_port", "operator": "in", "value": [1, 2]},
        {"field": "dst_ip", "operator": "cidr", "value": "10.0.0.0/8"}]}
    (scan,) = scans(plan(flow_query(stored, **RANGE, filters=tree)))
    for pushed in ("EqualTo(src_ip,10.0.0.3)", "In(dst_port, [1,2])", "GreaterThanOrEqual(dst_ip_key,"):
        assert pushed in scan.split("PushedFilters:")[1]


def test_drilldown_reads_once_and_ranks_early(stored):
    scope = Scope(FlowTables(stored), **RANGE)
    text = plan(reports.host_drilldown(scope, "10.0.0.3"))
    assert len(scans(text)) == 1 and text.count("WindowGroupLimit") == 2


def test_stacked_trend_has_no_pairing_join(stored):
    scope = Scope(FlowTables(stored), **RANGE)
    text = plan(reports.stacked_trend(scope, "src_ip"))
    assert "Cartesian" not in text and "NestedLoop" not in text and "BroadcastHashJoin" in text


def test_range_lookup_is_an_equi_join(spark, stored):
    schema = "start bigint, end bigint, asn bigint, country string, org string"
    ranges = spark.createDataFrame([(i * 256, i * 256 + 200, i + 1, "JP", "o") for i in range(300)], schema)
    text = plan(enrich.enrich_asn(stored, enrich.build_range_index(ranges)))
    assert text.count("BroadcastHashJoin") == 2 and "NestedLoop" not in text
    assert "Exchange hashpartitioning" not in text  # flows are not shuffled
    text = plan(enrich.enrich_asn(stored, enrich.build_range_index(ranges, max_broadcast_bytes=0)))
    assert "NestedLoop" not in text and "BroadcastHashJoin" not in text and text.count("SortMergeJoin") == 2
    assert re.search(r"hashpartitioning\(_bucket#\d+L?,", text)  # one key: adaptive execution splits a busy bucket


def test_rollup_and_windows_are_hash_aggregates(spark, stored):
    for df in (build_rollup_1m(stored), observations.aggregate_windows(observe(spark, packet(1, 1)))):
        text = plan(df)
        assert "HashAggregate" in text and "SortAggregate" not in text and text.count("Exchange hashpartitioning") == 1


def test_cap_ranks_shares_first(spark):
    windows = observations.aggregate_windows(observe(spark, packet(1, 1)))
    text = plan(observations.admit_first_flows(windows))
    assert re.search(r"hashpartitioning\(window_start#\d+, salt#\d+", text)


def test_answers_do_not_depend_on_the_session_time_zone(spark, stored):
    ask = dict(**RANGE, interval="day", metrics=["bytes"])
    want = flow_query(stored, **ask).collect()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert flow_query(stored, **ask).collect() == want
        assert stored.select(F.count_distinct("flow_date")).first()[0] == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
