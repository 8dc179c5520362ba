"""Distinct counts from merged bitmaps and sketches against the detail rows."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest

from builders import at, flows
from fluxlens.operators.distinct import approx_uniq_addresses, build_address_sketches, build_port_rollup, merge_port_rollup, uniq_ports
from fluxlens.operators.query import QueryError, flow_query

START = at("2026-08-01T00:00:00")
DAY = dict(time_from=START, time_to=START + timedelta(days=1))


@pytest.fixture(scope="module")
def detail(spark):
    rng = random.Random(4)
    rows = [
        dict(timestamp=START + timedelta(seconds=rng.randrange(100_000)), application=rng.choice("abc"), vlan=rng.randrange(3), src_ip=f"10.0.{rng.randrange(40)}.{rng.randrange(250)}",
             dst_ip=f"10.1.0.{rng.randrange(9)}", dst_port=rng.choice([0, 32767, 32768, 65535, rng.randrange(65536)]))
        for _ in range(6000)
    ]
    return flows(spark, *rows).persist()


def test_ports_are_counted_exactly_over_spans_and_coarser_groups(detail):
    rollup = build_port_rollup(detail, ("application", "vlan"))
    for span in (DAY, dict(time_from=START, time_to=START + timedelta(hours=5))):
        for group in ((), ("application",), ("vlan", "application")):
            got = uniq_ports(rollup, **span, group_by=group)
            want = flow_query(detail, **span, group_by=group, metrics=("uniq_dst_port",))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parts_of_batches_merge(detail):
    parts = build_port_rollup(detail.where("vlan < 2"), ("application",)).unionByName(build_port_rollup(detail.where("vlan >= 1"), ("application",)))
    merged = merge_port_rollup(parts)
    assert merged.count() == build_port_rollup(detail, ("application",)).count() < parts.count()
    got = uniq_ports(merged, **DAY, group_by=("application",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, uniq_ports(parts, **DAY, group_by=("application",)).collect()))


def test_estimates_are_near(detail):
    got = {r.application: r for r in approx_uniq_addresses(build_address_sketches(detail, ("application",)), **DAY, group_by=("application",)).collect()}
    for r in flow_query(detail, **DAY, group_by=("application",), metrics=("uniq_src_ip", "uniq_dst_ip")).collect():
        assert got[r.application].approx_uniq_dst_ip == r.uniq_dst_ip
        assert abs(got[r.application].approx_uniq_src_ip - r.uniq_src_ip) <= 0.065 * r.uniq_src_ip


def test_empty_null_and_refused(spark, detail):
    assert uniq_ports(build_port_rollup(detail.limit(0), ("vlan",)), **DAY, group_by=("vlan",)).collect() == []
    odd = spark.createDataFrame([(START, "x", None), (START, None, 5), (START, None, 70_000)], "timestamp timestamp, application string, dst_port int")
    assert sorted(map(repr, (tuple(r) for r in uniq_ports(build_port_rollup(odd, ("application",)), **DAY, group_by=("application",)).collect()))) == ["(None, 1)"]
    with pytest.raises(QueryError):
        build_port_rollup(detail, (), port="vlan")
