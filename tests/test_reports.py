from __future__ import annotations

from datetime import timedelta

import pytest

from builders import at, flows
from fluxlens import FlowTables, QueryError, Scope, build_rollup_1m
from fluxlens.plans import reports

START = at("2026-08-01T00:00:00")


@pytest.fixture(scope="module")
def scope(spark):
    rows = []
    for i in range(24):
        rows.append(
            {
                "src_ip": f"10.0.0.{i % 4}", "dst_ip": f"8.8.8.{i % 12}", "dst_port": 400 + i % 12, "protocol": 6 if i % 3 else 17,
                "bytes": 10 * (i + 1), "packets": 1, "observed_bytes": i + 1, "application": f"app{i % 8}",
                "src_country": ("JP", "US", "", "XXX")[i % 4], "dst_asn": i % 2, "timestamp": START + timedelta(minutes=i % 5),
            }
        )
    detail = flows(spark, *rows)
    return Scope(FlowTables(detail, build_rollup_1m(detail)), START, START + timedelta(hours=1))


def test_zero_filled_series(spark):
    rows = spark.createDataFrame([(100, "a", 10), (200, "a", 20), (200, "b", 5), (300, "b", 7), (100, "zzz", 999)], "ts bigint, key string, value bigint")
    keys = spark.createDataFrame([(1, "a"), (2, "b")], "position int, key string")
    series = {}
    for r in reports.zero_filled_series(rows, keys).orderBy("position", "ts").collect():
        series.setdefault(r["key"], []).append((r["ts"], r["value"]))
    assert series == {"a": [(100, 10), (200, 20), (300, 0)], "b": [(100, 0), (200, 5), (300, 7)]}
    wide = reports.pivot_series(reports.zero_filled_series(rows, keys), "key", "value", ["b", "a"]).collect()
    assert [tuple(r) for r in wide] == [(100, 0, 10), (200, 5, 20), (300, 7, 0)]


def test_kpis(scope):
    row = reports.kpi_summary(scope).first()
    assert (row["bytes"], row["packets"], row["flows"], row["observed_bytes"]) == (3000, 24, 24, 300)
    assert (row["uniq_src_ip"], row["uniq_dst_port"], row["ratio"]) == (4, 12, 10.0)
    empty = Scope(scope.tables, START + timedelta(days=1), START + timedelta(days=2))
    assert tuple(reports.kpi_summary(empty).first()) == (0, 0, 0, 0, 0, 0, 1.0)


def test_boards(scope):
    top = reports.top_board(scope, "src_ip", limit=2).collect()
    assert [(r["src_ip"], r["bytes"]) for r in top] == [("10.0.0.3", 840), ("10.0.0.2", 780)]
    assert top[0]["pct"] == 100.0 and top[1]["pct"] == pytest.approx(780 / 840 * 100)
    parts = reports.composition(scope, "protocol").collect()
    assert sum(r["share"] for r in parts) == pytest.approx(100.0) and {r["label"] for r in parts} == {"TCP", "UDP"}
    assert len(reports.composition(scope, "dst_port").collect()) == 8
    assert [r["src_country"] for r in reports.country_map(scope).collect()] == ["US", "JP"]
    assert reports.conversations(scope).count() == 12
    assert "src_city" not in reports.geo_boards(scope, city_available=False)
    shared = Scope(scope.tables, scope.time_from, scope.time_to, {"field": "src_ip", "operator": "eq", "value": "10.0.0.1"})
    assert reports.kpi_summary(shared).first()["flows"] == 6


def test_trends(scope):
    trend = reports.traffic_trend(scope).collect()
    assert [r["ts"] for r in trend] == [int(START.timestamp()) + 60 * i for i in range(5)]
    stacked = reports.stacked_trend(scope, "application").collect()
    assert len(stacked) == 5 * 6
    top = {r["application"]: r["bytes"] for r in reports.top_board(scope, "application", limit=6).collect()}
    sums = dict.fromkeys(top, 0)
    for r in stacked:
        sums[r["application"]] += r["bytes"]
    assert sums == top
    by_port = reports.stacked_trend(scope, "dst_port", "flows", keys=3).collect()
    assert len({r["dst_port"] for r in by_port}) == 3 and sum(r["flows"] for r in by_port) == 6
    with pytest.raises(QueryError):
        reports.stacked_trend(scope, "dst_port", "uniq_src_ip")


def test_drilldown_sides(scope):
    rows = reports.host_drilldown(scope, "10.0.0.3").collect()
    panels = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        panels.setdefault(r["panel"], []).append((r["key"], r["bytes"]))
    assert set(panels) == {"peer", "port", "application", "peer_country", "peer_asn", "protocol"}
    assert panels["peer"] == [("8.8.8.11", 360), ("8.8.8.7", 280), ("8.8.8.3", 200)]
    assert panels["peer_asn"] == [("1", 840)]
    other = reports.host_drilldown(scope, "8.8.8.11", side="dst_ip", limit=1).collect()
    assert {r["panel"]: r["key"] for r in other}["peer_country"] == "XXX"
    with pytest.raises(QueryError):
        reports.host_drilldown(scope, "10.0.0.3", side="dst_port")


def test_explorer(scope):
    port = {"field": "dst_port", "operator": "eq", "value": 400}
    app = {"field": "application", "operator": "eq", "value": "app1"}
    assert sum(r["flows"] for r in reports.explorer(scope, [port, app], "OR", "src_ip", "flows").collect()) == 5
    assert reports.explorer(scope, [port, app], "AND").count() == 0
    assert reports.explorer(scope).count() == 4
