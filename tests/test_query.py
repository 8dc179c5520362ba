from __future__ import annotations

from datetime import timedelta

import pytest

from builders import at, flows
from fluxlens import FlowTables, QueryError, available_fields, build_rollup_1m, choose_table, flow_detail, flow_query
from fluxlens.operators.filters import all_of, check_filter
from fluxlens.plans.ranges import interval_for_span, resolve_range

START, END = at("2026-08-01T00:00:00"), at("2026-08-01T01:00:00")
HOUR = dict(time_from=START, time_to=END)


def leaf(field, operator, value):
    return {"field": field, "operator": operator, "value": value}


@pytest.fixture(scope="module")
def detail(spark):
    base = {"protocol": 6, "packets": 1, "application": "https"}
    return flows(
        spark,
        {**base, "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "dst_port": 443, "bytes": 100, "src_country": "JP", "src_asn": 1},
        {**base, "src_ip": "10.0.0.1", "dst_ip": "8.8.4.4", "dst_port": 80, "bytes": 50, "src_country": "JP",
         "src_asn": 15169, "application": "100%_x", "timestamp": START + timedelta(minutes=3)},
        {**base, "src_ip": "10.0.1.2", "dst_ip": "2001:db8::5", "dst_port": 22, "bytes": 70, "timestamp": START + timedelta(minutes=3)},
        {**base, "src_ip": "10.0.0.9", "dst_ip": "8.8.8.8", "dst_port": 53, "bytes": 9, "timestamp": END},
    )


def total(detail, tree):
    return flow_query(detail, **HOUR, filters=tree, metrics=["bytes"]).first()["bytes"]


def test_defaults_and_half_open_range(detail):
    rows = flow_query(detail, **HOUR, group_by=["src_ip"]).collect()
    assert [r.asDict() for r in rows] == [
        {"src_ip": "10.0.0.1", "bytes": 150, "packets": 2, "flows": 2},
        {"src_ip": "10.0.1.2", "bytes": 70, "packets": 1, "flows": 1},
    ]


def test_empty_input_gives_zero(detail):
    row = flow_query(detail, time_from=END + timedelta(1), time_to=END + timedelta(2), metrics=["bytes", "flows", "uniq_src_ip"])
    assert tuple(row.first()) == (0, 0, 0)


def test_filters(detail):
    cases = [
        (leaf("src_ip", "eq", "::ffff:10.0.1.2"), 70), (leaf("src_ip", "ne", "10.0.1.2"), 150),
        (leaf("dst_ip", "in", ["8.8.8.8", "2001:DB8:0::5"]), 170), (leaf("dst_ip", "not_in", ["8.8.8.8"]), 120),
        (leaf("src_ip", "cidr", "10.0.0.0/24"), 150), (leaf("src_ip", "cidr", "10.0.1.77/23"), 220),
        (leaf("dst_ip", "cidr", "2001:db8::/32"), 70), (leaf("dst_ip", "cidr", "::/0"), 220),
        (leaf("dst_ip", "cidr", "0.0.0.0/0"), 150), (leaf("src_ip", "cidr", "::ffff:10.0.0.0/120"), 150),
        (leaf("dst_port", "in", [443.0, "80"]), 150), (leaf("bytes", "gte", 70), 170), (leaf("bytes", "lt", 70.5), 120),
        (leaf("application", "contains", "%_"), 50), (leaf("application", "like", "h%s"), 170),
        (leaf("application", "prefix", "100"), 50), (leaf("src_country", "eq", ""), 70), ({}, 220), (None, 220),
        ({"op": "NOT", "conditions": [leaf("src_country", "eq", "JP")]}, 70),
        ({"op": "OR", "conditions": [leaf("dst_port", "eq", 22), leaf("dst_port", "eq", 80)]}, 120),
        ({"op": "AND", "conditions": [leaf("src_country", "eq", "JP"),
            {"op": "OR", "conditions": [leaf("dst_port", "eq", 443), leaf("dst_port", "eq", 80)]},
            {"op": "NOT", "conditions": [leaf("src_asn", "eq", 15169)]}]}, 100),
        ({"op": "AND", "conditions": [{}]}, 220), ({"op": "NOT", "conditions": [{}]}, 220),
    ]
    for tree, want in cases:
        assert total(detail, tree) == want, tree


def test_rejections(detail):
    def ask(**more):
        return flow_query(detail, **{**HOUR, **more})

    deep = leaf("protocol", "eq", 6)
    for _ in range(8):
        deep = {"op": "AND", "conditions": [deep]}
    check_filter(deep)
    bad = [
        (dict(time_from=None), "time range"), (dict(time_to=START), "empty"),
        (dict(time_to=START + timedelta(days=367)), "366 days"), (dict(limit=10_001), "10001"),
        (dict(group_by=["bytes"]), "group by"), (dict(metrics=["p99"]), "metric"), (dict(interval="week"), "interval"),
        (dict(sort=("src_ip", True)), "sort field"), (dict(table="users"), "table"), (dict(table="flows_1m"), "rollup"),
        (dict(filters=leaf("nope", "eq", 1)), "nope"), (dict(filters=leaf("src_ip", "like", "1%")), "like"),
        (dict(filters=leaf("bytes", "cidr", "1.0.0.0/8")), "cidr"), (dict(filters=leaf("src_ip", "eq", None)), "no value"),
        (dict(filters={"op": "XOR", "conditions": [{}]}), "XOR"), (dict(filters={"op": "AND"}), "at least one"),
        (dict(filters={"op": "NOT", "conditions": [{}, {}]}), "exactly one"),
        (dict(filters={**leaf("protocol", "eq", 6), "op": "AND"}), "at once"),
        (dict(filters={"op": "AND", "conditions": [deep]}), "deeper"), (dict(filters=leaf("dst_port", "in", [])), "empty list"),
        (dict(filters=leaf("dst_port", "in", 5)), "list"), (dict(filters=leaf("dst_port", "in", list(range(1001)))), "1001"),
        (dict(filters=leaf("dst_port", "eq", "http")), "number"), (dict(filters=leaf("src_ip", "eq", "10.0.0")), "IP address"),
        (dict(filters=leaf("src_ip", "cidr", "10.0.0.1")), "prefix length"),
    ]
    for question, message in bad:
        with pytest.raises(QueryError, match=message):
            ask(**question)


def test_table_choice(detail):
    days = dict(time_from=START, time_to=START + timedelta(days=4))
    assert choose_table(**HOUR) == "flows"
    assert choose_table(**HOUR, interval="minute", group_by=["application"]) == "flows_1m"
    assert choose_table(**days, group_by=["src_ip"]) == "flows_1m"
    assert choose_table(START, START + timedelta(days=3), group_by=["src_ip"]) == "flows"
    assert choose_table(**days, group_by=["dst_port"]) == "flows"
    assert choose_table(**days, filters={"op": "OR", "conditions": [leaf("vlan", "eq", 1)]}) == "flows"
    assert choose_table(**days, metrics=["uniq_src_ip"]) == "flows"
    both = FlowTables(detail, build_rollup_1m(detail))
    for name, question in (
        ("dst_port", dict(group_by=["dst_port"])), ("vlan", dict(filters=leaf("vlan", "eq", 0))),
        ("uniq_src_ip", dict(metrics=["uniq_src_ip"])),
    ):
        with pytest.raises(QueryError, match=name):
            flow_query(both, **HOUR, table="flows_1m", **question)


def test_rollup_agrees_on_whole_minutes(detail):
    both = FlowTables(detail, build_rollup_1m(detail))
    ask = dict(**HOUR, interval="minute", group_by=["src_ip", "application"])
    answers = [flow_query(both, **ask, table=t).collect() for t in ("flows", "flows_1m", None)]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 3
    assert answers[0][0]["ts"] == int(START.timestamp())


def test_detail_rows(detail):
    rows = flow_detail(detail, time_from=START, time_to=END + timedelta(1), limit=2).collect()
    assert [r["ts"] for r in rows] == [int(END.timestamp()), int(START.timestamp()) + 180]
    assert len(rows[0]) == 25


def test_ranges_and_fields():
    assert resolve_range("24h", now=END)[0] == END - timedelta(hours=24)
    assert resolve_range("custom", now=END, time_from=START, time_to=END) == (START, END)
    with pytest.raises(QueryError):
        resolve_range("2w", now=END)
    assert [interval_for_span(START, START + timedelta(hours=h)) for h in (6, 7, 24 * 7, 24 * 8)] == [
        "minute", "hour", "hour", "day",
    ]
    assert len(available_fields()["filterable"]) == 26 and len(available_fields()["groupable"]) == 23
    assert "src_city" not in available_fields(city_available=False)["groupable"]
    assert all_of({}, None) is None and all_of(leaf("vlan", "eq", 1), {}) == leaf("vlan", "eq", 1)


def test_like_takes_stray_backslashes(spark):
    names = ["a\\b", "a%b", "a\\%b", "axb", "a_b", "ab\\"]
    rows = flows(spark, *({"application": n, "timestamp": at("2026-08-01T00:30:00")} for n in names))
    question = dict(time_from=at("2026-08-01T00:00:00"), time_to=at("2026-08-01T01:00:00"), group_by=["application"])
    wanted = {r"a\b": {"a\\b"}, r"a\%b": {"a%b"}, r"a\\%b": {"a\\b", "a\\%b"}, r"a\_b": {"a_b"}, "ab\\": {"ab\\"}, "a_b": {"a%b", "axb", "a_b", "a\\b"}}
    for pattern, names_found in wanted.items():
        tree = {"field": "application", "operator": "like", "value": pattern}
        got = {r["application"] for r in flow_query(rows, **question, filters=tree).collect()}
        assert got == names_found, pattern


def test_no_limit_means_all_rows(spark):
    rows = flows(spark, *({"dst_port": i, "timestamp": at("2026-08-01T00:30:00")} for i in range(150)))
    question = dict(time_from=at("2026-08-01T00:00:00"), time_to=at("2026-08-01T01:00:00"), group_by=["dst_port"])
    assert flow_query(rows, **question).count() == 150 and flow_query(rows, **question, limit=7).count() == 7
    for wrong in (0, -1, 10_001):
        with pytest.raises(QueryError):
            flow_query(rows, **question, limit=wrong)


def test_automatic_choice_is_exact_inside_minutes(spark):
    rows = flows(spark, *({"timestamp": at("2026-08-01T00:00:00") + timedelta(seconds=s)} for s in (40, 45, 70, 130)))
    both = FlowTables(rows, build_rollup_1m(rows))
    start = at("2026-08-01T00:00:00") + timedelta(seconds=42)
    for end in (timedelta(seconds=5), timedelta(seconds=20), timedelta(seconds=60), timedelta(seconds=89), timedelta(days=2), timedelta(days=5)):
        for interval in (None, "minute"):
            ask = dict(time_from=start, time_to=start + end, interval=interval, metrics=["flows"])
            assert sorted(flow_query(both, **ask).collect()) == sorted(flow_query(rows, **ask).collect()), (end, interval)
