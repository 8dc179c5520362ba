"""Bounded top lists against the full sort, and how many rows they spare."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from builders import at
from fluxlens.model import FLOW_SCHEMA, conform
from fluxlens.operators.query import QueryError, flow_query
from fluxlens.operators.topk import level_to_reach, top_query

START = at("2026-08-01T00:00:00")
ASKED = dict(time_from=START, time_to=START + timedelta(days=1), group_by=("src_ip", "dst_port"))


def made(spark, amount: str, keys: int = 20_000, rows: int = 60_000):
    raw = spark.range(rows).selectExpr(
        "timestamp'2026-08-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 80000) AS timestamp",
        f"concat('10.0.', (id % {keys}) DIV 250, '.', (id % {keys}) % 250) AS src_ip",
        "'1.1.1.1' AS dst_ip", "int(id % 3) AS dst_port", f"bigint({amount}) AS bytes", "1L AS packets",
    )
    return conform(raw.withColumn("timestamp_end", F.col("timestamp")), FLOW_SCHEMA)


SHAPES = {
    "skewed": "IF(id % 20000 < 30, 1000000 - id % 20000, id % 97)",
    "flat": "100 + id % 3",
    "tied": "IF(id % 20000 < 300, 5000, 1)",
    "zero": "0",
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("limit", [1, 10, 400])
def test_equal_to_the_full_sort(spark, shape, limit):
    flows = made(spark, SHAPES[shape])
    for metrics in (("bytes", "flows"), ("flows", "bytes", "uniq_dst_ip")):
        want = flow_query(flows, **ASKED, metrics=metrics, limit=limit).collect()
        assert top_query(flows, **ASKED, metrics=metrics, limit=limit, cells=1024).collect() == want


def test_most_rows_are_not_grouped_when_some_keys_stand_out(spark):
    for shape, most in (("skewed", 0.1), ("tied", 0.3)):
        flows = made(spark, SHAPES[shape]).withColumn("src_ip", F.col("src_ip"))
        cells, rows = level_to_reach(flows, ["src_ip", "dst_port"], F.col("bytes"), 10, cells=1 << 14)
        assert rows.count() < most * flows.count()
        assert len(cells) < 1 << 12


def shuffled_rows(frame) -> int:
    """Rows written to exchanges by the final plan of a computed frame."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    total, waiting = 0, [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if "QueryStage" in name:
            waiting.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total


def test_less_is_shuffled(spark):
    flows = made(spark, SHAPES["skewed"]).repartition(4).persist()
    flows.count()
    plain = flow_query(flows, **ASKED, metrics=("bytes",), limit=10)
    bounded = top_query(flows, **ASKED, metrics=("bytes",), limit=10)
    assert bounded.collect() == plain.collect()
    assert shuffled_rows(bounded) * 20 < shuffled_rows(plain)
    flows.unpersist()


def test_nothing_ruled_out_and_negative_amounts_take_the_plain_plan(spark):
    assert level_to_reach(made(spark, "7", keys=50, rows=50), ["src_ip"], F.col("bytes"), 100) is None
    assert level_to_reach(made(spark, "IF(id = 7, -1, 7)", keys=50, rows=50), ["src_ip"], F.col("bytes"), 5) is None
    negative = made(spark, "IF(id % 2 = 0, -5, 5) * (id % 400)", keys=500, rows=2000)
    assert top_query(negative, **ASKED, metrics=("bytes",), limit=7).collect() == flow_query(negative, **ASKED, metrics=("bytes",), limit=7).collect()


def test_empty_and_refused(spark):
    flows = made(spark, "1", keys=50, rows=50)
    assert top_query(flows.limit(0), **ASKED, metrics=("bytes",), limit=7).collect() == []
    for wrong in (dict(metrics=("uniq_src_ip",), limit=5), dict(metrics=("bytes",), limit=None), dict(metrics=("bytes",), limit=5, group_by=())):
        with pytest.raises(QueryError):
            top_query(flows, **(ASKED | wrong))
