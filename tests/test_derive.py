from __future__ import annotations

from datetime import timedelta
from pathlib import Path

from pyspark.sql import functions as F

from fluxlens.operators.query import flow_query
from workload import derive
from workload.catalog import QUERIES


def _write(spark, folder, groups):
    rows = spark.range(40_000).select(F.col("id").alias("l_orderkey"), F.sha2(F.col("id").cast("string"), 512).alias("filler"))
    rows.coalesce(1).write.option("parquet.block.size", 4 << 20 if groups == 1 else 64 << 10).option("parquet.page.size", 16 << 10).parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_tables_that_tasks_can_share_are_not_copied(spark, tmp_path, monkeypatch):
    whole, cut = _write(spark, tmp_path / "whole", 1), _write(spark, tmp_path / "cut", 64)
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert derive.table(spark, cut, "lineitem").inputFiles()[0].startswith(f"file://{cut}")
        copied = derive.table(spark, whole, "lineitem")
        assert not copied.inputFiles()[0].startswith(f"file://{whole}") and copied.count() == 40_000
        monkeypatch.setattr(derive, "TASK_ROWS", 1_000)
        assert len(derive.table(spark, _write(spark, tmp_path / "third", 1), "lineitem").inputFiles()) == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stream_of_a_single_row_group_comes_in_even_files_and_bounded_batches(spark, tmp_path, monkeypatch):
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    monkeypatch.setattr(derive, "TASK_ROWS", 5_000)
    try:
        whole, batches = _write(spark, tmp_path / "whole", 1), []
        live = derive.stream(spark, whole, "lineitem", batch_files=3)
        sink = live.writeStream.foreachBatch(lambda df, _: batches.append((df.select(F.input_file_name()).distinct().count(), df.count())))
        sink.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [files for files, _ in batches] == [3, 3, 2] and sum(rows for _, rows in batches) == 40_000
    assert max(rows for _, rows in batches) < 3 * 6_000


def _folders(spark, purpose):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {p.name for p in root.glob(f"{purpose}-*")}


def test_questions_store_only_what_they_read(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(derive, "_STAGED", {})
    flows, rollups = _folders(spark, "flows"), _folders(spark, "rollup")
    trend = QUERIES["r04_stacked_trend"](spark, sf_dir).collect()
    QUERIES["r06_bounded_conversations"](spark, sf_dir).collect()
    assert _folders(spark, "flows") == flows and len(_folders(spark, "rollup") - rollups) == 1
    rollups = _folders(spark, "rollup")
    QUERIES["r07_host_drilldown"](spark, sf_dir).collect()
    assert len(_folders(spark, "flows") - flows) == 1 and _folders(spark, "rollup") == rollups
    # Bounds inside a minute are answered from the flows, with or without a stored detail table.
    part = dict(time_from=derive.FROM + timedelta(days=1, seconds=7), time_to=derive.FROM + timedelta(days=9, seconds=41), group_by=["src_ip"])
    bare = flow_query(derive.stored_rollup(spark, sf_dir), **part).collect()
    monkeypatch.setattr(derive, "_STAGED", {})
    assert bare == flow_query(derive.stored_flows(spark, sf_dir), **part).collect()
    assert trend == QUERIES["r04_stacked_trend"](spark, sf_dir).collect()


def test_questions_that_no_rollup_answers_store_the_flows_alone(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(derive, "_STAGED", {})
    flows, rollups = _folders(spark, "flows"), _folders(spark, "rollup")
    ports = QUERIES["r04_stacked_trend_by_port"](spark, sf_dir).count()
    assert ports > 0 and ports % 6 == 0
    QUERIES["r02_top_ports_by_flows"](spark, sf_dir).collect()
    QUERIES["r01_kpi_summary"](spark, sf_dir).collect()
    assert len(_folders(spark, "flows") - flows) == 1 and _folders(spark, "rollup") == rollups
