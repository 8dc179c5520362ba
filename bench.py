"""Times the headline queries and prints one JSON line.

Reports and filters read stored tables, which are written before; that time is reported as "preparation".

The first run of each query warms up code generation; the reported time is the best of the following runs, each of
which builds the plan anew and computes the whole result.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from fluxlens.session import apply_settings
from workload import derive
from workload.catalog import QUERIES

HEADLINE = (
    "r01_kpi_summary",
    "r02_top_talkers",
    "r03_traffic_trend",
    "r04_stacked_trend",
    "r06_conversations",
    "r07_host_drilldown",
    "a05_distinct",
    "a09_build_rollup_1m",
    "p08_cidr",
    "e01_enrich_asn",
    "e02_enrich_city",
    "e05_classify_application",
    "o02_aggregate_flows",
    "s06_decode_netflow_v5",
    "s07_decode_sflow_v5",
    "s08_decode_frames",
)


def run(result: DataFrame) -> None:
    """Compute every row and column without bringing them to the driver."""
    result.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_settings(spark)
    begin = time.perf_counter()
    derive.prepare(spark, sf_dir)
    preparation = round(time.perf_counter() - begin, 3)
    seconds = {}
    for name in names:
        run(QUERIES[name](spark, sf_dir))
        times = []
        for _ in range(repeats):
            begin = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            times.append(time.perf_counter() - begin)
        seconds[name] = round(min(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "preparation": preparation, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
