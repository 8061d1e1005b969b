"""Benchmark: build the warehouse from the driver tables, then time the
headline queries.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Timings are the median of ``BENCH_REPEAT`` (default 3) runs of each query,
built afresh every run (no reuse of earlier shuffle output) and executed to
the end into Spark's ``noop`` sink: every stage runs, but the result is not
shipped row by row into Python, which would time the driver's pickling
rather than the engine.  ``build`` is the whole load: the stand-in rows as CSV extracts, bronze, silver and the gold
dimensions (the part the source's two load procedures and view creation do).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.oracle import AS_OF  # noqa: E402
from strata.plans.registry import QUERIES  # noqa: E402
from strata.plans.warehouse import Warehouse  # noqa: E402
from strata.session import local_session  # noqa: E402

HEADLINE = [
    "g3_fact_sales",
    "e5_kpi_report",
    "e6_5_revenue_by_category",
    "e7_3_top_customers",
    "n1a_sales_by_month",
    "n2_running_totals",
    "n3_yoy_products",
    "n5_category_share",
    "g4_report_customers",
    "g5_report_products",
    "qs13_sales_rule",
    "qg11_date_order",
]
# Timed and reported too; ``value`` keeps to the set above, which has been timed from the start.
ALSO = ["qa_quality_summary"]


def timed(fn, repeat: int) -> float:
    runs = []
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t0)
    return round(statistics.median(runs), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="strata-bench")

    t0 = time.perf_counter()
    wh = Warehouse.from_standin(spark, sf_dir, as_of=AS_OF)
    build = round(time.perf_counter() - t0, 4)

    results = {"build": build}
    results["fact_sales_count"] = timed(lambda: wh.fact_sales().count(), repeat)
    for name in HEADLINE:
        results[name] = timed(lambda n=name: QUERIES[n](wh).write.format("noop").mode("overwrite").save(), repeat)
    queries_total = round(sum(v for k, v in results.items() if k != "build"), 4)
    for name in ALSO:
        results[name] = timed(lambda n=name: QUERIES[n](wh).write.format("noop").mode("overwrite").save(), repeat)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(build + queries_total, 4),
        "unit": "sec",
        "queries": results,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
