"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local threads. Each query
runs whole into the noop sink; its time includes plan building and every job it starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from civicspark.operators.staging import forget  # noqa: E402
from civicspark.queries import QUERIES  # noqa: E402
from civicspark.session import build_session  # noqa: E402

HEADLINE = [
    "triage_rules", "reply_parse", "corpus_docs", "resolution_stats", "latency_summary", "dedup_latest", "crosswalk_fill",
    "owner_portfolio_compat", "risk_by_bin", "risk_fire_or_join", "risk_ems_grid", "risk_nypd_grid", "risk_311_velocity",
    "nearest_hydrant", "nearest_hospital", "risk_composite", "resolve_building", "incident_history", "nearby_resources",
    "building_report_counts", "batch_triage", "vector_topn", "vector_topn_filtered", "streamed_triage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.sql.codegen.cache.maxEntries": "2000",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["risk_by_bin"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM and its workers
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        forget(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
