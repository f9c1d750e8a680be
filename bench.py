"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned, run and fully produced (``noop`` sink). Name queries on the command line to time others.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "fleet_risk", "distinct_lookups", "advisory_match", "classify_dependencies", "create_findings", "check_summary",
    "aggregate_overall_risk", "alias_groups", "merge_affected", "extract_requirements", "dependency_identity_dedupe",
    "resolve_relations", "match_python_imports", "usage_evidence", "directory_stats", "build_edges", "dependency_paths",
    "minimum_fixed_version", "choose_version", "repository_summary", "dashboard_totals", "stale_jobs", "redact_secrets",
    "stream_heartbeat_watchdog",
]


def main() -> None:
    from fleetlens.catalog import all_queries
    from fleetlens.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("fleetlens-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM before the clock
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 2),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
