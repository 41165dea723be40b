"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names (default: the headline list)

Each query is computed whole into a sink that discards rows; nothing is
cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loglantern.checks.queries import QUERIES  # noqa: E402
from loglantern.session import local_session  # noqa: E402

HEADLINES = [
    "parse_logs",
    "alerts",
    "service_metrics",
    "window_summaries",
    "window_payloads",
    "logs_near_alerts",
    "related_alerts",
    "alerts_as_of_window",
    "document_embeddings",
    "nearest_vectors",
    "incident_reports",
    "root_cause_nodes",
    "dashboard_kpis",
    "search_all_logs",
    "feed_snapshot",
    "scoped_notifications",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = local_session("loglantern-bench", cpus)
    # Class loading and the first code generation are not part of any query.
    QUERIES["service_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
