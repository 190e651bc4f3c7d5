"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs to a noop sink, so every row and column is computed. The second run
counts; the first is reported under ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.session import local_session  # noqa: E402
from plumbline.workloads.registry import all_queries  # noqa: E402

HEADLINE = [
    "secret_findings",
    "fused_scan",
    "severity_scorecard",
    "line_context_hits",
    "detector_precision",
    "detector_recall",
    "snapshot_diff",
    "regression_gate",
    "orphan_invariants",
    "token_entropy_profile",
    "detect_access_control",
    "detect_injection",
    "rule_path_traversal",
    "full_audit",
    "response_findings",
    "link_rank",
    "deadman_batch",
    "alarm_dedup_batch",
    "uptime_windows",
    "added_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, **{"spark.sql.shuffle.partitions": cpus})
    queries = all_queries()
    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.time()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    lines = queries["document_lines"].run(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "fused_scan_lines_per_sec": round(lines / max(warm["fused_scan"], 1e-9)),
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
