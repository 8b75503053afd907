"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores.  Each query runs once to warm up and twice timed; the
better time counts.  Results are written to the no-op sink, so every row is
computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from glyphlake.plans import load_all
from glyphlake.plans.registry import QUERIES
from glyphlake.session import local_session

HEADLINE = [
    "links_by_rule_and_host",
    "extract_resources",
    "extract_faces",
    "pick_style_source",
    "family_rank",
    "validation_summary",
    "format_groups",
    "style_coverage",
    "quality_audit",
    "lookup_source",
    "unique_names",
    "dedupe_content",
    "extract_style_candidates",
    "mentions_family",
    "expected_styles",
    "read_api_items",
    "retry_triage",
    "job_status",
    "latest_within",
    "rate_limit",
    "expand_link_graph",
    "scan_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = None
        for attempt in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if attempt:
                best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
