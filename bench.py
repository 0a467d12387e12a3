"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from checks.all import QUERIES
from codesieve.session import local_session

HEADLINE = [
    "U1_all_findings",
    "A2_A9_batch_verdict",
    "D1_hardcoded_secret",
    "D23_sector_rules",
    "D24_license_detected",
    "D26_W1_ip_duplication",
    "D27_W2_ip_near_duplicate",
    "D28_W3_J5_cross_file_duplicate",
    "D29_J4_repo_licenses",
    "J14_F18_F20_L2_annotations",
    "W4_diff_lines",
    "A5_A11_nested_counts",
    "A3_summary",
    "A4_F9_trends",
    "J13_latest_resolution",
    "K4_W10_retention",
    "W6_hash_chain",
    "W9_window_counts",
    "T3_admissions",
    "F24_safe_fix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cores, app="bench")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    took = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
