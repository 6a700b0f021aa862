"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is executed in full into the no-op sink. ``slice_job`` is the whole pipeline:
panel and factor Parquet written, re-read, checksummed and recorded in a fresh ledger.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strictpast.session import build_session
from strictpast.testbed.queries import QUERIES

HEADLINE = (
    "panel",
    "universe_flags",
    "mom_12_1",
    "ttm_as_of",
    "earnings_yield",
    "coverage_grid",
    "membership_intervals",
    "membership_window",
    "resolve_universe",
    "statement_merge",
    "dq_summary",
    "panel_stamped",
    "verify_verdict",
    "slice_job",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
