"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query starts from the events file and is run to the end (all rows produced, none kept), twice.
``queries`` holds the second run, ``first_runs`` the first, which also pays for compiling the
query's code. Cached tables are dropped after every run. ``duckdb`` holds the second run of the SQL the query is checked
against, on the same tables with as many threads, and ``ratio`` Spark's time as a multiple of it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from traffic_risk.session import local_session  # noqa: E402
from verification.compare import connect  # noqa: E402
from verification.queries import CHECKS, QUERIES  # noqa: E402

HEADLINE = (
    "scan_pageviews",
    "labeled_events",
    "daily_summary",
    "risk_summary",
    "risk_samples",
    "province_share_shift",
    "blocked_share_waterfall",
    "title_url_uv_pv_blocked",
    "c_segment_histogram",
    "block_ratios",
    "hour_profile",
    "clone_clusters",
    "user_day_features",
    "resolution_zscore_loo",
    "all_features",
    "cohort_labels",
    "cohort_risk_summary",
    "network_roi",
    "redteam_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    QUERIES["daily_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    first, seconds = {}, {}
    for name in names:
        for runs in (first, seconds):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - start, 3)
            spark.catalog.clearCache()
    print(json.dumps({"spark": seconds}), file=sys.stderr, flush=True)
    con, duck = connect(sf_dir), {}
    con.execute(f"SET threads = {int(cpus)}")
    for name in names:
        if name in CHECKS:
            for _ in range(2):
                start = time.perf_counter()
                con.execute(CHECKS[name]).to_arrow_table()
                duck[name] = round(time.perf_counter() - start, 3)
    ratio = {n: round(seconds[n] / max(s, 0.001), 1) for n, s in duck.items()}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_runs": first,
                "first_runs_value": round(sum(first.values()), 3),
                "duckdb": duck,
                "ratio": ratio,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
