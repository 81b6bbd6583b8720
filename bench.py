"""Seconds per headline query on the test tables; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS the timed runs after one warm-up
(the median is reported), BENCH_ALL=1 times every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratapanel import catalog  # noqa: E402
from stratapanel.session import local_session  # noqa: E402

HEADLINE = [
    "risk_series_all", "risk_series_sometime", "rate_series_all", "cohort_one_pass", "oss_rate_series",
    "collapse_school_to_lea", "collapse_lea_to_state", "sum_na_propagating", "merge_1to1_master_wins", "merge_chain",
    "merge_m1_lookup", "merge_matched_only", "panel_stack", "dup_index", "tab_year", "duplicates_report",
    "reshape_long_two_stubs", "state_table_rounded", "state_table_pct", "wave_ingest_to_lea", "standard_detect_select",
    "modern_wave_to_lea", "lea_panel_totals", "school_panel", "long_fact_rollup", "quality_report",
    "wave_ingest_data_decided", "oss_panel_totals", "read_through_cache", "csv_roundtrip_forced_strings", "extract_all_text",
]


def seconds(run, spark, sf) -> float:
    start = time.perf_counter()
    run(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries = catalog.queries()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds(queries[name], spark, sf)
        times[name] = round(statistics.median(seconds(queries[name], spark, sf) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds, median per query", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
