"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder with the tables (default sf0.1); BENCH_CPUS: local threads (default 8).
Each query runs once to warm up, then BENCH_RUNS times (default 3); the median is reported.
The result is consumed whole through the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardwright.plans.catalog import QUERIES
from wardwright.session import build_session

HEADLINE = (
    "v2_appointment_details", "v4_dept_stats", "a5_bed_pivot", "a8_dept_having", "a12_predicted_wait",
    "a14_billing_kpis", "a16_ward_rollup", "a17_dashboard_headline", "a17_dashboard_sections", "j9_patients_with_bills",
    "j10_open_slots", "j11_availability_calendar", "j12_availability_matrix", "p4_search", "p3_no_filter", "s3_recent8",
    "q1_salary_vs_avg", "q3_above_avg_load", "u2_patch_patients", "u3_delete_patients", "u4_upsert_availability",
    "u5_new_state", "u6_bookings", "u7_change_status", "u9_new_state", "u11_bills", "t1_status_audit",
    "u1_add_doctors", "a16_ward_beds", "t4_appended_log",
    "t5_snapshot_diff", "t5_digest_diff", "u7_partition_rewrite", "sc6_bucketed_join", "a17_dashboard_document", "c3_fk_orphans", "c4_double_bookings", "st1_audit_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or (list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}
    for key in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
