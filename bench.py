"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or `all`).
Every query runs to a no-op sink over its whole tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.catalog import QUERIES  # noqa: E402
from tallyloom.session import build_session  # noqa: E402

HEADLINE = [
    "q_spend_vendor_currency",
    "q_outstanding_currency",
    "q_filtered_page",
    "q_page_summary",
    "q_validate_flags",
    "q_line_totals",
    "q_line_notes",
    "q_money_roundtrip",
    "q_date_roundtrip",
    "q_packed_json_lines",
    "q_structured_intake",
    "q_row_numbers",
    "q_heuristic_mapping",
    "q_group_lines",
    "q_import_drafts",
    "q_bulk_outcome",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "tallyloom-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["q_status_counts"](spark, sf_dir).collect()  # start-up is not what is measured
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
