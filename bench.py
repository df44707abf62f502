"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is materialised fully (a write to a no-op sink), after one warm-up run of the
flagship so JVM start-up is not billed to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logspark.plans import catalog  # noqa: E402
from logspark.session import build_session  # noqa: E402

HEADLINE = [
    "facet_counts_all", "filter_events", "typed_predicates", "search_events",
    "fuzzy_search_documents", "session_summaries", "session_event_summaries", "compare_sessions",
    "relative_time", "repeat_groups", "repeat_groups_documents", "next_error", "keep_latest",
    "export_events", "locate_pins", "message_tone_counts", "validate_events", "ingest_report",
    "saved_filters", "stream_session_summaries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # small input files: splits fine enough that every core gets a share of a scan
    spark = build_session(app="logspark-bench", cpus=cpus, extra={"spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "64k"})
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    catalog.QUERIES["facet_counts_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
