"""Write PLANS.md: physical plan outlines of the key operators over the event store.

Usage: python tools/plans.py [sf_dir]   (events are written to a fresh store first)
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from logspark.operators import facets as FA  # noqa: E402
from logspark.operators import filters as FI  # noqa: E402
from logspark.operators import navigation as NV  # noqa: E402
from logspark.operators import repeats as RP  # noqa: E402
from logspark.operators import sessions as SE  # noqa: E402
from logspark.session import build_session  # noqa: E402
from logspark.sources import store as SS  # noqa: E402
from logspark.sources import tables as T  # noqa: E402

KEEP = re.compile(r"(Exchange|HashAggregate|ObjectHashAggregate|Window|WindowGroupLimit|Join|Scan|"
                  r"TakeOrdered|Filter|Sort |Expand|Generate|BroadcastExchange|Union)")


def outline(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            lines.append(line[:170])
    return "\n".join(lines)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(app="logspark-plans", cpus=8)
    path = tempfile.mkdtemp(prefix="logspark-plans-") + "/store"
    SS.write_event_store(T.load_events(spark, sf_dir), path)
    ev = SS.read_event_store(spark, path)
    state = FI.FilterState(facets={"source": {"include": ["src0", "src1"]}, "provider": {"exclude": ["local"]}},
                           minimum_level="debug")
    cases = {
        "F9 filter + search (pushdown into the store scan)":
            FI.apply_filter(ev, FI.FilterState(facets={"source": {"include": ["src0"]}}, minimum_level="warn",
                                               text="refused")).select("event_id"),
        "A2 facet counts (one scan, partial aggregate)": FA.facet_counts_all(ev, state, ordered=False),
        "A5 run summaries (partial aggregates, two-phase distinct)": SE.session_summaries(ev),
        "A8 repeat groups (partial top-2 before the shuffle)": RP.repeat_groups(ev),
        "W2 error navigation (blocked windows)": NV.error_neighbours(ev).select("event_id", "next_error_id"),
        "O1 latest 250 000 (histogram cut-off)": NV.keep_latest(ev, 250_000).select("event_id"),
        "J1 relative time (aggregate joined back)": SE.with_relative_time(ev.where(F.col("severity") >= 3), ev)
            .select("event_id", "relative_ms"),
    }
    out = ["# Physical plan outlines", "",
           "Generated by `tools/plans.py` over a partitioned event store written from "
           f"`{os.path.basename(sf_dir)}` events (operator lines only; AQE may still switch joins at run time).", ""]
    for title, df in cases.items():
        out += [f"## {title}", "", "```", outline(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
