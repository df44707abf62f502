"""The README's end-to-end flow: JSONL files -> validated events -> event store -> views."""

import json
import os
import tempfile

from logspark.operators import facets, filters, repeats, sessions
from logspark.sources import export, jsonl, store


def test_readme_flow(spark):
    logs = tempfile.mkdtemp(prefix="logspark-usage-")
    with open(os.path.join(logs, "backend.jsonl"), "w") as f:
        for i in range(20):
            f.write(json.dumps({
                "schema_version": 1, "timestamp": 1704067200000 + i * 1000,
                "level": "error" if i % 5 == 0 else "info", "source": "backend", "subsystem": "api.remote",
                "event": "request", "message": f"[Fetch] timeout after {i} ms", "app_session_id": f"run-{i % 2}",
                "request_id": f"r{i % 3}", "duration_ms": float(i), "fields": {"region": "eu"}}) + "\n")
        f.write("{not json\n")
    # --- the README example, verbatim in substance
    lines = jsonl.read_event_logs(spark, [logs])
    events = jsonl.validate_events(lines)
    path = tempfile.mkdtemp(prefix="logspark-usage-store-") + "/events"
    store.write_event_store(events, path)
    ev = store.read_event_store(spark, path)
    state = filters.FilterState(facets={"source": {"include": ["backend"]}}, minimum_level="warn", text="timeout")
    counts = facets.facet_counts_all(ev, state)
    runs = sessions.session_summaries(filters.apply_filter(ev, state))
    groups = repeats.repeat_groups(filters.apply_filter(ev, state))
    out = tempfile.mkdtemp(prefix="logspark-usage-out-") + "/filtered"
    export.export_events(filters.apply_filter(ev, state), out)
    # ---
    assert jsonl.rejected_records(lines).count() == 1
    assert {(r.facet, r.value): r["count"] for r in counts.collect()}[("tag", "Fetch")] == 4
    assert sorted((r.app_session_id, r.error_count) for r in runs.collect()) == [("run-0", 2), ("run-1", 2)]
    assert [r.repeat_count for r in groups.collect()] == [4]
    exported = [json.loads(x.value) for x in spark.read.text(out).collect()]
    assert len(exported) == 4 and all(e["level"] == "error" for e in exported)
