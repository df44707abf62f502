"""Sinks: normalised JSONL export (K1) and the investigation bundle (K2).

The export line is the event in declared key order, ``timestamp`` as epoch ms, absent
options omitted, ``status`` / ``fields`` re-serialised compactly (object keys sorted),
``fields`` omitted when empty. The same line is the content the fingerprint (P19) hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C

# Declared order of the envelope keys (fixed by the event contract).
EXPORT_KEYS = ["schema_version", "timestamp", "level", "source", "subsystem", "target", "event",
               "message", "app_session_id", "playback_session_id", "request_id", "session_id",
               "provider", "duration_ms", "error_kind"]


def export_line() -> Column:
    """K1: one normalised JSON text per event (no trailing newline)."""
    envelope = F.to_json(F.struct(*[
        (F.unix_millis("timestamp").alias("timestamp") if k == "timestamp" else F.col(k)) for k in EXPORT_KEYS]))
    status = F.when(F.col("status").isNotNull(), F.concat(F.lit(',"status":'), C.compact_json("status")))
    compact_fields = C.compact_json("fields")
    fields = F.when(F.col("fields").isNotNull() & (compact_fields != "{}"),
                    F.concat(F.lit(',"fields":'), compact_fields))
    return F.concat(F.substring(envelope, F.lit(1), F.length(envelope) - 1),
                    F.coalesce(status, F.lit("")), F.coalesce(fields, F.lit("")), F.lit("}"))


def with_export_line(df: DataFrame) -> DataFrame:
    return df.withColumn("line", export_line())


def export_events(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: write the (filtered) events as normalised JSONL text files under ``path``."""
    with_export_line(df).select("line").write.mode(mode).text(path)


def event_fingerprint() -> Column:
    """Stable 64-bit content key (16 hex digits) of the normalised event."""
    return F.substring(F.sha2(export_line(), 256), 1, 16)


def with_event_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", event_fingerprint())


def investigation_bundle(pins_located: DataFrame, events: DataFrame, sources: list[str],
                         filter_json: str, created_at_ms: int) -> DataFrame:
    """K2: the investigation document as ordered text lines (``line_no``, ``text``).

    Line 0 opens the document (format id, creation time, sources, filter), then one line
    per pin in (event time, key) order with its note and event snapshot (the pin's own; for a
    bare pin the export line of the event found, else the key), then the closing line. Joined in
    ``line_no`` order (``write.text`` of the sorted lines) the text is one JSON document;
    no step holds all pins in one task."""
    from logspark.sources.jsonl import with_row_numbers

    spark = events.sparkSession
    if "event_json" in pins_located.columns:
        snap = pins_located.withColumn("line", F.col("event_json"))
    else:
        snap = pins_located.join(
            with_export_line(events).select(F.col("event_id").alias("matched_event_id"), "line"),
            "matched_event_id", "left")
    numbered = with_row_numbers(snap, ["pin_timestamp", "pin_key", "note"], name="line_no", start=1)
    count = numbered.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    body = F.concat(F.lit('{"note":'), F.coalesce(C.json_string(F.col("note")), F.lit("null")),
                    F.lit(',"event":'), F.coalesce(F.col("line"), C.json_string(F.col("pin_key"))), F.lit("}"))
    pins = (numbered.withColumn("_one", F.lit(1)).join(count, "_one")
                    .select("line_no", F.concat(body, F.when(F.col("line_no") < F.col("_n"), F.lit(","))
                                                .otherwise(F.lit(""))).alias("text")))
    sources_json = ",".join('"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' for s in sources)
    head = (f'{{"format":"logspark-investigation-v1","created_at":{int(created_at_ms)},'
            f'"sources":[{sources_json}],"filter":{filter_json},"pins":[')
    edges = spark.createDataFrame([(0, head)], "line_no long, text string").unionByName(
        count.select((F.col("_n") + 1).alias("line_no"), F.lit("]}").alias("text")))
    return edges.unionByName(pins)
