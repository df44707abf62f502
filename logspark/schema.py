"""The event v1 contract as Spark types, plus the fixed names the contract defines."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# Fixed values of the event contract (must equal the reference's for equal results).
# Levels in severity order; severity is the list position (trace=0 .. fatal=5).
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
# Context words skipped when a feature tag is chosen.
CONTEXT_SEGMENTS = ["backend", "frontend", "local", "remote", "renderer", "settings", "sidecar"]
# Facets every event is indexed under (plus every scalar ``fields.<name>``).
PRIMARY_FACETS = [
    "level", "source", "tag", "subsystem", "target", "event", "provider", "status",
    "correlation", "app_session_id", "playback_session_id", "request_id",
]
# Field names a typed predicate may name (plus ``fields.<name>``).
QUERY_FIELDS = [
    "schema_version", "timestamp", "level", "source", "tag", "subsystem", "target", "event",
    "message", "app_session_id", "playback_session_id", "request_id", "session_id",
    "provider", "duration_ms", "error_kind", "status", "correlation",
]
NUMERIC_QUERY_FIELDS = ["schema_version", "duration_ms"]
MAX_TAG_CHARACTERS = 64
# End of fixed values.

# Canonical event frame: the envelope as typed columns; ``status`` and ``fields`` keep their
# JSON text (raw, so numbers print as written) and ``event_id`` is the ingestion order.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("schema_version", T.IntegerType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("subsystem", T.StringType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("app_session_id", T.StringType(), False),
    T.StructField("playback_session_id", T.StringType(), True),
    T.StructField("request_id", T.StringType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("target", T.StringType(), True),
    T.StructField("provider", T.StringType(), True),
    T.StructField("error_kind", T.StringType(), True),
    T.StructField("duration_ms", T.DoubleType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("fields", T.StringType(), True),
])
EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields]
ENVELOPE_COLUMNS = EVENT_COLUMNS[1:]
OPTIONAL_ID_COLUMNS = ["playback_session_id", "request_id", "session_id"]
OPTIONAL_TEXT_COLUMNS = ["target", "provider", "error_kind"]
