import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logspark.schema import EVENT_COLUMNS, EVENT_SCHEMA  # noqa: E402
from logspark.session import build_session  # noqa: E402

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    return build_session(app="logspark-tests", cpus="*", shuffle_partitions=8)


def event(i, **kw):
    """One event row with defaults for every required envelope field."""
    row = {
        "event_id": i, "schema_version": 1, "timestamp": BASE + timedelta(seconds=i),
        "level": "info", "source": "app", "subsystem": "core", "event": "tick", "message": f"m{i}",
        "app_session_id": "run-1", "playback_session_id": None, "request_id": None, "session_id": None,
        "target": None, "provider": None, "error_kind": None, "duration_ms": None, "status": None,
        "fields": "{}",
    }
    row.update(kw)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in EVENT_COLUMNS) for r in rows], EVENT_SCHEMA)
