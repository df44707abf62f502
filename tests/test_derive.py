from pyspark.sql import functions as F

from logspark.functions import columns as C
from tests.conftest import event, frame


def one(df, col):
    return [r[0] for r in df.select(col).orderBy("event_id").collect()] if "event_id" in df.columns else None


def test_correlation_precedence_and_empty_string(spark):
    df = frame(spark, [
        event(0, playback_session_id="pb", request_id="rq", session_id="s"),
        event(1, request_id="rq", session_id="s"),
        event(2, session_id="s"),
        event(3),
        event(4, playback_session_id="", request_id="rq"),
    ])
    got = [r[0] for r in df.orderBy("event_id").select(C.correlation()).collect()]
    assert got == ["pb", "rq", "s", "run-1", ""]


def test_tag_rules(spark):
    long64 = "x" * 64
    long65 = "y" * 65
    df = frame(spark, [
        event(0, message="[Remote][Playback] started"),           # context word skipped
        event(1, message="[Local]"),                               # only context -> first
        event(2, message="done", subsystem="backend.core_fault"),  # subsystem path
        event(3, message="done", subsystem="local.remote"),        # all context -> first part
        event(4, message="done", subsystem="..."),                 # nothing -> Other
        event(5, message=f"[{long64}] x"),                          # 64 chars allowed
        event(6, message=f"[{long65}] x", subsystem="a_b"),         # 65 too long -> subsystem
        event(7, message="prefix text [Cache] hit"),               # brackets anywhere
        event(8, message="[ A ][B", subsystem="s"),                # unterminated segment stops
    ])
    got = [r[0] for r in df.orderBy("event_id").select(C.tag()).collect()]
    assert got == ["Playback", "Local", "Core Fault", "Local", "Other", long64, "A B", "Cache", "A"]


def test_severity_and_status_text(spark):
    df = frame(spark, [event(0, level="trace", status='"ok"'), event(1, level="fatal", status="429"),
                       event(2, status='{"a": 1}'), event(3, status="true")])
    rows = df.orderBy("event_id").select(C.severity(), C.status_text()).collect()
    assert [tuple(r) for r in rows] == [(0, "ok"), (5, "429"), (2, "-"), (2, "true")]


def test_message_shape_and_elapsed_text(spark):
    df = spark.createDataFrame([("  Timeout after 1200 ms\n\tretry 3  ",)], "m string")
    assert df.select(C.message_shape("m")).first()[0] == "timeout after # ms retry #"
    ms = spark.createDataFrame([(1842,), (-25,), (123000,), (3900000,)], "ms long")
    assert [r[0] for r in ms.select(C.relative_elapsed_text("ms")).collect()] == [
        "+1.842s", "-0.025s", "+2m 3.000s", "+1h 05m"]
    assert [r[0] for r in ms.select(C.elapsed_text(F.abs("ms"))).collect()] == [
        "1.8 s", "25 ms", "2m 03s", "65m 00s"]


def test_console_detail(spark):
    fields = ('{"arguments": [{"name": "TypeError", "message": "boom"}, {"message": "same"}, '
              '{"name": "TypeError", "message": "boom"}, {"name": " ", "message": "bare"}, 3]}')
    df = frame(spark, [event(0, event="console.message", message="same", fields=fields),
                       event(1, event="other", fields=fields)])
    got = [r[0] for r in df.orderBy("event_id").select(C.console_detail()).collect()]
    assert got == ["TypeError: boom · bare", None]


def test_infer_subsystem(spark):
    df = spark.createDataFrame([("[Player Core] x",), ("no prefix",), ("[---] y",)], "message string")
    assert [r[0] for r in df.select(C.infer_subsystem()).collect()] == ["player_core", "renderer", "_"]


def test_timestamp_text_in_another_zone(spark):
    df = frame(spark, [event(0)])
    row = df.select(C.timestamp_text("timestamp", tz="Asia/Kolkata").alias("t"),
                    C.timestamp_text("timestamp", C.TIMESTAMP_PRESETS["us_12h"]).alias("u")).first()
    assert row.t == "2024-01-01 05:30:00.000 +05:30"
    assert row.u == "01/01/2024 12:00:00 AM"


def test_message_tone_rules(spark):
    from logspark.functions import tones as TN
    df = spark.createDataFrame([
        (0, "Item NOT_found; retry later"),       # priority + separator run + case
        (1, "errors happened, but found it"),     # 'errors' is not a word match; 'found' is
        (2, "timed-out/then-completed"),          # separators inside and between phrases
        (3, "connection refused"),                # longer phrase wins over 'connected'? no: exact words
        (4, "ÉRROR is not ascii-folded"),         # non-ASCII letters are not case-folded
    ], "event_id long, message string")
    hits = {}
    for r in TN.message_tones(df).orderBy("event_id", "position").collect():
        hits.setdefault(r.event_id, []).append((r.phrase, r.tone))
    assert hits[0] == [("not found", "negative"), ("retry", "warning")]
    assert hits[1] == [("found", "positive")]
    assert hits[2] == [("timed out", "negative"), ("completed", "positive")]
    assert hits[3] == [("connection refused", "negative")]
    assert 4 not in hits
