import json
import os
import tempfile

from pyspark.sql import functions as F

from logspark.functions.redact import redact_json_text
from logspark.sources import jsonl as JL
from logspark.sources import export as EX
from logspark.operators import pins as PN
from tests.conftest import event, frame

GOOD = {"schema_version": 1, "timestamp": 1704067200000, "level": "info", "source": "app",
        "subsystem": "core", "event": "start", "message": "", "app_session_id": 42}


def line(**kw):
    d = dict(GOOD)
    for k, v in kw.items():
        if v is ...:
            d.pop(k)
        else:
            d[k] = v
    return json.dumps(d)


def lines_df(spark, texts):
    return spark.createDataFrame([("f.jsonl", i + 1, t) for i, t in enumerate(texts)],
                                 "file_name string, line_number long, value string")


def test_reject_matrix(spark):
    texts = [
        line(),                                        # valid (numeric app session id, empty message)
        line(level=...),                               # missing level
        line(schema_version=2),                        # unsupported version
        line(request_id=True),                         # boolean id
        line(source=""),                               # empty source
        line(duration_ms=-1),                          # negative duration
        line() + " trailing",                          # trailing garbage
        "not json",
        line(timestamp="2024-01-01T00:00:00.123+02:00"),  # RFC 3339 with offset: valid
        line(timestamp="2024-01-01"),                  # date only: rejected
        line(provider=3),                              # provider must be a string
        line(fields=None),                             # explicit null fields rejected
        line(status={"a": [1, 2]}, fields={"x": 1}, extra_key="dropped"),  # valid
    ]
    got = {r.line_number: r.reason for r in JL.rejected_records(lines_df(spark, texts)).collect()}
    assert set(got) == {2, 3, 4, 5, 6, 7, 8, 10, 11, 12}
    assert got[2] == "missing field level" and got[3] == "unsupported schema_version"
    assert got[7] == "invalid JSON" and got[8] == "invalid JSON"
    valid = {r.line_number: r for r in JL.validate_events(lines_df(spark, texts)).collect()}
    assert set(valid) == {1, 9, 13}
    assert valid[1].app_session_id == "42" and valid[1].message == ""
    assert valid[9].timestamp.isoformat().startswith("2023-12-31T22:00:00.123")
    assert json.loads(valid[13].status) == {"a": [1, 2]}
    assert [r.event_id for r in JL.validate_events(lines_df(spark, texts)).orderBy("line_number").collect()] == [0, 1, 2]


def test_read_event_logs_directory_rules(spark):
    d = tempfile.mkdtemp(prefix="logspark-logs-")
    with open(os.path.join(d, "app.jsonl"), "w") as f:
        f.write(line() + "\n\n   \n" + line(event="second") + "\n" + line(event="partial"))
    with open(os.path.join(d, "app.JSONL.1"), "w") as f:
        f.write(line(event="rotated") + "\n")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored\n")
    os.mkdir(os.path.join(d, "nested"))
    with open(os.path.join(d, "nested", "deep.jsonl"), "w") as f:
        f.write(line() + "\n")
    lines = JL.read_event_logs(spark, [d, d])
    got = sorted((r.file_name, r.line_number) for r in lines.collect())
    assert got == [("app.JSONL.1", 1), ("app.jsonl", 1), ("app.jsonl", 4), ("app.jsonl", 5)]
    report = {r.file_name: r for r in JL.ingest_report(lines).collect()}
    assert report["app.jsonl"].valid == 3 and report["app.jsonl"].invalid == 0
    explicit = JL.read_event_logs(spark, [os.path.join(d, "notes.txt")])
    assert explicit.count() == 1  # explicit files are taken whatever their name


def test_ingest_counts_one_valid_one_invalid(spark):
    rep = JL.ingest_report(lines_df(spark, [line(), "{broken"])).first()
    assert (rep.valid, rep.invalid, rep.last_error) == (1, 1, "invalid JSON")
    health = {r.file_name: r.state for r in JL.source_health(JL.ingest_report(lines_df(spark, [line()])),
                                                              ["f.jsonl", "g.jsonl"]).collect()}
    assert health == {"f.jsonl": "healthy", "g.jsonl": "missing"}


def test_row_numbers_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k"), (F.col("id") % 2).alias("g"))
    out = JL.with_row_numbers(df, ["k"], name="n", within=["g"], start=1)
    for g in (0, 1):
        ns = [r.n for r in out.where(F.col("g") == g).orderBy("k").collect()]
        assert ns == list(range(1, 501))


def test_export_line_and_fingerprint(spark):
    df = frame(spark, [event(0, status='"ok"', fields='{"b": 2, "a": "x"}', duration_ms=1.5, request_id="r"),
                       event(1), event(2)])
    rows = EX.with_export_line(df).orderBy("event_id").collect()
    first = json.loads(rows[0].line)
    assert list(first)[:3] == ["schema_version", "timestamp", "level"]
    assert first["timestamp"] == 1704067200000 and first["fields"] == {"a": "x", "b": 2}
    assert "fields" not in json.loads(rows[1].line) and "target" not in json.loads(rows[1].line)
    fps = [r.fp for r in df.select(EX.event_fingerprint().alias("fp")).collect()]
    assert len(set(fps)) == 3 and all(len(f) == 16 for f in fps)


def test_pins_first_match_and_lost(spark):
    df = frame(spark, [event(0), event(1, message="dup"), event(2)])
    dup = frame(spark, [event(1, message="dup")]).select(EX.event_fingerprint().alias("pin_key"))
    pins = dup.withColumn("note", F.lit("look")).unionByName(
        spark.createDataFrame([("0000000000000000", "gone")], "pin_key string, note string"))
    got = {r.note: (r.matched_event_id, r.retained) for r in PN.locate_pins(pins, df).collect()}
    assert got == {"look": (1, True), "gone": (None, False)}
    assert [r.note for r in PN.lost_pins(pins, df).collect()] == ["gone"]


def test_redaction_any_depth():
    text = json.dumps({"apiToken": "t", "nested": {"Cookie": "c", "list": [{"signature": 1}]}, "ok": 1})
    assert json.loads(redact_json_text(text)) == {
        "apiToken": "[REDACTED]", "nested": {"Cookie": "[REDACTED]", "list": [{"signature": "[REDACTED]"}]}, "ok": 1}
    assert redact_json_text('{"plain": 1}') == '{"plain": 1}'


def test_promote_fields(spark):
    recs = spark.createDataFrame(
        [(0, "info", "svc", "app::mod", "record", "run",
          json.dumps({"request_id": 7, "duration_ms": "12.5", "peers": 3, "message": "hello"}))],
        "event_id long, level string, source string, target string, name string, app_session_id string, "
        "properties string").withColumn("timestamp", F.current_timestamp())
    r = JL.promote_fields(recs).first()
    assert (r.request_id, r.duration_ms, r.message, r.subsystem, r.event) == ("7", 12.5, "hello", "app::mod", "record")
    assert json.loads(r.fields) == {"peers": 3}
    lv = spark.createDataFrame([(" Warning ",), ("Information",), ("log",), ("odd",)], "l string")
    assert [x[0] for x in lv.select(JL.normalize_level("l", unknown="info")).collect()] == ["warn", "info", "info", "info"]


def test_investigation_bundle_lines_form_one_document(spark):
    df = frame(spark, [event(0), event(1, message='quote " and \\n'), event(2)])
    keys = df.where("event_id in (1, 2)").select(EX.event_fingerprint().alias("pin_key"))
    pins = keys.withColumn("note", F.lit("see")).unionByName(
        spark.createDataFrame([("ffffffffffffffff", "lost one")], "pin_key string, note string"))
    located = PN.locate_pins(pins, df)
    lines = EX.investigation_bundle(located, df, ["a.jsonl"], '{"text":""}', 5)
    doc = json.loads("".join(r.text for r in lines.orderBy("line_no").collect()))
    assert doc["format"] == "logspark-investigation-v1" and doc["sources"] == ["a.jsonl"]
    assert [p["note"] for p in doc["pins"]] == ["lost one", "see", "see"]
    assert doc["pins"][0]["event"] == "ffffffffffffffff"
    assert doc["pins"][1]["event"]["message"] == 'quote " and \\n'


def test_line_numbers_when_files_split_across_tasks(spark):
    d = tempfile.mkdtemp(prefix="logspark-split-")
    with open(os.path.join(d, "big.jsonl"), "w") as f:
        for i in range(1, 20001):
            f.write(line(message=f"line {i}") + "\n")
            if i % 997 == 0:
                f.write("   \n")  # whitespace-only lines are skipped but still counted
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = JL.read_event_logs(spark, [d])
        assert lines.rdd.getNumPartitions() > 10
        rows = lines.select("line_number", F.get_json_object("value", "$.message").alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.line_number: int(r.m.split()[1]) for r in rows}
    assert len(got) == 20000
    # physical line number = content number + blank lines written before it
    assert all(n == i + (i - 1) // 997 for n, i in got.items())


def test_numbering_of_wide_rows_at_any_partitioning(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    wide = spark.range(200_000, numPartitions=7).select(
        (F.col("id") * 7919 % 200_003).alias("k"), F.repeat(F.lit("x"), 200).alias("body"), (F.col("id") % 3).cast("string").alias("g"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            out = JL.with_row_numbers(wide, ["k"], name="n")
            got = out.select("k", "n", F.length("body").alias("b")).orderBy("k").collect()
            assert [r["n"] for r in got] == list(range(200_000)) and {r["b"] for r in got} == {200}
            per = JL.with_row_numbers(wide, ["k"], name="n", within=["g"], start=1).groupBy("g").agg(
                F.count_distinct("n").alias("d"), F.max("n").alias("m"), F.count("n").alias("c")).collect()
            assert all(r["d"] == r["m"] == r["c"] for r in per) and sum(r["c"] for r in per) == 200_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_that_must_not_abort_the_ingest(spark):
    base = '"schema_version":1,"level":"info","source":"s","subsystem":"c","event":"e","message":"m","app_session_id":"a"'
    lines = [f'{{"timestamp":{t},{base}}}' for t in ("99999999999999999", "9223372036854775807", "8210266876799999", "0")]
    lines += [f'\t{{"timestamp":0,{base}}}', "[1]", "7"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_name string, line_number long, value string")
    got = {r["line_number"]: r["reason"] for r in JL.parse_event_lines(df).select("line_number", "reason").collect()}
    assert got[0] == got[1] and "timestamp" in got[0]
    assert got[2] is None and got[3] is None and got[4] is None
    assert got[5] == got[6] == "not a JSON object"


def test_redaction_leaks_nothing(spark):
    from logspark.functions.redact import redact_json_text as R
    from logspark.functions.redact import redact_sensitive

    deep = "[" * 5000 + '{"token":"s"}' + "]" * 5000
    assert R(deep) == "[" * 5000 + '{"token":"[REDACTED]"}' + "]" * 5000
    assert R('{"token":"s3",}') == R("{broken secret") == "[REDACTED]"
    assert R('{"\\u0074oken": {"a": [1, "x"]}, "b" : 1e400, "c":1.0}') == '{"token":"[REDACTED]","b":1e400,"c":1.0}'
    assert R('{"a":[{"Api_Key":[1,{"x":2}]},2],"z":{}}') == '{"a":[{"Api_Key":"[REDACTED]"},2],"z":{}}'
    rows = [(1, '{"\\u0074oken":"s"}'), (2, '{"plain": 1}'), (3, None)]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", redact_sensitive("t")).collect())
    assert got == {1: '{"token":"[REDACTED]"}', 2: '{"plain": 1}', 3: None}


def test_merged_sources_get_ids_of_their_own(spark):
    from logspark.operators import saved as SV

    a, b = frame(spark, [event(i, source="a") for i in (5, 7)]), frame(spark, [event(i, source="b") for i in (5, 6, 7)])
    got = [(r["event_id"], r["source"]) for r in SV.merge_events(a, b).orderBy("event_id").collect()]
    assert got == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "b")]


def test_pins_keep_their_snapshot(spark):
    old = frame(spark, [event(5, message="gone"), event(1, message="here")])
    pins = PN.take_pins(old, F.concat(F.lit("n"), F.col("event_id")))
    located = PN.locate_pins(pins, frame(spark, [event(1, message="here")]))
    strip = {r.note: r for r in PN.pin_strip(located).collect()}
    assert (strip["n1"].position, strip["n1"].retained, strip["n5"].position, strip["n5"].retained) == (1, True, 2, False)
    assert strip["n5"].delta_ms == 4000 and strip["n1"].next_pin == strip["n5"].pin_key == strip["n1"].previous_pin
    lines = EX.investigation_bundle(located, old, ["s"], "{}", 0).orderBy("line_no").collect()
    doc = json.loads("".join(r.text for r in lines))
    assert [p["event"]["message"] for p in doc["pins"]] == ["here", "gone"]


def test_numbers_keep_their_text(spark):
    texts = [line(app_session_id=..., extra=1)[:-1] + ', "app_session_id": 1.0, "request_id": 1e3, "session_id": 12345678901234567890, '
             '"status": -0.0, "fields": {"z": 1.0, "s": "1.0", "o": {"y": 1.0}, "n": null, "i": 12345678901234567890123}}',
             line(status="1.0"), line()[:-1] + ', "status": [1.0, 2]}']
    rows = JL.parse_event_lines(lines_df(spark, texts)).orderBy("line_number").collect()
    assert [r.reason for r in rows] == [None] * 3
    assert (rows[0].app_session_id, rows[0].request_id, rows[0].session_id, rows[0].status) == ("1.0", "1000.0", "12345678901234567890", "-0.0")
    assert [rows[1].status, rows[2].status] == ['"1.0"', "[1.0,2]"]
    out = [r.line for r in EX.with_export_line(JL.parse_event_lines(lines_df(spark, texts))).orderBy("line_number").collect()]
    assert out[0].endswith('"status":-0.0,"fields":{"i":12345678901234567890123,"n":null,"o":{"y":1.0},"s":"1.0","z":1.0}}')
    assert out[1].endswith('"status":"1.0"}') and out[2].endswith('"status":[1.0,2]}')


def test_declared_keys_may_not_repeat(spark):
    texts = [line()[:-1] + ', "x": 1, "x": {"y": 1, "y": 2}}', line()[:-1] + ', "source": "b", "level": "info"}', line()[:-1] + ', "fields": {"a": 1, "a": 2}}']
    rows = JL.parse_event_lines(lines_df(spark, texts)).orderBy("line_number").collect()
    assert [r.reason for r in rows] == [None, "repeated field level, source", None] and rows[2].fields == '{"a":2}'


def test_one_parser_call_and_no_window_without_partitions(spark):
    lines = lines_df(spark, [line()])
    for df in (JL.parse_event_lines(lines), JL.rejected_records(lines), JL.ingest_report(lines), JL.parse_event_lines(lines).where("reason is null")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.lower().count("parse_json(") + plan.count("parseJson") == 1
    for within in ([], ["file_name"]):
        plan = JL.with_row_numbers(lines, ["line_number"], within=within)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def test_promoted_durations(spark):
    texts = {'"12.5"': 12.5, '"1e3"': 1000.0, '"+.5"': 0.5, '"1.0d"': None, '"NaN"': None, '"-5"': None, '"Infinity"': None, "-5": None, "7": 7.0, "true": None, '" 1"': None}
    recs = spark.createDataFrame([(i, "info", "svc", "t", "r", "run", f'{{"duration_ms": {t}}}') for i, t in enumerate(texts)],
                                 "event_id long, level string, source string, target string, name string, app_session_id string, "
                                 "properties string").withColumn("timestamp", F.current_timestamp())
    assert [r.duration_ms for r in JL.promote_fields(recs).orderBy("event_id").collect()] == list(texts.values())
