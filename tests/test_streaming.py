import json
import os
import tempfile

from pyspark.sql import functions as F

from logspark.operators import repeats as RP
from logspark.operators import sessions as SE
from logspark.streaming import streams as ST
from tests.conftest import event, frame


def _scratch():
    return tempfile.mkdtemp(prefix="logspark-stream-")


def test_stream_summaries_equal_batch(spark):
    rows = [event(i, app_session_id=f"r{i % 3}", level="error" if i % 4 == 0 else "info",
                  request_id=f"q{i % 5}" if i % 3 else None,
                  status='"s%d"' % i, provider="p" if i % 2 else None) for i in range(40)]
    df = frame(spark, rows)
    land, out, ck = _scratch(), _scratch(), _scratch()
    df.repartition(4).write.mode("overwrite").parquet(os.path.join(land, "in"))
    stream = ST.stream_events(spark, os.path.join(land, "in"))
    ST.run_aggregate_to_table(ST.stream_session_summaries(stream), os.path.join(out, "t"), ck).awaitTermination()
    stream2 = ST.stream_events(spark, os.path.join(land, "in"))
    ST.run_aggregate_to_table(ST.stream_session_correlations(stream2), os.path.join(out, "p"),
                              _scratch()).awaitTermination()
    table = ST.session_summary_table(spark.read.parquet(os.path.join(out, "t")),
                                     spark.read.parquet(os.path.join(out, "p")))
    got = {r.app_session_id: (r.event_count, r.error_count, r.status, r.correlation_count)
           for r in table.collect()}
    want = {r.app_session_id: (r.event_count, r.error_count, r.status, r.correlation_count)
            for r in SE.session_summaries(df).collect()}
    assert got == want


def test_stream_repeat_groups_and_latest_equal_batch(spark):
    rows = [event(i, message=f"fail {i}", level="error", source=f"s{i % 2}") for i in range(30)]
    df = frame(spark, rows)
    land = _scratch()
    df.repartition(5).write.parquet(os.path.join(land, "in"))
    table = os.path.join(_scratch(), "t")
    ST.stream_repeat_groups(ST.stream_events(spark, os.path.join(land, "in")), table, _scratch()).awaitTermination()
    cols = ["source", "repeat_count", "first_event_id", "latest_event_id", "previous_event_id"]
    got = sorted(tuple(r) for r in ST.latest_table(spark, table).select(*cols).collect())
    want = sorted(tuple(r) for r in RP.repeat_groups(df).select(*cols).collect())
    assert got == want
    table2 = os.path.join(_scratch(), "t")
    ST.stream_keep_latest(ST.stream_events(spark, os.path.join(land, "in")), 7, table2, _scratch()).awaitTermination()
    assert sorted(r.event_id for r in ST.latest_table(spark, table2).collect()) == list(range(23, 30))


def test_stream_validate_side_reports(spark):
    land = _scratch()
    good = json.dumps({"schema_version": 1, "timestamp": 1, "level": "info", "source": "a", "subsystem": "b",
                       "event": "c", "message": "", "app_session_id": "r"})
    for i in range(3):
        with open(os.path.join(land, f"part{i}.jsonl"), "w") as f:
            f.write(good + "\n" + "{bad\n" + good + "\n")
    ev, rej, health = _scratch(), _scratch(), _scratch()
    q = ST.stream_validate(ST.stream_event_logs(spark, land), ev, rej, health, _scratch())
    q.awaitTermination()
    assert spark.read.parquet(ev).count() == 6
    r = spark.read.parquet(rej)
    assert r.count() == 3 and {x.line_number for x in r.collect()} == {2}
    h = spark.read.parquet(health).agg(F.sum("valid"), F.sum("invalid")).first()
    assert tuple(h) == (6, 3)


def test_keep_latest_paused_then_resumed(spark):
    land = _scratch()
    for part in range(3):
        frame(spark, [event(part * 3 + i) for i in range(3)]).coalesce(1).write.parquet(os.path.join(land, "in", f"p{part}"))
    table = os.path.join(_scratch(), "t")
    ck = _scratch()
    # paused: nothing is trimmed while batches arrive
    ST.stream_keep_latest(ST.stream_events(spark, os.path.join(land, "in", "p0")), 2, table, ck,
                          paused=True).awaitTermination()
    assert ST.latest_table(spark, table).count() == 3
    # resumed: the next merge catches up to the newest n
    table2 = os.path.join(_scratch(), "t")
    ST.stream_keep_latest(ST.stream_events(spark, os.path.join(land, "in", "*")), 2, table2,
                          _scratch()).awaitTermination()
    assert sorted(r.event_id for r in ST.latest_table(spark, table2).collect()) == [7, 8]


def test_repeat_group_merge_rule(spark):
    from logspark.functions import columns as C
    key = ["app", "core", "tick", "", "boom", ""]
    cols = ", ".join([f"{c} string" for c in C.REPEAT_KEY_COLUMNS]
                     + [f"{c} long" for c in ["repeat_count", "first_event_id", "latest_event_id", "previous_event_id"]])
    old = spark.createDataFrame([tuple(key) + (3, 1, 9, 7)], cols)
    new = spark.createDataFrame([tuple(key) + (2, 8, 12, 8)], cols)
    single = spark.createDataFrame([tuple(key) + (1, 15, 15, None)], cols)
    m = ST.merge_repeat_groups(old, new).first()
    assert (m.repeat_count, m.first_event_id, m.latest_event_id, m.previous_event_id) == (5, 1, 12, 9)
    m2 = ST.merge_repeat_groups(ST.merge_repeat_groups(old, new), single).first()
    assert (m2.repeat_count, m2.latest_event_id, m2.previous_event_id) == (6, 15, 12)


def test_stream_ids_go_on_from_batch_to_batch(spark):
    land, ckpt = _scratch(), _scratch()
    ev, rej, health = (os.path.join(_scratch(), "t") for _ in range(3))
    line = {"schema_version": 1, "timestamp": 1, "level": "info", "source": "a", "subsystem": "b", "event": "c",
            "app_session_id": "r"}
    for part in range(3):
        with open(os.path.join(land, f"part{part}.jsonl"), "w") as f:
            f.write("".join(json.dumps(line | {"message": f"{part}-{i}"}) + "\n" for i in range(3)) + "{bad\n")
        ST.stream_validate(ST.stream_event_logs(spark, land), ev, rej, health, ckpt).awaitTermination()
    rows = spark.read.parquet(ev).orderBy("event_id").collect()
    assert [(r.event_id, r.message) for r in rows] == [(i, f"{i // 3}-{i % 3}") for i in range(9)]


def test_update_table_keeps_the_newest_values_and_old_versions_go(spark):
    land, out, ckpt, table, ckpt2 = (_scratch() for _ in range(5))
    for part in range(5):
        frame(spark, [event(part * 4 + i, app_session_id=f"r{i % 2 + part}") for i in range(4)]).write.parquet(
            os.path.join(land, "in"), mode="append")
        stream = ST.stream_events(spark, os.path.join(land, "in"))
        ST.run_aggregate_to_table(ST.stream_session_summaries(stream), os.path.join(out, "t"), ckpt).awaitTermination()
        ST.stream_keep_latest(stream, 6, os.path.join(table, "t"), ckpt2).awaitTermination()
    now = ST.current_rows(spark, os.path.join(out, "t"), ["app_session_id"]).collect()
    assert {r.app_session_id: r.event_count for r in now} == {"r0": 2, "r1": 4, "r2": 4, "r3": 4, "r4": 4, "r5": 2}
    assert sorted(r.event_id for r in ST.latest_table(spark, os.path.join(table, "t")).collect()) == list(range(14, 20))
    assert len(ST._versions(spark, os.path.join(table, "t"))) == ST.KEPT_VERSIONS


def test_decoded_rows_of_a_batch_stay_out_of_the_executors_memory(spark, monkeypatch):
    land, ckpt, plans, folders = _scratch(), _scratch(), [], []
    line = {"schema_version": 1, "timestamp": 1, "level": "info", "source": "a", "subsystem": "b", "event": "c", "app_session_id": "r"}
    for part in range(2):
        with open(os.path.join(land, f"part{part}.jsonl"), "w") as f:
            f.write("".join((json.dumps(line | {"message": f"{part}-{i}"}) if i % 3 else "{bad") + "\n" for i in range(6)))
    number = ST.JL.with_row_numbers

    def seen(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        folders.extend({os.path.dirname(f) for f in df.inputFiles()})
        return number(df, *args, **kw)

    monkeypatch.setattr(ST.JL, "with_row_numbers", seen)
    ev, rej, health = (os.path.join(_scratch(), "t") for _ in range(3))
    ST.stream_validate(ST.stream_event_logs(spark, land), ev, rej, health, ckpt).awaitTermination()
    assert plans and not any("InMemoryTableScan" in p for p in plans) and not any("try_parse_json" in p for p in plans)
    rows = spark.read.parquet(ev).orderBy("event_id").collect()
    assert [(r.event_id, r.message, r.line_number) for r in rows] == [(k, f"{k // 4}-{i}", i + 1) for k, i in enumerate([1, 2, 4, 5] * 2)]
    assert sorted((r.file_name, r.line_number) for r in spark.read.parquet(rej).collect()) == [(f"part{p}.jsonl", n) for p in range(2) for n in (1, 4)]
    assert sorted((r.valid, r.invalid, r.last_error is not None) for r in spark.read.parquet(health).collect()) == [(4, 2, True)] * 2
    assert folders and not any(os.path.exists(f.removeprefix("file:")) for f in folders)
