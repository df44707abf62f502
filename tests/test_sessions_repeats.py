from datetime import timedelta

from logspark.operators import navigation as NV
from logspark.operators import repeats as RP
from logspark.operators import sessions as SE
from tests.conftest import BASE, event, frame


def test_session_summaries_out_of_order(spark):
    # the later event is ingested first: min / max and the (time, id) tie rule stay right
    rows = [event(0, timestamp=BASE + timedelta(seconds=10), status='"done"', level="error", provider="remote"),
            event(1, timestamp=BASE, status='"start"', level="warn", provider="local", request_id="r1"),
            event(2, timestamp=BASE + timedelta(seconds=10), status='"late tie"', provider="")]
    s = SE.session_summaries(frame(spark, rows)).first()
    assert s.event_count == 3 and s.warning_count == 1 and s.error_count == 1
    assert s.elapsed_ms == 10000
    assert s.providers == ["local", "remote"]
    assert s.correlation_count == 1
    assert s.status == "late tie"


def test_compare_sessions_max_only_change(spark):
    rows = [event(0, app_session_id="a", event="load", duration_ms=10.0),
            event(1, app_session_id="a", event="load", duration_ms=20.0),
            event(2, app_session_id="b", event="load", duration_ms=14.0),
            event(3, app_session_id="b", event="load", duration_ms=16.0),
            event(4, app_session_id="b", event="extra", level="error")]
    cmp = {r.event: r for r in SE.compare_sessions(frame(spark, rows), "a", "b").collect()}
    assert cmp["load"].count_a == 2 and cmp["load"].count_b == 2
    assert cmp["load"].average_duration_a == cmp["load"].average_duration_b == 15.0
    assert cmp["load"].differs  # max 20 vs 16
    assert cmp["extra"].count_a == 0 and cmp["extra"].errors_b == 1 and cmp["extra"].differs
    order = [r.event for r in SE.compare_sessions(frame(spark, rows), "a", "b").collect()]
    assert order == ["extra", "load"]  # missing on one side sorts first


def test_relative_time_uses_all_rows(spark):
    rows = [event(0, level="info"), event(5, level="error")]
    df = frame(spark, rows)
    view = df.where("level = 'error'")
    r = SE.with_relative_time(view, df).first()
    assert r.relative_ms == 5000 and r.relative_text == "+5.000s"


def test_repeat_groups_shape_and_order(spark):
    rows = [event(0, message="Timeout after 100 ms", level="error"),
            event(1, message="Timeout after 250 ms", level="error"),
            event(2, message="Timeout after 7 ms", level="error"),
            event(3, message="Timeout after 7 ms", level="error", source="other")]
    g = {r.source: r for r in RP.repeat_groups(frame(spark, rows)).collect()}
    assert g["app"].repeat_count == 3 and g["app"].first_event_id == 0
    assert g["app"].latest_event_id == 2 and g["app"].previous_event_id == 1
    assert g["other"].repeat_count == 1 and g["other"].previous_event_id is None
    reps = {r.event_id: r.repeat_summary for r in RP.repeat_representatives(frame(spark, rows)).collect()}
    assert set(reps) == {2, 3}
    assert reps[2] == ("Repeated 3 times · first 2024-01-01 00:00:00.000 +00:00 · last "
                       "2024-01-01 00:00:01.000 +00:00")
    assert reps[3] is None


def test_error_navigation_wraps_and_ignores_block_size(spark):
    rows = [event(i, level="error" if i in (2, 7) else "info") for i in range(10)]
    rows += [event(20, app_session_id="quiet")]
    df = frame(spark, rows)
    results = []
    for block in (1, 3, 1 << 16):
        got = {r.event_id: (r.next_error_id, r.previous_error_id)
               for r in NV.error_neighbours(df, block_size=block).collect()}
        results.append(got)
    assert results[0] == results[1] == results[2]
    got = results[0]
    assert got[0] == (2, 7) and got[2] == (7, 7) and got[5] == (7, 2) and got[8] == (2, 7)
    assert got[20] == (None, None)


def test_keep_latest_and_report(spark):
    df = frame(spark, [event(i) for i in range(5)])
    assert [r.event_id for r in NV.keep_latest(df, 2).collect()] == [4, 3]
    assert [r.event_id for r in NV.keep_latest(df, 0).collect()] == [4]  # clamped to 1
    rep = NV.retention_report(df, 3).first()
    assert (rep.retained, rep.discarded) == (3, 2)


def test_keep_latest_histogram_path_matches_direct(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 60000, 1, 6).select((F.col("id") * 7 % 100003).alias("event_id"))
    want = sorted(r.event_id for r in df.orderBy(F.col("event_id").desc()).limit(25000).collect())
    got = sorted(r.event_id for r in NV.keep_latest(df, 25000, bucket_size=1000).collect())
    assert got == want


def test_error_navigation_over_the_whole_view(spark):
    rows = [event(i, app_session_id=f"r{i % 2}", level="error" if i in (3, 6) else "info") for i in range(8)]
    got = {r.event_id: (r.next_error_id, r.previous_error_id)
           for r in NV.error_neighbours(frame(spark, rows), partition_cols=(), block_size=2).collect()}
    assert got[0] == (3, 6) and got[3] == (6, 6) and got[4] == (6, 3) and got[7] == (3, 6)


def test_keep_latest_at_any_size(spark):
    ids = [i * i * i for i in range(3000)]  # sparse: many passes narrow the cut-off down
    df = spark.createDataFrame([(i,) for i in ids], "event_id long").repartition(7)
    for n in (1, 2, 500, 2999, 3000, 10_000):
        assert [r.event_id for r in NV.keep_latest(df, n).collect()] == ids[:-n - 1:-1], n
    assert NV.keep_latest(df.limit(0), 5).collect() == []
