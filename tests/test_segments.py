import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from logspark.operators import repeats as RP
from logspark.operators import sessions as SE
from logspark.streaming import segments as SG
from logspark.streaming import streams as ST
from tests.conftest import event, frame


def _scratch():
    return os.path.join(tempfile.mkdtemp(prefix="logspark-segments-"), "t")


def _log(spark, merge=None, fanout=4):
    return SG.SegmentLog(spark, _scratch(), merge or SG.newest_values(["k"]), fanout)


def test_segments_stay_few_over_many_batches_and_replays_add_nothing(spark):
    log, want, most = _log(spark), {}, 0
    rng = random.Random(1)
    for batch in range(18):
        rows = [(rng.randrange(6), batch * 10 + i, batch) for i in range(3)]
        rows = list({r[0]: r for r in rows}.values())
        df = spark.createDataFrame(rows, f"k long, v long, {SG.ORDER} long")
        log.append(df, batch)
        log.append(df.withColumn("v", F.lit(-1).cast("long")), batch)
        want.update({k: v for k, v, _ in rows})
        most = max(most, len(log.manifest()["segments"]))
    assert {r.k: r.v for r in log.read().collect()} == want
    assert most <= 3 * 3 and log.manifest()["batch"] == 17
    kept = [n for n in os.listdir(log.path) if n.startswith("seg-")]
    assert len(kept) <= most + 2 * 4 and len(log._versions()) == SG.KEPT_MANIFESTS


def test_a_reader_keeps_its_snapshot_and_two_writers_don_t_mix(spark):
    log = _log(spark, fanout=2)
    df = lambda b: spark.createDataFrame([(1, b, b)], f"k long, v long, {SG.ORDER} long")
    log.append(df(0), 0)
    before = log.read()
    state = log.manifest()
    log.append(df(1), 1)
    assert before.first().v == 0 and log.read().first().v == 1
    with pytest.raises(RuntimeError):
        log._publish(state)


def test_whole_segments_retire():
    seg = lambda low, high, rows: {"low": low, "high": high, "rows": rows}
    a, b, c, d = seg(0, 9, 10), seg(10, 19, 10), seg(15, 24, 10), seg(25, 29, 5)
    assert SG.retired([a, b, c, d], 5) == [d]
    assert SG.retired([a, b, c, d], 6) == [b, c, d]
    assert SG.retired([a, b, c, d], 25) == [b, c, d] and SG.retired([a, b, c, d], 26) == [a, b, c, d]
    assert SG.retired([seg(None, None, 0), a], 3) == [a]


def _batches(spark, parts):
    """A landing folder that gets one file of events at a time."""
    land = _scratch()
    for rows in parts:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(land)
        yield land


def test_newest_rows_paused_and_resumed(spark):
    path, ck, n, seen = _scratch(), _scratch(), 5, []
    parts = [[event(i) for i in range(b * 4, b * 4 + 4)] for b in (1, 0, 2, 3, 4, 5)]
    for b, land in enumerate(_batches(spark, parts)):
        paused = b in (2, 3)
        SG.keep_newest(ST.stream_events(spark, land), n, path, ck, paused=paused, fanout=3).awaitTermination()
        seen += [e["event_id"] for e in parts[b]]
        kept = {r.event_id for r in SG.newest_rows(spark, path).collect()}
        newest = sorted(seen)[-n:]
        assert set(newest) <= kept <= set(seen)
        assert [r.event_id for r in SG.newest_rows(spark, path, n).collect()] == newest[::-1]
        if b == 3:
            assert kept >= set(seen[4:])  # nothing that came since the pause began is gone
    assert len(kept) < 4 * 4


def test_groups_and_summaries_equal_the_batch_results(spark):
    rows = [event(i, message=f"fail {i}", level="error" if i % 3 else "info", source=f"s{i % 4}", app_session_id=f"r{i % 5}") for i in range(60)]
    rng = random.Random(2)
    rng.shuffle(rows)
    groups, table, ck1, ck2 = (_scratch() for _ in range(4))
    for land in _batches(spark, [rows[i:i + 12] for i in range(0, 60, 12)]):
        stream = ST.stream_events(spark, land)
        SG.keep_repeat_groups(stream, groups, ck1, fanout=2).awaitTermination()
        SG.keep_current(ST.stream_session_summaries(stream), table, ck2, ["app_session_id"], fanout=2).awaitTermination()
    df = frame(spark, rows)
    cols = ["source", "rk_message", "repeat_count", "first_event_id", "latest_event_id", "previous_event_id"]
    assert sorted(map(tuple, SG.repeat_groups_now(spark, groups).select(*cols).collect())) == sorted(map(tuple, RP.repeat_groups(df).select(*cols).collect()))
    got = {r.app_session_id: (r.event_count, r.error_count) for r in SG.current_values(spark, table, ["app_session_id"]).collect()}
    assert got == {r.app_session_id: (r.event_count, r.error_count) for r in SE.session_summaries(df).collect()}
