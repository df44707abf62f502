import glob
import os
import random
import tempfile

import pytest
from logspark.plans import catalog
from logspark.sources import tables as T
from logspark.streaming import follow as FO
from tests.test_scale import _events


def _folded(reports):
    state = None
    for _, _, *r in reports:
        state = FO.next_state(state, *r)
    return state


@pytest.mark.parametrize("errors", [0.0, 0.01, 0.3])
def test_reports_are_put_in_order_in_bounded_memory(monkeypatch, errors):
    monkeypatch.setattr(FO, "HELD_RUNS", 4)
    monkeypatch.setattr(FO, "RUN_ROWS", 3)
    runs, run = [], FO._run
    monkeypatch.setattr(FO, "_run", lambda rows: runs.append(1) or run(rows))
    rng = random.Random(5)
    rows = [(i // 7, i % 7, "error" if rng.random() < errors else rng.choice(["valid", "invalid", "replaced", "recovered"]), rng.randrange(5), i, f"d{i}")
            for i in range(1000)]
    rows += [(5, 1, "invalid", 2, 3, "tie")]
    rng.shuffle(rows)
    got = list(FO.in_order(iter(rows), held=50))
    want = sorted(rows, key=lambda r: r[:2])
    assert _folded(got) == _folded(want) and (got == want if not errors else len(got) <= len(want))
    assert runs if errors < 0.3 else not runs  # without an error nothing may go, so it goes to disk
    assert list(FO.in_order(iter([]))) == []


def test_many_small_splits_make_few_tasks():
    splits = [FO._Split("f", 0, at, at + 10) for at in range(0, 50_000, 10)]
    tasks = FO._dealt(splits)
    assert len(tasks) <= FO.TASKS and [(s.start, s.end) for t in tasks for s in t.splits] == [(s.start, s.end) for s in splits]
    assert FO._dealt([]) == [] and len(FO._dealt(splits[:5])) == 5
    wide = [FO._Split("f", 0, i * FO.SPLIT_BYTES, (i + 1) * FO.SPLIT_BYTES) for i in range(1000)]
    assert len(FO._dealt(wide)) == 1000


@pytest.fixture
def many_tasks(spark):
    """No joining of small partitions, so that small rows show who writes what."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def test_a_source_s_file_is_sorted_by_many_tasks(many_tasks):
    spark, base = many_tasks, _events(many_tasks)
    events = T.table(spark, base, "events")
    _, found = T._write_pieces(T._with_log_file(events))
    assert len(found) == 3 and all(len(p) > 1 for p in found.values())
    lines = {}
    for r in T.event_lines(events).orderBy("event_id").collect():
        lines.setdefault(r.file_name, []).append(r.value)
    land = catalog._landing_lines(spark, base)
    for name, want in lines.items():
        (path,) = glob.glob(f"{land.removeprefix('file:')}/source_file={name}/*")
        with open(path) as f:
            assert f.read() == "".join(x + "\n" for x in want)


def test_growing_files_are_put_together_from_pieces(many_tasks):
    spark, base, land = many_tasks, _events(many_tasks), os.path.join(tempfile.mkdtemp(), "land")
    events = T.table(spark, base, "events")
    lines = {}
    for r in T.event_lines(T._with_log_file(events), keep=("log_file",)).withColumn("phase", T._phase()).orderBy("event_id").collect():
        lines.setdefault(r.log_file, {}).setdefault(r.phase, []).append((r.value + "\n").encode())
    sums = {n: {p: b"".join(x) for p, x in phases.items()} for n, phases in lines.items()}
    half = {n: len(p[1][0]) // 2 for n, p in lines.items()}
    for phase in range(3):
        T.grow_log_files(events, land, phase)
        for n, s in sums.items():
            want = s[0] + s[1][:half[n]] if phase == 0 else s[0] + s[1] if phase == 1 else s[2] if n in (T.TRUNCATED, T.REPLACED) else s[0] + s[1] + s[2]
            with open(f"{land}/{n}", "rb") as f:
                assert f.read() == want, (phase, n)
    assert sorted(os.listdir(land)) == sorted(sums)


def test_lines_are_numbered_in_the_split_that_read_them(spark):
    from logspark.sources import jsonl as JL

    path = os.path.join(tempfile.mkdtemp(), "a.jsonl")
    with open(path, "w") as f:
        f.write("".join(f"line {i}\n" if i % 5 else "\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = JL.read_event_logs(spark, [path])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r.line_number, r.value) for r in df.collect()) == [(i + 1, f"line {i}") for i in range(20_000) if i % 5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
