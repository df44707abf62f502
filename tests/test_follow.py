import io
import json
import os
import random
import tempfile

import pytest

from logspark.sources import jsonl as JL
from logspark.streaming import follow as FO
from logspark.streaming import streams as ST


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_line_ends_and_splits_equal_plain_splitting(monkeypatch):
    monkeypatch.setattr(FO, "BLOCK_BYTES", 5)
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(60)))
        f = _File(data)
        at = rng.randrange(len(data) + 1)
        assert FO.last_line_end(f, at) == data[:at].rfind(b"\n") + 1
        assert FO.next_line_end(f, at, len(data)) == (data.find(b"\n", at) + 1 or len(data))
        end = data.rfind(b"\n") + 1
        first = data[:rng.randrange(end + 1)].rfind(b"\n") + 1
        want, here = [], first
        for line in data[first:end].split(b"\n")[:-1]:
            want.append((here, line))
            here += len(line) + 1
        step = rng.randrange(1, 20)
        got = [x for a in range(first, end, step) for x in FO.split_records(f, first, a, min(a + step, end))]
        assert got == want


def test_restarts_and_budget(tmp_path):
    path = str(tmp_path / "a.jsonl")
    assert FO.inspect(path) == {"error": "missing"} and FO.inspect(str(tmp_path)) == {"error": "not a regular file"}
    (tmp_path / "a.jsonl").write_bytes(b"half a record")
    assert FO.inspect(path) == {"end": 0, "id": ""} == FO.inspect("file://" + path)
    (tmp_path / "a.jsonl").write_bytes(b"one\ntwo\nthree\nfo")
    first = FO.inspect(path)
    assert first["end"] == 14 and not FO.restarted({}, first) and not FO.restarted({"end": 0, "id": ""}, first)
    with open(path, "ab") as f:
        f.write(b"ur\n")
    assert FO.inspect(path)["end"] == 19 and not FO.restarted(first, FO.inspect(path))
    assert [FO.inspect(path, b, {})["end"] for b in (1, 4, 5, 100)] == [4, 4, 8, 19]
    assert FO.inspect(path, 1, first)["end"] == 19
    (tmp_path / "a.jsonl").write_bytes(b"ONE\ntwo\nthree\nfour\nfive\n")
    assert FO.restarted(first, FO.inspect(path))
    (tmp_path / "a.jsonl").write_bytes(b"one\n")
    assert FO.restarted(first, FO.inspect(path)) and FO.inspect(path, 1, first)["end"] == 4


def _line(i, **kw):
    return json.dumps({"schema_version": 1, "timestamp": i, "level": "info", "source": "a", "subsystem": "b", "event": "c",
                       "message": f"m{i}", "app_session_id": "r"} | kw) + "\n"


class _Follow:
    def __init__(self, spark, paths, **options):
        self.spark, self.paths, self.options = spark, paths, options
        base = tempfile.mkdtemp(prefix="logspark-follow-")
        self.ev, self.rej, self.rep, self.ck = (os.path.join(base, n) for n in ("ev", "rej", "rep", "ck"))

    def step(self):
        lines = FO.follow_event_logs(self.spark, self.paths, **self.options)
        q = FO.stream_follow(lines, self.ev, self.rej, self.rep, self.ck)
        q.awaitTermination()
        assert q.exception() is None
        return self

    def events(self):
        rows = self.spark.read.parquet(self.ev).orderBy("event_id").collect()
        return [(r.event_id, r.file_name, r.generation, r.line_number, r.message) for r in rows]

    def rejects(self):
        return sorted((r.file_name, r.generation, r.line_number, r.reason) for r in self.spark.read.parquet(self.rej).collect())

    def reports(self):
        rows = self.spark.read.parquet(self.rep).where("kind not in ('valid', 'read')").orderBy("batch_id", "file_name", "seq").collect()
        return [(r.batch_id, r.file_name, r.kind) for r in rows]


def test_half_records_truncation_replacement_and_new_files(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text(_line(0) + "not json\n\n" + _line(1) + _line(2)[:20])
    (tmp_path / "notes.txt").write_text("not followed\n")
    f = _Follow(spark, [str(tmp_path), str(tmp_path / "late.log")], split_bytes=100).step()
    assert [e[1:] for e in f.events()] == [("a.jsonl", 0, 1, "m0"), ("a.jsonl", 0, 4, "m1")]
    with a.open("ab") as out:
        out.write((_line(2)[20:] + _line(3)).encode() + b'{"message": "\xff"}\n')
    b.write_text(_line(4))
    f.step()
    assert [e[4] for e in f.events()] == ["m0", "m1", "m2", "m3", "m4"]
    # the batch scan of the file sees the same lines
    scan = JL.parse_event_lines(JL.read_event_logs(spark, [str(a)])).where("reason is null").orderBy("line_number").collect()
    assert [(r.line_number, r.message) for r in scan] == [(e[3], e[4]) for e in f.events() if e[1] == "a.jsonl"]
    a.write_text(_line(5))
    b.rename(tmp_path / "b.old")
    b.write_text(_line(6) + _line(7, message="x" * 500) + "[]\n")
    (tmp_path / "late.log").write_text(_line(8))
    f.step()
    assert [e[1:4] for e in f.events()[5:]] == [("a.jsonl", 1, 1), ("b.jsonl", 1, 1), ("b.jsonl", 1, 2), ("late.log", 0, 1)]
    assert [e[0] for e in f.events()] == list(range(9))
    assert f.rejects() == [("a.jsonl", 0, 2, "invalid JSON"), ("a.jsonl", 0, 7, "invalid JSON"), ("b.jsonl", 1, 3, "not a JSON object")]
    b.unlink()
    f.step()
    assert f.reports() == [(0, "a.jsonl", "opened"), (0, "a.jsonl", "invalid"), (0, "late.log", "error"), (1, "a.jsonl", "invalid"), (1, "b.jsonl", "opened"),
                           (2, "a.jsonl", "replaced"), (2, "b.jsonl", "replaced"), (2, "b.jsonl", "invalid"), (2, "late.log", "recovered")] + f.reports()[9:]
    f.step()
    assert len(f.events()) == 9


def test_budget_bounds_a_batch(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(_line(i) for i in range(20)))
    lines = FO.follow_event_logs(spark, [str(tmp_path)], max_bytes_per_file=3 * len(_line(0)))
    base = tempfile.mkdtemp(prefix="logspark-follow-")
    dirs = [os.path.join(base, n) for n in ("ev", "rej", "rep", "ck")]
    q = FO.stream_follow(lines, *dirs, processing_time="0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.parquet(dirs[0]).orderBy("event_id").collect()
    assert [(r.event_id, r.line_number, r.message) for r in rows] == [(i, i + 1, f"m{i}") for i in range(20)]
    assert max(r["count"] for r in spark.read.parquet(dirs[0]).groupBy("batch_id").count().collect()) <= 4


STEPS = [
    ([], "opened", 1, None, "", ("tailing", 0, 0, 0, None)),
    ([("invalid", 2, 7, "bad")], "valid", 5, None, "", ("tailing", 2, 0, 5, "line 7: bad")),
    ([("replaced", 1, None, "")], "invalid", 1, 3, "worse", ("rotated", 1, 1, 0, "line 3: worse")),
    ([("replaced", 1, None, ""), ("invalid", 1, 3, "x")], "recovered", 1, None, "", ("tailing", 1, 1, 0, FO.RECOVERED)),
    ([("replaced", 1, None, ""), ("valid", 9, None, "")], "error", 1, None, "missing", ("missing", 0, 0, 0, "missing")),
    ([("error", 1, None, "denied")], "valid", 2, None, "", ("error", 0, 0, 2, "denied")),
    ([("error", 1, None, "denied"), ("recovered", 1, None, "")], "replaced", 1, None, "", ("rotated", 0, 1, 0, FO.REPLACED)),
]


@pytest.mark.parametrize("before,kind,records,line,detail,want", STEPS)
def test_state_rules(before, kind, records, line, detail, want):
    state = None
    for step in [*before, (kind, records, line, detail)]:
        state = FO.next_state(state, *step)
    assert state == want


def test_declared_states_equal_the_state_machine_step_by_step(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(600):
        path, kind = f"f{rng.randrange(12)}", rng.choice(["opened", "recovered", "replaced", "error", "invalid", "invalid", "valid", "valid", "read"])
        if kind == "error" and rng.random() < 0.6:
            kind = "valid"
        detail = rng.choice(["missing", "denied"]) if kind == "error" else f"d{i}" if kind == "invalid" else ""
        rows.append((path, i // 50, i % 50, kind, rng.randrange(1, 4), i if kind == "invalid" else None, detail))
        if kind != "read":
            want[path] = FO.next_state(want.get(path), kind, *rows[-1][4:])
    reports = spark.createDataFrame(rows, "file_path string, batch_id long, seq int, kind string, records long, line_number long, detail string")
    got = {r.file_path: tuple(r[c] for c in FO.STATE_COLUMNS) for r in FO.source_states(reports, ["batch_id", "seq"]).collect()}
    assert got == want
    base = tempfile.mkdtemp(prefix="logspark-follow-")
    for batch in range(0, 12, 4):
        reports.where(f"batch_id >= {batch} and batch_id < {batch + 4}").coalesce(1).write.mode("append").parquet(os.path.join(base, "in"))
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "in"))
    with FO.rocksdb_state(spark):
        q = ST.run_aggregate_to_table(FO.stream_source_states(stream), os.path.join(base, "t"), os.path.join(base, "ck"))
    q.awaitTermination()
    assert q.exception() is None
    now = ST.current_rows(spark, os.path.join(base, "t"), ["file_path"]).collect()
    assert {r.file_path: tuple(r[c] for c in FO.STATE_COLUMNS) for r in now} == want
