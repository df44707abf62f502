"""S6 + T8: following log files that grow, are truncated or are replaced.

``follow_event_logs`` is a streaming source whose offset is, for every followed file, the byte
behind its last complete record and what identifies the file. A micro-batch holds the records
between two such offsets, cut into splits that tasks read side by side; a half record at a
file's end waits for its line end. A file that got shorter, or whose identity changed, starts
again at its first byte. What happened to a file (opened, replaced, error, recovered) comes as
rows of their own beside the records.

``stream_follow`` validates the records batch by batch and writes events, rejects and reports;
``source_states`` turns reports into the state of each source, and ``stream_source_states``
keeps that state in a streaming state store.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from logspark.schema import EVENT_SCHEMA
from logspark.sources import jsonl as JL

SPLIT_BYTES, HEAD_BYTES, BLOCK_BYTES, BATCH_BYTES = 32 << 20, 4096, 1 << 16, 1 << 20
_SCHEMA = "kind string, file_path string, file_name string, split_start long, record_offset long, value string"
_ARROW = pa.schema([("kind", pa.string()), ("file_path", pa.string()), ("file_name", pa.string()), ("split_start", pa.int64()),
                    ("record_offset", pa.int64()), ("value", pa.string())])


# ------------------------------------------------------------------ files
def _local(path: str) -> str | None:
    """The plain path of a local file or folder; None for any other store."""
    inner = path.removeprefix("file:")
    return "/" + inner.lstrip("/") if inner != path else None if "://" in path else path


def _open(path: str):
    """File system and path of a plain path or URI; both the driver and the executors must reach it."""
    from pyarrow import fs

    inner = _local(path)
    return (fs.LocalFileSystem(), inner) if inner is not None else fs.FileSystem.from_uri(path)


def _children(path: str) -> list[str]:
    """A folder's direct JSONL files; any other path is itself, whether it exists or not."""
    from pyarrow import fs

    store, inner = _open(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    base = path.rstrip("/")
    names = (i.base_name for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File)
    return [f"{base}/{n}" for n in names if JL.is_jsonl_path(n)]


def last_line_end(file, end: int, floor: int = 0) -> int:
    """The place behind the last line end in [floor, end), read from the back; ``floor`` if there is none."""
    while end > floor:
        start = max(floor, end - BLOCK_BYTES)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return floor


def next_line_end(file, start: int, size: int) -> int:
    """The place behind the first line end at or after ``start``; ``size`` if there is none."""
    while start < size:
        file.seek(start)
        block = file.read(min(BLOCK_BYTES, size - start))
        if not block:
            break
        if (at := block.find(b"\n")) >= 0:
            return start + at + 1
        start += len(block)
    return size


def _identity(path: str, file) -> str:
    """What tells a file from another of the same name: where it lies (local files) and its first record."""
    file.seek(0)
    head = file.read(HEAD_BYTES).split(b"\n", 1)[0]
    place = ""
    if (inner := _local(path)) is not None:
        found = os.stat(inner)
        place = f"{found.st_dev}:{found.st_ino}:"
    return place + hashlib.sha1(head).hexdigest()[:16]


def inspect(path: str, budget: int | None = None, done: dict | None = None) -> dict:
    """Where a file stands: ``end`` behind its last complete record and ``id`` (empty without a record), or ``error``.

    With a budget, a file that goes on from ``done`` is read up to the record in which the budget ends.
    """
    from pyarrow import fs

    try:
        store, inner = _open(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            return {"error": "missing"}
        if info.type != fs.FileType.File:
            return {"error": "not a regular file"}
        with store.open_input_file(inner) as file:
            end = last_line_end(file, info.size)
            if not end:
                return {"end": 0, "id": ""}
            now = {"end": end, "id": _identity(path, file)}
            start = 0 if done is None or restarted(done, now) else done.get("end", 0)
            if budget and end - start > budget:
                now["end"] = min(end, next_line_end(file, start + budget - 1, end))
            return now
    except OSError as e:
        return {"error": f"{type(e).__name__}: {e.strerror or e}"}


def restarted(before: dict, now: dict) -> bool:
    """Whether a file followed up to ``before`` is another one now, or lost records that were read."""
    return bool(before.get("end")) and (now["end"] < before["end"] or now["id"] != before["id"])


# ------------------------------------------------------------------ data source
class _Reports(InputPartition):
    def __init__(self, rows: list[tuple[str, str, str]]):
        self.rows = rows


class _Split:
    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class _Splits(InputPartition):
    """Splits that one task reads, one after the other."""

    def __init__(self, splits: list[_Split]):
        self.splits = splits


#: Splits become as many tasks up to this number, then tasks of ``SPLIT_BYTES`` if those are more.
TASKS = 256


def _dealt(splits: list[_Split]) -> list[_Splits]:
    tasks = min(len(splits), max(TASKS, sum(s.end - s.start for s in splits) // SPLIT_BYTES))
    each = -(-len(splits) // max(tasks, 1)) or 1
    return [_Splits(splits[i:i + each]) for i in range(0, len(splits), each)]


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def split_records(file, first: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); ``first`` is where the range of splits begins."""
    at = start
    if start > first:
        file.seek(start - 1)
        if file.read(1) != b"\n":
            at = next_line_end(file, start, file.size())
    rest, here = b"", at
    file.seek(at)
    while here < end or rest:
        block = file.read(BLOCK_BYTES)
        if not block:
            return
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        for line in lines:
            if here >= end:
                return
            yield here, line
            here += len(line) + 1
        if here >= end:
            return


def _text(line: bytes) -> str:
    """The record's text; one that isn't UTF-8 gets a mark in front, so that it can't pass for JSON."""
    try:
        return line.decode()
    except UnicodeDecodeError:
        return "�" + line.decode(errors="replace")


class FollowReader(DataSourceStreamReader):
    def __init__(self, paths: list[str], split_bytes: int, budget: int | None):
        self.paths, self.split_bytes, self.budget = paths, split_bytes, budget
        self.known: dict[str, dict] = {}  # files and how far they have been read

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = sorted({f for p in self.paths for f in _children(p)} | set(self.known))
        return {f: inspect(f, self.budget, self.known.get(f, {})) for f in files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        reports, splits = [], []
        for path, now in sorted(end.items()):
            before = start.get(path)
            last = before or {}
            if "error" in now:
                if last.get("error") != now["error"]:
                    reports.append(("error", path, now["error"]))
                continue
            if before is None:
                reports.append(("opened", path, ""))
            if replaced := "error" not in last and restarted(last, now):
                reports.append(("replaced", path, ""))
            if "error" in last:
                reports.append(("recovered", path, ""))
            first = 0 if replaced else last.get("end", 0)
            splits += [_Split(path, first, at, min(at + self.split_bytes, now["end"])) for at in range(first, now["end"], self.split_bytes)]
        self.known = {**start, **end}
        return ([_Reports(reports)] if reports else []) + _dealt(splits)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, _Reports):
            yield pa.RecordBatch.from_pylist([dict(kind=k, file_path=p, file_name=_name(p), value=d) for k, p, d in partition.rows], _ARROW)
            return
        for split in partition.splits:
            yield from self._read(split)

    def _read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        store, inner = _open(split.path)
        held, room = [], BATCH_BYTES
        with store.open_input_file(inner) as file:
            for at, line in split_records(file, split.first, split.start, split.end):
                held.append((at, _text(line)))
                room -= len(line) + 64
                if room < 0:
                    yield self._batch(split, held)
                    held, room = [], BATCH_BYTES
        if held:
            yield self._batch(split, held)

    @staticmethod
    def _batch(split: _Split, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        columns = (["line"] * n, [split.path] * n, [_name(split.path)] * n, [split.start] * n, [r[0] for r in rows], [r[1] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def commit(self, end: dict) -> None:
        self.known = {**self.known, **end}


class FollowSource(DataSource):
    """Options: paths (a JSON list), splitBytes, maxBytesPerFile."""

    @classmethod
    def name(cls) -> str:
        return "event_log_follow"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> FollowReader:
        budget = self.options.get("maxBytesPerFile")
        return FollowReader(json.loads(self.options["paths"]), int(self.options.get("splitBytes", SPLIT_BYTES)), int(budget) if budget else None)


def follow_event_logs(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES, max_bytes_per_file: int | None = None) -> DataFrame:
    """A stream of the complete records of files that may still grow, and of reports on the files.

    ``paths`` are files (followed whether they exist yet or not) or folders, whose direct JSONL
    files are looked up anew for every batch. ``kind`` is ``line`` for records; else a report:
    opened, replaced, error (``value`` says which; ``missing``), recovered. Blank lines come too,
    as they count as lines. A budget bounds what a batch reads of a file; the first batch
    after a restart of the query has none, as offsets of the last run aren't known before it.
    """
    spark.dataSource.register(FollowSource)
    reader = spark.readStream.format("event_log_follow").option("paths", json.dumps(paths)).option("splitBytes", split_bytes)
    return (reader.option("maxBytesPerFile", max_bytes_per_file) if max_bytes_per_file else reader).load()


# ------------------------------------------------------------------ validation
def _written(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _positions(spark: SparkSession, reports_dir: str, batch_id: int) -> DataFrame | None:
    """(file_path, generation, lines) up to which the batches before this one have read each file."""
    if batch_id == 0 or not _written(spark, reports_dir):
        return None
    read = spark.read.parquet(reports_dir).where((F.col("batch_id") < batch_id) & (F.col("kind") == "read"))
    newest = F.max(F.struct("generation", "line_number"))
    return read.groupBy("file_path").agg(newest.alias("p")).select("file_path", "p.generation", F.col("p.line_number").alias("lines"))


def _numbered(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Records with generation (0, one more whenever the file was replaced) and line_number in it."""
    lines, reports = batch.where("kind = 'line'"), batch.where("kind <> 'line'")
    replaced = reports.where("kind = 'replaced'").select("file_path", F.lit(1).alias("again"))
    sizes = lines.groupBy("file_path", "split_start").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("file_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(replaced, "file_path", "left")
    if before is not None:
        starts = starts.join(before, "file_path", "left")
    else:
        starts = starts.withColumns({"generation": F.lit(None).cast("long"), "lines": F.lit(None).cast("long")})
    again = F.coalesce("again", F.lit(0))
    starts = starts.select("file_path", "split_start", (F.coalesce("generation", F.lit(0)) + again).cast("long").alias("generation"),
                           (F.col("ahead") + F.when(again == 1, F.lit(0)).otherwise(F.coalesce("lines", F.lit(0)))).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("file_path", "split_start").orderBy("record_offset"))
    return (lines.withColumn("inside", inside).join(starts, ["file_path", "split_start"])
                 .withColumn("line_number", (F.col("ahead") + F.col("inside")).cast("long"))
                 .select("file_path", "file_name", "generation", "line_number", "record_offset", "value"))


REPORT = ["file_path", "file_name", "seq", "kind", "generation", "line_number", "records", "detail"]


def _reports(batch: DataFrame, parsed: DataFrame, numbered: DataFrame) -> DataFrame:
    """What a batch says of its files, a few rows a file; ``seq`` orders those of a batch."""
    order = F.create_map(*(F.lit(x) for pair in (("error", 1), ("replaced", 2), ("opened", 3), ("recovered", 6)) for x in pair))
    none = F.lit(None).cast("long")
    states = batch.where("kind <> 'line'").select("file_path", "file_name", order[F.col("kind")].alias("seq"), "kind", none.alias("generation"),
                                                  none.alias("line_number"), F.lit(1).cast("long").alias("records"), F.col("value").alias("detail"))
    per_file = parsed.groupBy("file_path", "file_name")
    bad = F.col("reason").isNotNull()
    invalid = per_file.agg(F.max("generation").alias("generation"), F.count_if(bad).alias("records"), F.max(F.when(bad, F.col("line_number"))).alias("line_number"),
                           F.max_by("reason", F.when(bad, F.col("line_number"))).alias("detail")).where("records > 0")
    valid = per_file.agg(F.max("generation").alias("generation"), F.count_if(~bad).alias("records")).where("records > 0")
    read = numbered.groupBy("file_path", "file_name").agg(F.max("generation").alias("generation"), F.max("line_number").alias("line_number"), F.count(F.lit(1)).alias("records"))
    out = states
    for seq, kind, rows in ((4, "valid", valid), (5, "invalid", invalid), (7, "read", read)):
        if "line_number" not in rows.columns:
            rows = rows.withColumn("line_number", none)
        if "detail" not in rows.columns:
            rows = rows.withColumn("detail", F.lit(""))
        out = out.unionByName(rows.withColumns({"seq": F.lit(seq), "kind": F.lit(kind)}).select(*REPORT))
    return out


def stream_follow(lines: DataFrame, events_dir: str, rejects_dir: str, reports_dir: str, checkpoint_dir: str, processing_time: str | None = None):
    """T1 + T8 over ``follow_event_logs``: events, rejects and reports, each under ``batch_id=<id>``.

    Line numbers count a file's physical lines and go on from batch to batch; a replaced file
    counts anew under the next ``generation``. Event ids go on as well. Without
    ``processing_time`` the query takes what is there now and ends.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, f"batch_id={batch_id}"
        batch = batch.persist()
        numbered = _numbered(batch, _positions(spark, reports_dir, batch_id)).persist()
        parsed = JL.parse_event_lines(numbered.where(F.col("value").rlike(r"\S"))).persist()
        try:
            start = 0
            if batch_id and _written(spark, reports_dir):
                earlier = spark.read.parquet(reports_dir).where((F.col("batch_id") < batch_id) & (F.col("kind") == "valid"))
                start = earlier.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
            JL.with_row_numbers(parsed.where("reason is null"), ["file_path", "generation", "line_number"], start=start).select(
                *EVENT_SCHEMA.names, "file_path", "file_name", "generation", "line_number").write.mode("overwrite").parquet(os.path.join(events_dir, part))
            parsed.where("reason is not null").select("file_path", "file_name", "generation", "line_number", "reason").write.mode(
                "overwrite").parquet(os.path.join(rejects_dir, part))
            _reports(batch, parsed, numbered).coalesce(1).write.mode("overwrite").parquet(os.path.join(reports_dir, part))
        finally:
            for df in (parsed, numbered, batch):
                df.unpersist()

    writer = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()


# ------------------------------------------------------------------ source states
RECOVERED, REPLACED = "readable again", "a new or shorter file, read from its start"
_STATE = "state string, parse_errors long, rotations long, records long, detail string"
STATE_COLUMNS = ["state", "parse_errors", "rotations", "records", "detail"]
#: Kinds that move the state; ``read`` only keeps line numbers.
KINDS = ("opened", "recovered", "replaced", "error", "invalid", "valid")


def next_state(state: tuple | None, kind: str, records: int, line_number: int | None, detail: str | None) -> tuple:
    """The state of a source after one more report.

    A source tails from its first report on; a replacement shows as ``rotated`` until the source
    fails or recovers; an error forgets what was counted before.
    """
    if kind == "error":
        return ("missing" if detail == "missing" else "error", 0, 0, 0, detail)
    now, errors, rotations, valid, said = state or ("tailing", 0, 0, 0, None)
    if kind == "recovered":
        return "tailing", errors, rotations, valid, RECOVERED
    if kind == "replaced":
        return "rotated", errors, rotations + records, valid, REPLACED
    if kind == "invalid":
        return now, errors + records, rotations, valid, f"line {line_number}: {detail}"
    return now, errors, rotations, valid + (records if kind == "valid" else 0), said


def source_states(reports: DataFrame, order_cols: list[str], key: str = "file_path") -> DataFrame:
    """The state of every source after all its reports, by declarative rules: what came after its
    last error counts, and the newest report of a kind that sets state or detail gives them."""
    at, kind = F.struct(*order_cols), F.col("kind")
    rows = reports.where(kind.isin(*KINDS)).withColumn("_at", at)
    failed = rows.where("kind = 'error'").groupBy(key).agg(F.max("_at").alias("_failed"))
    since = rows.join(failed, key, "left").where(F.col("_failed").isNull() | (F.col("_at") >= F.col("_failed")))

    def newest(value, *kinds):
        return F.max_by(value, F.when(kind.isin(*kinds), F.col("_at")))

    def total(name):
        return F.coalesce(F.sum(F.when(kind == name, F.col("records"))), F.lit(0))

    state = (F.when(kind == "error", F.when(F.col("detail") == "missing", "missing").otherwise("error"))
             .when(kind == "replaced", "rotated").otherwise("tailing"))
    detail = (F.when(kind == "error", F.col("detail")).when(kind == "replaced", F.lit(REPLACED)).when(kind == "recovered", F.lit(RECOVERED))
              .when(kind == "invalid", F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": "), F.col("detail"))))
    return since.groupBy(key).agg(
        F.coalesce(newest(state, "error", "replaced", "recovered"), F.lit("tailing")).alias("state"), total("invalid").alias("parse_errors"),
        total("replaced").alias("rotations"), total("valid").alias("records"), newest(detail, "error", "replaced", "recovered", "invalid").alias("detail"))


#: Reports of a source that a task holds at once, sorted runs of them that it merges at once, and rows read of a run at a time.
HELD_REPORTS, HELD_RUNS, RUN_ROWS = 50_000, 64, 256


def _run(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows written to a temporary file now, and read back when they are asked for."""
    file, rows = tempfile.TemporaryFile(), iter(rows)
    while block := list(islice(rows, RUN_ROWS)):
        pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)

    def read() -> Iterator[tuple]:
        with file:
            while True:
                try:
                    block = pickle.load(file)
                except EOFError:
                    return
                yield from block

    return read()


def in_order(reports: Iterable[tuple], held: int | None = None) -> Iterator[tuple]:
    """Reports (batch_id, seq, kind, ...) in their order, without those before an error of the same run, which
    the error forgets anyway. What doesn't fit is sorted in runs on local disk and merged."""
    order, room, runs, here = itemgetter(0, 1), held or HELD_REPORTS, [], []

    def since_error() -> list[tuple]:
        here.sort(key=order)
        last = max((i for i, r in enumerate(here) if r[2] == "error"), default=0)
        return here[last:]

    for report in reports:
        here.append(report)
        if len(here) >= room:
            here = since_error()
            if 2 * len(here) > room:
                runs.append(_run(here))
                here = []
                if len(runs) >= HELD_RUNS:
                    runs = [_run(heapq.merge(*runs, key=order))]
    return heapq.merge(*runs, since_error(), key=order)


class SourceStateProcessor(StatefulProcessor):
    """One row of state a source; the reports of a micro-batch are applied in their order."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("source", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.state.get() if self.state.exists() else None
        reports = ((r["batch_id"], r["seq"], r["kind"], r["records"], r["line_number"], r["detail"]) for r in rows)
        for _, _, *report in in_order(reports):
            state = next_state(state and tuple(state), *report)
        self.state.update(state)
        yield Row(file_path=key[0], **dict(zip(STATE_COLUMNS, state)))

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as ``transformWithState`` needs; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_source_states(reports: DataFrame) -> DataFrame:
    """The states kept by a stream of reports (batch_id, seq, file_path, kind, records, line_number,
    detail), in update mode: each batch gives the sources it changed. State is one row a source.
    Start the query inside ``rocksdb_state``."""
    rows = reports.where(F.col("kind").isin(*KINDS)).select("file_path", "batch_id", "seq", "kind", "records", "line_number", "detail")
    return rows.groupBy("file_path").transformWithState(SourceStateProcessor(), f"file_path string, {_STATE}", "Update", "None")
