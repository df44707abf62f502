"""Stand-in inputs: rows of the event contract built from the driver tables.

These adapters only give rows in the schema the operators expect; they do none of the
operators' work. Every query reads a driver table through one of them, so its work grows
with the table. The DuckDB oracle builds the same rows in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.schema import EVENT_COLUMNS
from logspark.session import scratch_path

BASE_EPOCH_SECONDS = 1704067200  # 2024-01-01T00:00:00Z, anchor for tables without time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Event times are stored as naive UTC wall-clock times, so the session
    must read and render them in UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone", "UTC")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00", "GMT"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone})")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over the cluster by all their columns: a narrow, well compressed table takes few
    splits, too few tasks for heavy work on each row. Adaptive execution joins small partitions."""
    return rows.repartition(*rows.columns)


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table for work that is heavy on each row."""
    return spread(table(spark, sf_dir, "events"))


def events_frame(events: DataFrame, keep=()) -> DataFrame:
    """``events`` table -> event frame (one event per row, ``event_id`` kept)."""
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    uid = F.col("user_id").cast("string")
    level = (F.when(et == "error", "error").when(et == "purchase", "warn")
             .when(et == "view", "debug").when(et == "click", "trace").otherwise("info"))
    subsystem = (F.when(et == "error", "backend.core_fault").when(et == "purchase", "billing.remote")
                 .when(et == "view", "ui_shell.local").when(et == "signup", "auth").otherwise("ui_shell"))
    event = F.when((et == "signup") & (k < 5), "logger.events_dropped").otherwise(F.concat(F.lit("user."), et))
    message = F.concat(F.lit("["), F.initcap(et), F.lit("][Local] value "),
                       F.format_string("%.2f", F.col("value")), F.lit(" for user "), uid)
    # keys written in sorted order (count, k, paid, stack, user)
    fields = F.concat(
        F.lit("{"),
        F.when((et == "signup") & (k < 5), F.concat(F.lit('"count": '), (k + 1).cast("string"), F.lit(", ")))
         .otherwise(F.lit("")),
        F.lit('"k": '), k.cast("string"), F.lit(', "paid": '),
        F.when(et == "purchase", "true").otherwise("false"),
        F.when(et == "error", F.concat(F.lit(', "stack": "at handler line '), k.cast("string"), F.lit('"')))
         .otherwise(F.lit("")),
        F.lit(', "user": "u'), uid, F.lit('"}'))
    return events.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.lit(1).alias("schema_version"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"),
        subsystem.alias("subsystem"),
        event.alias("event"),
        message.alias("message"),
        F.concat(uid, F.lit("-"), F.to_date("ts").cast("string")).alias("app_session_id"),
        F.when(et == "view", F.concat(F.lit("pb-"), uid)).alias("playback_session_id"),
        F.when(et == "purchase", F.concat(F.lit("req-"), k.cast("string"))).alias("request_id"),
        F.when(et == "signup", F.lit("")).alias("session_id"),
        F.when(et == "click", F.lit("ui")).alias("target"),
        F.when(et == "purchase", "remote").when(et == "view", "local").when(et == "error", "")
         .alias("provider"),
        F.when(et == "error", F.when(k < 50, "timeout").otherwise("refused")).alias("error_kind"),
        F.when(et != "signup", F.col("value")).alias("duration_ms"),
        F.when(et == "purchase", '"completed"').when(et == "error", '"failed"')
         .when(et == "view", "200").when(et == "click", '{"code": 1}').alias("status"),
        fields.alias("fields"),
        *[F.col(c) for c in keep],
    )


def documents_frame(documents: DataFrame) -> DataFrame:
    """``documents`` table -> event frame whose messages are the whole document texts."""
    return documents.select(
        F.col("doc_id").cast("bigint").alias("event_id"),
        F.lit(1).alias("schema_version"),
        F.timestamp_seconds(F.lit(BASE_EPOCH_SECONDS) + F.col("doc_id")).alias("timestamp"),
        F.lit("info").alias("level"),
        F.col("source").alias("source"),
        F.concat(F.lit("docs."), F.col("lang")).alias("subsystem"),
        F.concat(F.lit("document."), F.col("lang")).alias("event"),
        F.col("text").alias("message"),
        F.col("source").alias("app_session_id"),
        F.lit(None).cast("string").alias("playback_session_id"),
        F.lit(None).cast("string").alias("request_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("target"),
        F.lit(None).cast("string").alias("provider"),
        F.lit(None).cast("string").alias("error_kind"),
        F.col("n_chars").cast("double").alias("duration_ms"),
        F.lit(None).cast("string").alias("status"),
        F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('"}')).alias("fields"),
    )


def conversations_frame(conversations: DataFrame) -> DataFrame:
    """``conversations`` table -> event frame: one run per conversation, turns in order."""
    role = F.col("role")
    return conversations.select(
        (F.col("conv_id") * F.lit(1_000_000) + F.col("turn")).cast("bigint").alias("event_id"),
        F.lit(1).alias("schema_version"),
        F.timestamp_seconds(F.lit(BASE_EPOCH_SECONDS) + F.col("conv_id") * 60 + F.col("turn")).alias("timestamp"),
        F.when(role == "user", "info").when(role == "assistant", "debug").otherwise("warn").alias("level"),
        F.lit("chat").alias("source"),
        F.concat(F.lit("chat."), role).alias("subsystem"),
        F.concat(F.lit("turn."), role).alias("event"),
        F.col("text").alias("message"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("app_session_id"),
        F.lit(None).cast("string").alias("playback_session_id"),
        F.lit(None).cast("string").alias("request_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("target"),
        F.lit(None).cast("string").alias("provider"),
        F.lit(None).cast("string").alias("error_kind"),
        F.char_length("text").cast("double").alias("duration_ms"),
        F.lit(None).cast("string").alias("status"),
        F.lit("{}").alias("fields"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_frame(table(spark, sf_dir, "events")).select(*EVENT_COLUMNS)


def load_spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_frame(spread_events(spark, sf_dir)).select(*EVENT_COLUMNS)


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_frame(table(spark, sf_dir, "documents")).select(*EVENT_COLUMNS)


def load_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_frame(table(spark, sf_dir, "conversations")).select(*EVENT_COLUMNS)


# ------------------------------------------------------------------ JSONL stand-in lines
# Each events row becomes one JSONL record; the props value ``k`` plants one contract
# defect in a few records so the validator has invalid lines to find.
DEFECTS = {
    0: "not json",
    1: "missing level",
    2: "schema version 2",
    3: "boolean request id",
    4: "empty source",
    5: "negative duration",
    6: "trailing garbage",
}


def _jstr(col) -> F.Column:
    """JSON string literal of a column (quoted and escaped)."""
    quoted = F.to_json(F.array(col))
    escaped = quoted.substr(F.lit(2), F.length(quoted) - 2)
    # text without quote, backslash or control characters needs no escaping
    plain = F.concat(F.lit('"'), col, F.lit('"'))
    return F.when(col.isNotNull(), F.when(col.rlike(r'["\\\p{Cntrl}]'), escaped).otherwise(plain))


def event_lines(events: DataFrame, keep=()) -> DataFrame:
    """``events`` table -> (file_name, event_id, value) JSONL lines, some with defects."""
    fr = events_frame(events.withColumn("_k", F.get_json_object("props", "$.k").cast("bigint")), keep=("_k", *keep))
    k = F.col("_k")
    ts_ms = F.unix_millis("timestamp")
    ts_json = F.when((k >= 10) & (k < 30),
                     F.concat(F.lit('"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z"'))
                     ).otherwise(ts_ms.cast("string"))
    app = _jstr(F.col("app_session_id"))

    def opt(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f', "{name}": '), value)).otherwise(F.lit(""))

    level_part = F.when(k == 1, F.lit("")).otherwise(F.concat(F.lit(', "level": '), _jstr(F.col("level"))))
    version = F.when(k == 2, F.lit("2")).otherwise(F.lit("1"))
    source = F.when(k == 4, F.lit('""')).otherwise(_jstr(F.col("source")))
    request = F.when(k == 3, F.lit("true")).otherwise(_jstr(F.col("request_id")))
    duration = F.when(k == 5, F.lit("-1.5")).otherwise(F.col("duration_ms").cast("string"))
    body = F.concat(
        F.lit('{"schema_version": '), version, F.lit(', "timestamp": '), ts_json, level_part,
        F.lit(', "source": '), source, F.lit(', "subsystem": '), _jstr(F.col("subsystem")),
        opt("target", _jstr(F.col("target"))),
        F.lit(', "event": '), _jstr(F.col("event")), F.lit(', "message": '), _jstr(F.col("message")),
        F.lit(', "app_session_id": '), app,
        opt("playback_session_id", _jstr(F.col("playback_session_id"))),
        opt("request_id", request), opt("session_id", _jstr(F.col("session_id"))),
        opt("provider", _jstr(F.col("provider"))), opt("duration_ms", duration),
        opt("error_kind", _jstr(F.col("error_kind"))), opt("status", F.col("status")),
        F.lit(', "fields": '), F.col("fields"), F.lit(', "correlation_id": "x"}'))
    line = (F.when(k == 0, F.substring(body, 1, 40))
            .when(k == 6, F.concat(body, F.lit(" trailing")))
            .otherwise(body))
    return fr.select(F.concat(F.col("source"), F.lit(".jsonl")).alias("file_name"),
                     F.col("event_id"), line.alias("value"), *keep)


def _with_log_file(events: DataFrame) -> DataFrame:
    """The file that ``event_lines`` puts each row into."""
    return events.withColumn("log_file", F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string"), F.lit(".jsonl")))


def _write_pieces(events: DataFrame) -> tuple[str, dict[str, list[str]]]:
    """Lines of rows with a ``log_file``, in event order: many tasks write a piece of each file's lines. Gives their
    folder and the pieces of each ``source_file=<name>`` in it, in order. Table rows are sorted, which are narrower than lines."""
    spark, folder = events.sparkSession, scratch_path(events.sparkSession, "line-pieces")
    rest = [c for c in events.columns if c not in ("log_file", "event_id")]
    placed = events.repartitionByRange("log_file", "event_id").sortWithinPartitions("log_file", "event_id", *rest)
    event_lines(placed, keep=("log_file",)).select("value", F.col("log_file").alias("source_file")).write.partitionBy("source_file").text(folder)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda path: sorted(s.getPath().getName() for s in fs.listStatus(path))
    return folder, {d: [n for n in names(paths(f"{folder}/{d}")) if n.startswith("part-")] for d in names(paths(folder)) if d.startswith("source_file=")}


COPY_BYTES = 4 << 20


def _copy(sources: list[str], out, skip: int = 0) -> None:
    """The bytes of files, one after the other, without the first ``skip``."""
    from logspark.streaming.follow import _open

    for path in sources:
        store, inner = _open(path)
        with store.open_input_stream(inner) as f:
            while block := f.read(COPY_BYTES):
                out.write(block[skip:])
                skip = max(0, skip - len(block))


def write_log_files(events: DataFrame, folder: str) -> None:
    """Stand-in producers: one closed text file of JSONL lines per source, in event order, under
    ``source_file=<name>``. Many tasks write and sort its lines, one a file puts the pieces together."""
    from logspark.streaming.follow import _open

    pieces, found = _write_pieces(_with_log_file(events))

    def join(item) -> None:
        name, parts = item
        store, base = _open(f"{folder}/{name}")
        store.create_dir(base)
        with store.open_output_stream(f"{base}/part-00000.txt") as out:
            _copy([f"{pieces}/{name}/{p}" for p in parts], out)

    if found:
        events.sparkSession.sparkContext.parallelize(sorted(found.items()), len(found)).foreach(join)


def pins_from_labels(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Stand-in pin table: one pin per labelled document, the note from its labels.

    A pin stores the snapshot of the event it was taken from; for documents labelled toxic
    the snapshot was taken at level ``warn``, so no loaded event carries that content.
    """
    from logspark.operators.pins import take_pins

    docs = documents_frame(documents)
    snap = docs.join(labels.withColumnRenamed("doc_id", "event_id"), "event_id")
    snap = snap.withColumn("level", F.when(F.col("toxic") == 1, F.lit("warn")).otherwise(F.col("level")))
    return take_pins(snap, F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(" toxic="),
                                    F.col("toxic").cast("string")))


def numbered_event_lines(events: DataFrame) -> DataFrame:
    """Stand-in JSONL lines with their per-file physical line numbers (file order = event order)."""
    from logspark.sources.jsonl import with_row_numbers

    return with_row_numbers(event_lines(events), ["event_id"], name="line_number", within=["file_name"], start=1)


def console_frame(events: DataFrame) -> DataFrame:
    """Stand-in console events, one for each event: a click becomes a ``console.message`` whose
    arguments hold two Error-like objects (one repeated) and the message itself; a purchase has the
    same arguments under its own name, and every other event stays as it is."""
    fr = events_frame(events)
    click = F.col("event") == "user.click"
    msg = F.concat(F.lit("click by user "), F.split(F.col("app_session_id"), "-").getItem(0))
    err = F.concat(F.lit('{"name": "TypeError", "message": " value '), F.format_string("%.2f", F.col("duration_ms")),
                   F.lit(' "}'))
    fields = F.concat(F.lit('{"arguments": ['), err, F.lit(', {"message": "'), msg, F.lit('"}, '), err,
                      F.lit(', "plain text"]}'))
    return fr.withColumns({"event": F.when(click, "console.message").otherwise(F.col("event")),
                           "message": F.when(click, msg).otherwise(F.col("message")),
                           "fields": F.when(F.col("event").isin("user.click", "user.purchase"), fields).otherwise(F.col("fields"))}).select(*EVENT_COLUMNS)


def client_records(events: DataFrame) -> DataFrame:
    """Stand-in producer records (logger target, record name, property bag as JSON text)."""
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    props = F.concat(
        F.lit('{"duration_ms": "'), F.format_string("%.2f", F.col("value")), F.lit('", '),
        F.when(et == "purchase", F.concat(F.lit('"request_id": "req-'), k.cast("string"), F.lit('", ')))
         .otherwise(F.lit("")),
        F.when(et == "error", F.lit('"event": "user.failure", "error_kind": "io", ')).otherwise(F.lit("")),
        F.lit('"apiToken": "tok-'), k.cast("string"),
        F.lit('", "nested": {"cookie": "c'), F.col("user_id").cast("string"),
        F.lit('", "depth": {"secret": 1, "ok": true}}, "k": '), k.cast("string"),
        F.lit(', "message": "value '), F.format_string("%.2f", F.col("value")), F.lit('"}'))
    return events.select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(et == "error", " Critical ").when(et == "purchase", "WARNING").when(et == "view", "Information")
         .when(et == "click", "log").otherwise("Verbose").alias("raw_level"),
        F.concat(F.lit("app::"), et).alias("target"),
        F.concat(F.lit("record "), et).alias("name"),
        F.concat(F.lit("client-"), (F.col("user_id") % 2).cast("string")).alias("source"),
        F.concat(F.col("user_id").cast("string"), F.lit("-run")).alias("app_session_id"),
        props.alias("properties"))


# ------------------------------------------------------------------ growing files and their reports
#: The file that is truncated, and the one that is replaced, before phase 2 of ``grow_log_files``.
TRUNCATED, REPLACED = "src1.jsonl", "src2.jsonl"


def _phase() -> F.Column:
    """Phase (0 to 2) in which a line is written: the replaced file gets most of its lines in phase 2."""
    digit = F.col("event_id") % 10
    early, middle = (F.when(F.col("log_file") == REPLACED, F.lit(a)).otherwise(F.lit(b)) for a, b in ((2, 4), (3, 8)))
    return F.when(digit < early, 0).when(digit < middle, 1).otherwise(2)


def grow_log_files(events: DataFrame, folder: str, phase: int) -> None:
    """Stand-in producers: the lines of one phase, written by many tasks and put together by one a file. Phase 0
    ends with half of the first record of phase 1, which brings the rest; before phase 2 one file
    is truncated in place and another one is replaced."""
    from logspark.streaming.follow import _open

    rows = _with_log_file(events).withColumn("phase", _phase()).where("log_file is not null")
    pieces, found = _write_pieces(rows.where(F.col("phase") == phase).drop("phase"))
    firsts = {}
    if phase < 2:  # one row a file: the first of phase 1, in the order of the pieces
        order = ["event_id", *(c for c in events.columns if c != "event_id")]
        first = rows.where("phase = 1").groupBy("log_file").agg(F.min(F.struct(*order)).alias("r")).select("log_file", "r.*")
        firsts = {r["log_file"]: ((r["value"] or "") + "\n").encode() for r in event_lines(first, keep=("log_file",)).collect()}

    def write(item) -> None:
        name, parts, first = item
        half = len(first) // 2
        store, base = _open(folder)
        store.create_dir(base)
        path, replace = f"{base}/{name}", phase == 2 and name == REPLACED
        aside = f"{base}/new-{name}.part" if replace else path
        fresh = replace or phase == 0 or (phase == 2 and name == TRUNCATED)
        with (store.open_output_stream(aside) if fresh else store.open_append_stream(aside)) as out:
            _copy([f"{pieces}/source_file={name}/{p}" for p in parts], out, half if phase == 1 else 0)
            if phase == 0:
                out.write(first[:half])
        if replace:
            store.move(aside, path)

    names = sorted({d.partition("=")[2] for d in found} | (set(firsts) if phase == 0 else set()))
    if names:
        items = [(n, found.get(f"source_file={n}", []), firsts.get(n, b"")) for n in names]
        events.sparkSession.sparkContext.parallelize(items, len(items)).foreach(write)


def source_reports(events: DataFrame) -> DataFrame:
    """Stand-in reports of a reader on three files, one for each event: errors, recoveries, replacements, counts."""
    et, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    kind = (F.when((et == "error") & (k < 30), "error").when((et == "signup") & (k < 30), "recovered")
            .when((et == "purchase") & (k < 30), "replaced").when(et == "click", "invalid").when(et == "view", "valid").otherwise("read"))
    detail = F.when((et == "error") & (k < 10), "missing").when(et == "error", F.concat(F.lit("refused "), k.cast("string"))).when(
        et == "click", F.concat(F.lit("reason "), (k % 7).cast("string"))).otherwise("")
    records = F.when(et == "click", k % 3 + 1).when(et == "view", k).otherwise(F.lit(1)).cast("long")
    return events.select(F.floor(F.col("event_id") / 100).cast("long").alias("batch_id"), (F.col("event_id") % 100).cast("int").alias("seq"),
                         F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string"), F.lit(".jsonl")).alias("file_path"), kind.alias("kind"),
                         records.alias("records"), F.when(et == "click", F.col("event_id")).cast("long").alias("line_number"), detail.alias("detail"))


def number_lines(events: DataFrame) -> DataFrame:
    """Stand-in JSONL lines whose identifiers, status and fields are numbers in many spellings, and whose
    undeclared keys repeat; where ``k`` is 7 a declared key repeats as well."""
    k = F.get_json_object("props", "$.k").cast("bigint").cast("string")
    turn = F.col("event_id") % 4
    number = (F.when(turn == 0, F.concat(k, F.lit(".0"))).when(turn == 1, F.concat(k, F.lit("e2"))).when(
        turn == 2, F.concat(F.lit("1234567890123456789"), k)).otherwise(F.concat(k, F.lit(".50"))))
    again = F.when(k == "7", F.lit(', "event": "again"')).otherwise(F.lit(""))
    line = F.concat(F.lit('{"extra": 1, "schema_version": 1, "timestamp": '), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
                    F.lit(', "level": "info", "source": "numbers", "subsystem": "s", "event": "e", "message": "m", "app_session_id": '), number,
                    F.lit(', "request_id": "'), number, F.lit('", "status": '), number, F.lit(', "fields": {"z": '), number,
                    F.lit(', "n": [1, 2], "a": "'), number, F.lit('"}, "extra": 2'), again, F.lit("}"))
    return events.select(F.lit("numbers.jsonl").alias("file_name"), F.col("event_id").alias("line_number"), line.alias("value"))


def tone_frame(events: DataFrame) -> DataFrame:
    """Stand-in messages that hold two outcome phrases each, in turn all of them: plain, in capitals, with
    other separators, and inside longer words (which are no hits)."""
    from logspark.functions.tones import PHRASES

    phrases, n, i = F.array(*(F.lit(p) for p, _ in PHRASES)), len(PHRASES), F.col("event_id")
    first, second = F.element_at(phrases, (i % n + 1).cast("int")), F.element_at(phrases, ((i * 7 + 3) % n + 1).cast("int"))
    shown = F.when(i % 5 == 0, F.upper(first)).when(i % 5 == 1, F.translate(first, " ", "_")).when(
        i % 5 == 2, F.concat(F.lit("x"), first)).otherwise(first)
    message = F.concat(F.lit("step "), i.cast("string"), F.lit(" "), shown, F.lit(": "), F.regexp_replace(second, " ", " - "), F.lit("!"))
    return events_frame(events).withColumn("message", message).select(*EVENT_COLUMNS)
