"""JSONL event logs: scan (S1), strict validation (S2), rejects (S3), ingest report (S4),
source health (S5), ingestion ids (O2) and source merging (U1).

Line numbers and ingestion ids are computed without sorting a whole file (or the whole
input) in one task: rows are numbered inside splits of a file or buckets of their order
keys, the counts of those form a small table whose running sums are the offsets, and a join
adds the offset back. A file holding a third of all lines is therefore numbered by many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators import scans as SC
from logspark.schema import EVENT_COLUMNS, LEVELS
from logspark.session import stored

_JSONL_NAME = re.compile(r"\.jsonl$|\.jsonl\.", re.IGNORECASE)


def is_jsonl_path(name: str) -> bool:
    """Names ending ``.jsonl`` or containing ``.jsonl.`` (rotated archives), any case."""
    return bool(_JSONL_NAME.search(name))


def list_log_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Resolve paths to files: a directory contributes its direct JSONL children (not
    recursive); an explicit file is taken whatever its name. Repeated paths count once.

    This is file-system metadata only (the same listing Spark's file index performs)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out: list[str] = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        status = fs.getFileStatus(path)
        if status.isDirectory():
            for child in fs.listStatus(path):
                if child.isFile() and is_jsonl_path(child.getPath().getName()):
                    out.append(child.getPath().toString())
        else:
            out.append(fs.makeQualified(path).toString())
    return sorted(set(out))


def read_event_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S1 + U1: (file_path, file_name, line_number, value) of every non-blank line.

    Line numbers count physical lines (whitespace-only lines are skipped but counted)."""
    files = list_log_files(spark, paths)
    if not files:
        return spark.createDataFrame([], "file_path string, file_name string, line_number long, value string")
    raw = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_blk"))
    return number_physical_lines(raw)


def number_physical_lines(raw: DataFrame) -> DataFrame:
    """Physical line numbers from (value, file_path, file_name, _blk = split start):
    per-split counts, running sums per file, position inside the split. The offsets (a row a split
    of the scan) go to every task, so that the lines stay in the split that read them."""
    raw = raw.withColumn("_mid", F.monotonically_increasing_id())
    blocks = raw.groupBy("file_path", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy("file_path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    lines = raw.join(F.broadcast(offsets), ["file_path", "_blk"])
    return (lines.withColumn("line_number", F.col("_off") + F.col("_mid") - F.col("_m0") + 1)
                 .where(F.col("value").rlike(r"\S"))
                 .select("file_path", "file_name", "line_number", "value"))


ROWS_PER_BUCKET = 65_536


def _order_bucket(df: DataFrame, order_cols: list[str]) -> list[Column]:
    """Coarse values of the leading order columns, in the same order as the rows: text as it
    is, then the first number by blocks or the first time by hours (null stays null)."""
    kinds, out = dict(df.dtypes), []
    for name in order_cols:
        if kinds[name] in ("tinyint", "smallint", "int", "bigint"):
            return [*out, F.floor(F.col(name).cast("long") / ROWS_PER_BUCKET)]
        if kinds[name].startswith("timestamp"):
            return [*out, F.date_trunc("hour", name)]
        out.append(F.col(name))
    return out


def with_row_numbers(df: DataFrame, order_cols: list[str], name: str = "event_id",
                     within: list[str] | None = None, start: int = 0) -> DataFrame:
    """O2: dense numbers in ``order_cols`` order (restarting per ``within`` group).

    Rows are dealt into buckets by the data alone (blocks of ids or lines, hours), so a
    bucket means the same in every branch of the plan, at any partitioning and in any rerun.
    The counts of the buckets form a table whose running sums (``scans.running_sums``, in ranges)
    are the offsets; inside a bucket a window numbers the rows. The input is planned twice: once
    for the counts, from the order columns alone, and once for the rows. Rows that tie in the
    order keys are numbered in any order.
    """
    within = list(within or [])
    marks = [f"_b{i}" for i in range(len(_order_bucket(df, order_cols)))]
    rows = df.withColumns(dict(zip(marks, _order_bucket(df, order_cols))))
    keys = [*within, *marks]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = SC.running_sums(sizes, within, marks, "_n", "_off").select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_off")
    inside = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = inside.join(offsets, same).withColumn(name, F.col("_off") + F.col("_pos") - 1 + F.lit(start))
    return out.drop("_off", "_pos", *marks, *(f"_k{i}" for i in range(len(keys))))


#: Milliseconds of the first and last instant that the contract's time type holds (fixed values).
FIRST_MILLIS, LAST_MILLIS = -8334601228800000, 8210266876799999


def _instant(millis: Column) -> Column:
    """UTC instant of epoch milliseconds; null outside the contract's range."""
    return F.timestamp_millis(F.when(millis.between(FIRST_MILLIS, LAST_MILLIS), millis))


# ------------------------------------------------------------------ S2 validation
_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
_INTEGER = r"^-?[0-9]+$"
_NUMBER_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")
_TEXT_ONLY = ("target", "provider", "error_kind")
_REQUIRED_TEXT = ("source", "subsystem", "event")
_OPTIONAL_IDS = ("playback_session_id", "request_id", "session_id")
#: Fields that a record may hold once only; any other may repeat, the last one counts.
DECLARED = ("schema_version", "timestamp", "level", "source", "subsystem", "target", "event", "message", "app_session_id",
            *_OPTIONAL_IDS, "provider", "duration_ms", "error_kind", "status", "fields")


_RAW = ", ".join(f"{name} string" for name in DECLARED)


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """Add ``reason`` (NULL when the line is a valid event v1) and typed columns.

    A line is parsed once for the kinds of its values (``[line]`` as VARIANT must hold exactly
    one object, which rejects trailing garbage), once for their texts (VARIANT would print
    ``1.0`` as ``1``) and once for its keys (a declared field may not repeat). Every
    contract rule is a comparison of those; the first broken rule (declared field order)
    names the reason. The result is one struct behind a generator, which no predicate on
    ``reason`` crosses, so that a filter never repeats the parsing.

    ``status`` / ``fields`` are compact JSON; see ``columns.compact_json`` for their numbers.
    """
    keep = list(lines.columns)
    with C.repeated_keys_allowed(lines.sparkSession):
        df = lines.withColumn("_arr", F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))))
    df = df.withColumns({"_obj": F.expr("variant_get(_arr, '$[0]', 'variant')"), "_raw": F.from_json("value", _RAW), "_keys": F.json_object_keys("value"),
                         "_one": F.expr("_arr is not null and variant_get(_arr, '$[1]', 'variant') is null")})
    df = df.withColumns({f"_v_{name}": F.variant_get("_obj", f"$.{name}", "variant") for name in DECLARED})
    df = df.withColumns({f"_t_{name}": F.schema_of_variant(f"_v_{name}") for name in DECLARED if name not in ("fields", "status")} | {
        "_fields": F.to_json("_v_fields"), "_status": F.to_json("_v_status"),
        "_again": F.when(F.size(F.array_distinct("_keys")) < F.size("_keys"), F.filter(
            F.array(*map(F.lit, DECLARED)), lambda d: F.size(F.filter("_keys", lambda k: k == d)) > 1))})

    def text(name):
        return F.col("_raw")[name]

    def is_a(name, *kinds):
        """Whether the field is there and its value is a string, a number or null."""
        t, hit = F.col(f"_t_{name}"), F.lit(False)
        for k in kinds:
            hit = hit | {"string": t == "STRING", "null": t == "VOID"}.get(k, t.isin(*_NUMBER_TYPES) | t.startswith("DECIMAL"))
        return F.coalesce(hit, F.lit(False))

    def gone(name):
        return F.col(f"_v_{name}").isNull()

    def optional(name, *kinds):
        return gone(name) | is_a(name, "null", *kinds)

    whole = is_a("timestamp", "number") & text("timestamp").rlike(_INTEGER)
    instant = F.when(whole, _instant(text("timestamp").try_cast("long"))).when(
        is_a("timestamp", "string") & text("timestamp").rlike(_RFC3339), F.try_to_timestamp(
            F.regexp_replace(F.regexp_replace(text("timestamp"), "[Tt ]", "T"), "[zZ]$", "+00:00")))
    df = df.withColumns({"_ts": instant, "_dur": F.when(is_a("duration_ms", "number"), text("duration_ms").try_cast("double"))})
    missing = lambda name: (gone(name), f"missing field {name}")
    rules = [
        (~(F.col("_one") & F.col("_obj").isNotNull()), "invalid JSON"),
        (F.col("_keys").isNull(), "not a JSON object"),
        (F.coalesce(F.size("_again") > 0, F.lit(False)), F.concat(F.lit("repeated field "), F.array_join("_again", ", "))),
        missing("schema_version"),
        (~(is_a("schema_version", "number") & (text("schema_version") == "1")), "unsupported schema_version"),
        missing("timestamp"),
        (F.col("_ts").isNull(), "timestamp: neither epoch milliseconds nor RFC 3339"),
        missing("level"),
        (~(is_a("level", "string") & text("level").isin(*LEVELS)), "level: unknown level"),
    ]
    for name in ("source", "subsystem"):
        rules += [missing(name), (~(is_a(name, "string") & (text(name) != "")), f"{name}: must be text and not empty")]
    rules += [(~optional("target", "string"), "target: expected a string"), missing("event"),
              (~(is_a("event", "string") & (text("event") != "")), "event: must be text and not empty"),
              missing("message"), (~is_a("message", "string"), "message: expected a string"), missing("app_session_id"),
              (~(is_a("app_session_id", "string", "number") & (text("app_session_id") != "")), "app_session_id: must be a number or text and not empty")]
    rules += [(~optional(name, "string", "number"), f"{name}: must be text, a number or null") for name in _OPTIONAL_IDS]
    rules += [(~optional("provider", "string"), "provider: expected a string"),
              (~(optional("duration_ms") | F.coalesce((F.col("_dur") >= 0) & (F.col("_dur") < F.lit(float("inf"))), F.lit(False))),
               "duration_ms: must be a number from zero up"),
              (~optional("error_kind", "string"), "error_kind: expected a string"),
              (~(gone("fields") | F.col("_fields").startswith("{")), "fields: expected an object")]
    # one flat CASE (first broken rule wins); nesting would defeat code generation
    reason = None
    for cond, why in rules:
        why = F.lit(why) if isinstance(why, str) else why
        reason = F.when(cond, why) if reason is None else reason.when(cond, why)

    def json(name):
        own = F.col(f"_{name}")  # a string that looks like a number would be one without quotes
        return F.when(text(name).rlike(C.ODD_NUMBER) & ~own.startswith('"'), text(name)).otherwise(own)

    identifier = lambda name: F.when(is_a(name, "string", "number"), text(name))
    plain = lambda name: F.when(is_a(name, "string"), text(name))
    typed = {"schema_version": F.lit(1), "timestamp": F.col("_ts"), "level": plain("level"),
             **{n: plain(n) for n in ("source", "subsystem", "event", "message")},
             **{n: identifier(n) for n in ("app_session_id", *_OPTIONAL_IDS)}, **{n: plain(n) for n in _TEXT_ONLY},
             "duration_ms": F.col("_dur"), "status": F.when(F.col("_status") != "null", json("status")),
             "fields": F.coalesce(json("fields"), F.lit("{}"))}
    decoded = F.struct(reason.alias("reason"), *(c.alias(n) for n, c in typed.items()))
    return df.select(*keep, F.explode(F.array(decoded)).alias("_event")).select(*keep, "_event.*")


def validate_events(lines: DataFrame, order_cols=("file_name", "line_number")) -> DataFrame:
    """Valid lines as the canonical event frame; ``event_id`` = order of (file, line).

    Decoded rows are stored once and numbered from there, so that no line is parsed again."""
    parsed = stored(parse_event_lines(lines).where(F.col("reason").isNull()), "decoded-events")
    numbered = with_row_numbers(parsed, list(order_cols), name="event_id")
    return numbered.select(*EVENT_COLUMNS, *order_cols)


def rejected_records(lines: DataFrame) -> DataFrame:
    """S3: file, line number and reason of each invalid line."""
    return parse_event_lines(lines).where(F.col("reason").isNotNull()).select(
        "file_name", "line_number", "reason")


def ingest_report(lines: DataFrame) -> DataFrame:
    """Per source file: bytes read, valid and invalid records, last error."""
    p = parse_event_lines(lines)
    return p.groupBy("file_name").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid"),
        F.max_by(F.col("reason"), F.when(F.col("reason").isNotNull(), F.col("line_number"))).alias("last_error"))


def ingest_totals(report: DataFrame) -> DataFrame:
    """Totals over all sources."""
    return report.agg(F.count(F.lit(1)).alias("sources"), F.sum("bytes").alias("bytes"),
                      F.sum("valid").alias("valid"), F.sum("invalid").alias("invalid"))


def source_health(report: DataFrame, expected: list[str]) -> DataFrame:
    """Expected sources with their state; problems = parse errors or missing source."""
    spark = report.sparkSession
    exp = spark.createDataFrame([(e,) for e in expected], "file_name string")
    j = exp.join(report, "file_name", "full_outer")
    state = (F.when(F.col("valid").isNull() & F.col("invalid").isNull(), "missing")
             .when(F.col("invalid") > 0, "parse errors").otherwise("healthy"))
    return (j.withColumn("state", state)
             .withColumn("problem", F.col("state") != "healthy")
             .select("file_name", "state", "problem", F.coalesce("valid", F.lit(0)).alias("valid"),
                     F.coalesce("invalid", F.lit(0)).alias("invalid"), "last_error"))


# ------------------------------------------------------------------ P4 / P5 / P6 / P16
# Producer level names and their canonical level (fixed values of the producer clients).
LEVEL_ALIASES = {
    "trace": "trace", "verbose": "trace", "debug": "debug", "log": "info", "info": "info",
    "information": "info", "warn": "warn", "warning": "warn", "error": "error",
    "fatal": "fatal", "critical": "fatal",
}


def normalize_level(col, unknown: str | None = None) -> Column:
    """Trim + lower the producer's name and map it to a canonical level.

    ``unknown``: what unrecognised names become (NULL = rejected, as the strict parser
    does; ``'info'`` as the .NET client does)."""
    key = F.lower(F.trim(C._c(col)))
    pairs = []
    for a, b in LEVEL_ALIASES.items():
        pairs += [F.lit(a), F.lit(b)]
    mapped = F.element_at(F.create_map(*pairs), key)
    return F.coalesce(mapped, F.lit(unknown)) if unknown else mapped


def normalize_timestamp(col) -> Column:
    """P5: epoch-ms number text or RFC 3339 text (offset mandatory) -> UTC instant."""
    c = C._c(col)
    return (F.when(c.rlike(_INTEGER), _instant(c.try_cast("long")))
            .when(c.rlike(_RFC3339), F.try_to_timestamp(
                F.regexp_replace(F.regexp_replace(c, "[Tt ]", "T"), "[zZ]$", "+00:00"))))


def normalize_identifier(json_text) -> Column:
    """JSON string or number -> text; null / bool / array / object -> NULL."""
    kind = C.json_kind(json_text)
    return F.when(kind.isin("string", "number"), C.json_scalar_text(json_text))


PROMOTED = ["message", "subsystem", "event", "playback_session_id", "request_id", "session_id",
            "provider", "error_kind", "duration_ms", "status"]


#: Numeric text that P16 promotes: what S2 accepts as a duration, so neither a sign, NaN nor infinity.
_DURATION_TEXT = r"^\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def promote_fields(records: DataFrame, level_col: str = "level") -> DataFrame:
    """Producer records -> event v1: promoted keys lifted out of the property bag.

    ``records`` has (event_id, timestamp, <level_col>, source, target, name, app_session_id,
    properties JSON object text). Message / event fall back to the record name, subsystem
    to the logger target; ``duration_ms`` also parses decimal text from zero up (any other value
    of it is dropped: S2 would reject it); the rest stays in ``fields`` (keys sorted)."""
    bag = F.from_json(F.col("properties"), "map<string,variant>")

    def scalar(key):
        return C.variant_scalar_text(F.element_at(bag, F.lit(key)))

    dv = F.element_at(bag, F.lit("duration_ms"))
    said = F.when(C.variant_kind(dv) == "string", F.variant_get(dv, "$", "string"))
    number = F.when(C.variant_kind(dv) == "number", dv.cast("double")).when(said.rlike(_DURATION_TEXT), said.try_cast("double"))
    dur = F.when((number >= 0) & (number < F.lit(float("inf"))), number)
    st = F.element_at(bag, F.lit("status"))
    rest = F.map_filter(bag, lambda key, _: ~key.isin(*PROMOTED))
    return records.select(
        "event_id", F.lit(1).alias("schema_version"), "timestamp",
        F.col(level_col).alias("level"), "source",
        F.coalesce(scalar("subsystem"), F.col("target")).alias("subsystem"),
        F.coalesce(scalar("event"), F.col("name")).alias("event"),
        F.coalesce(scalar("message"), F.col("name")).alias("message"),
        "app_session_id",
        scalar("playback_session_id").alias("playback_session_id"),
        scalar("request_id").alias("request_id"),
        scalar("session_id").alias("session_id"),
        F.col("target"),
        scalar("provider").alias("provider"),
        scalar("error_kind").alias("error_kind"),
        dur.alias("duration_ms"),
        F.when(st.isNotNull() & ~F.is_variant_null(st), F.to_json(st)).alias("status"),
        C.compact_json(F.to_json(rest)).alias("fields"))
