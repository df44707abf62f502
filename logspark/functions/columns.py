"""Scalar column derivations over the canonical event frame.

Everything here builds a ``Column`` from built-in Spark functions, so derivations stay
inside whole-stage codegen and are fused with the scan and the filters that use them.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.schema import CONTEXT_SEGMENTS, LEVELS, MAX_TAG_CHARACTERS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
# Java regex classes equal to the Unicode properties the contract uses.
WORD_CHAR = r"[\p{IsAlphabetic}\p{N}]"
NON_WORD_RUN = r"[^\p{IsAlphabetic}\p{N}]+"
WHITE = r"\p{IsWhite_Space}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sql_list(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def ascii_lower(col) -> Column:
    """Lower-case ASCII letters only (the contract never folds other scripts)."""
    return F.translate(_c(col), _UPPER, _LOWER)


def unicode_trim(col) -> Column:
    """Trim Unicode white space on both ends (Spark's ``trim`` removes blanks only)."""
    return F.regexp_replace(_c(col), rf"^{WHITE}+|{WHITE}+$", "")


# ---------------------------------------------------------------- P3 severity
def severity(level="level") -> Column:
    """Level name -> 0..5; unknown names -> NULL."""
    pairs = []
    for rank, name in enumerate(LEVELS):
        pairs += [F.lit(name), F.lit(rank)]
    return F.element_at(F.create_map(*pairs), _c(level))


def level_at_least(minimum: str, level="level") -> Column:
    """severity >= minimum, written as ``level IN (...)`` so it reaches the Parquet scan."""
    return _c(level).isin(*LEVELS[LEVELS.index(minimum):])


def is_error(level="level") -> Column:
    return _c(level).isin("error", "fatal")


# ---------------------------------------------------------------- P1 correlation
def correlation() -> Column:
    """First present of playback, request, session, app session id; '' counts as present."""
    return F.coalesce(F.col("playback_session_id"), F.col("request_id"), F.col("session_id"),
                      F.col("app_session_id"))


# ---------------------------------------------------------------- P2 tag
def tag(message="message", subsystem="subsystem") -> Column:
    """Feature tag: bracketed message segment, else the first useful subsystem part."""
    msg = f"`{message}`" if isinstance(message, str) else None
    sub = f"`{subsystem}`" if isinstance(subsystem, str) else None
    ctx = _sql_list(CONTEXT_SEGMENTS)
    low = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    # Segments after each '[' (the text before the first '[' is skipped); keep taking
    # segments while they contain ']' and cut each at its first ']'.
    segs = f"filter(split({msg}, '\\\\['), (x, i) -> i > 0)"
    stop = f"array_position(transform({segs}, s -> instr(s, ']') = 0), true)"
    taken = f"if({stop} = 0, {segs}, slice({segs}, 1, greatest({stop} - 1, 0)))"
    vals = (f"filter(transform({taken}, s -> regexp_replace(substring_index(s, ']', 1), "
            f"'^\\\\p{{IsWhite_Space}}+|\\\\p{{IsWhite_Space}}+$', '')), "
            f"v -> v != '' AND char_length(v) <= {MAX_TAG_CHARACTERS})")
    from_msg = (f"coalesce(get(filter({vals}, v -> NOT array_contains({ctx}, {low.format('v')})), 0), "
                f"get({vals}, 0))")
    parts = f"split({sub}, '\\\\.')"
    part = (f"coalesce(get(filter({parts}, p -> p != '' AND NOT array_contains({ctx}, {low.format('p')})), 0), "
            f"get(filter({parts}, p -> p != ''), 0), 'Other')")
    words = (f"array_join(transform(filter(split({part}, '_'), w -> w != ''), "
             f"w -> concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ')")
    return F.expr(f"coalesce({from_msg}, {words})")


# ---------------------------------------------------------------- P7 JSON scalar text
def json_kind(json_text) -> Column:
    """Kind of a JSON text value from its first character (no parse needed)."""
    first = F.substring(F.ltrim(_c(json_text)), 1, 1)
    return (F.when(_c(json_text).isNull(), F.lit(None))
            .when(first == '"', "string").when(first == "{", "object").when(first == "[", "array")
            .when(first.isin("t", "f"), "boolean").when(first == "n", "null")
            .otherwise("number"))


def json_scalar_text(json_text) -> Column:
    """Scalar JSON -> text (strings unescaped, numbers as written); null/array/object -> NULL."""
    kind = json_kind(json_text)
    unquoted = F.get_json_object(F.concat(F.lit("["), _c(json_text), F.lit("]")), "$[0]")
    return (F.when(kind == "string", unquoted)
            .when(kind.isin("number", "boolean"), F.trim(_c(json_text))))


#: JSON text in which a number may be written otherwise than VARIANT prints it: zeros after the
#: point, an exponent, minus zero, or more digits than a decimal holds.
ODD_NUMBER = r"\.[0-9]*0(?![0-9])|[0-9][eE][+-]?[0-9]|-0(?![.0-9])|[0-9.]{38}"


@contextmanager
def repeated_keys_allowed(spark):
    """VARIANT parsers built inside take the last of repeated keys instead of failing; the setting is put back."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def json_string(col) -> Column:
    """A text as a JSON string literal (quoted, escaped); NULL stays NULL."""
    quoted = F.to_json(F.array(_c(col)))
    return F.when(_c(col).isNotNull(), quoted.substr(F.lit(2), F.length(quoted) - 2))


def compact_json(json_text) -> Column:
    """A JSON text without spaces, an object's keys sorted, its numbers kept.

    A number with a point or an exponent is a double and prints as one (``1.0``, ``1e3`` as
    ``1000.0``, ``2.50`` as ``2.5``); an integer keeps its digits, however many. VARIANT would
    print ``1.0`` as ``1``, so texts with such numbers (``ODD_NUMBER``) are put together from
    their keys' own texts; keys of containers inside those keep their order.
    """
    text = _c(json_text)
    kind = json_kind(text)
    raw, values = F.from_json(text, "map<string,string>"), fields_variant_map(text)

    def entry(key):
        value, own = F.element_at(values, key), F.element_at(raw, key)
        return F.concat(json_string(key), F.lit(":"), F.when(variant_kind(value).isin("number", "object", "array"), own).otherwise(F.to_json(value)))

    entries = F.array_join(F.transform(F.array_sort(F.map_keys(raw)), entry), ",")
    odd = (F.when(kind == "object", F.concat(F.lit("{"), entries, F.lit("}"))).when(kind == "number", F.trim(text))
           .when(kind == "array", F.element_at(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 1)))
    plain = F.to_json(F.try_parse_json(text))
    return F.when(text.rlike(ODD_NUMBER), F.coalesce(odd, plain)).otherwise(plain)


def status_text(status="status") -> Column:
    """Status shown as text; absent or non-scalar -> '-'."""
    return F.coalesce(json_scalar_text(status), F.lit("-"))


def fields_variant_map(fields="fields") -> Column:
    """``fields`` JSON object text -> MAP<STRING, VARIANT> (one parse per row)."""
    return F.from_json(_c(fields), "map<string,variant>")


def variant_kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
            .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
            .when(t == "VOID", "null").otherwise("number"))


def variant_scalar_text(v: Column) -> Column:
    kind = variant_kind(v)
    return (F.when(kind == "string", F.variant_get(v, "$", "string"))
            .when(kind.isin("number", "boolean"), v.cast("string")))


def _number_as_written(text: Column, fields, name: Column) -> Column:
    """``text`` of a number, as it is written in the ``fields`` object where VARIANT prints it otherwise."""
    return F.when(_c(fields).rlike(ODD_NUMBER), F.element_at(F.from_json(_c(fields), "map<string,string>"), name)).otherwise(text)


def field_entries(fields="fields") -> Column:
    """ARRAY<STRUCT<key, kind, text>> of the ``fields`` object, keys sorted."""
    m = fields_variant_map(fields)
    keys = F.array_sort(F.coalesce(F.map_keys(m), F.array().cast("array<string>")))

    def entry(k):
        v = F.element_at(m, k)
        kind, text = variant_kind(v), variant_scalar_text(v)
        number = kind == "number"
        return F.struct(k.alias("key"), kind.alias("kind"),
                        F.when(number, _number_as_written(text, fields, k)).otherwise(text).alias("text"),
                        F.when(number, _number_as_written(F.to_json(v), fields, k)).otherwise(F.to_json(v)).alias("json"))

    return F.transform(keys, entry)


def field_scalar(name: str, fields="fields") -> Column:
    """Scalar text of ``fields.<name>`` (NULL when missing, null or nested)."""
    v = F.element_at(fields_variant_map(fields), F.lit(name))
    text = variant_scalar_text(v)
    return F.when(variant_kind(v) == "number", _number_as_written(text, fields, F.lit(name))).otherwise(text)


def field_kind(name: str, fields="fields") -> Column:
    v = F.element_at(fields_variant_map(fields), F.lit(name))
    return F.when(v.isNotNull(), variant_kind(v))


# ---------------------------------------------------------------- P8 search document
def search_document() -> Column:
    """ASCII-lower-cased text searched by F7/F8: message, event, subsystem, source,
    correlation, the optional target / provider / error kind, then the status and fields
    JSON.

    Search terms are alphanumeric runs and a term can only match inside one alphanumeric
    run of the document, so the document is defined by its runs, not by separators or
    key order: the raw JSON text of ``status`` and ``fields`` carries exactly the runs of
    their ``key value`` rendering and needs no JSON parse.
    """
    doc = F.concat_ws(
        " ", F.lit(""), F.col("message"), F.col("event"), F.col("subsystem"), F.col("source"),
        correlation(), F.col("target"), F.col("provider"), F.col("error_kind"), F.col("status"),
        F.when(F.col("fields") != "{}", F.col("fields")))
    return ascii_lower(doc)


# ---------------------------------------------------------------- P9 / P10 repeat shape
def message_shape(col) -> Column:
    """Trim, digit runs -> '#', white-space runs -> one blank, lower-case."""
    s = unicode_trim(col)
    s = F.regexp_replace(s, "[0-9]+", "#")
    s = F.regexp_replace(s, f"{WHITE}+", " ")
    return F.lower(s)


STACK_KEYS = ["stack", "stack_trace", "error_stack"]


def stack_text(fields="fields") -> Column:
    """First *string* among fields.stack, stack_trace, error_stack ('' if none)."""
    m = fields_variant_map(fields)
    picks = []
    for key in STACK_KEYS:
        v = F.element_at(m, F.lit(key))
        picks.append(F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")))
    return F.coalesce(*picks, F.lit(""))


REPEAT_KEY_COLUMNS = ["source", "subsystem", "event", "rk_error_kind", "rk_message", "rk_stack"]


def with_repeat_key(df):
    """Six key columns identifying repeats of one event shape (P10)."""
    return (df.withColumn("rk_error_kind", F.coalesce(F.col("error_kind"), F.lit("")))
              .withColumn("rk_message", message_shape("message"))
              .withColumn("rk_stack", message_shape(stack_text("fields"))))


# ---------------------------------------------------------------- P11 console detail
def console_detail() -> Column:
    """`name: message` of Error-like console arguments, distinct, joined by ' · '."""
    m = F.from_json(F.col("fields"), "map<string,string>")
    raw = F.coalesce(F.element_at(m, F.lit("arguments")), F.element_at(m, F.lit("args")))
    args = F.from_json(raw, "array<string>")
    objs = F.transform(args, lambda a: F.from_json(a, "map<string,variant>"))
    def detail(o):
        msg_v = F.element_at(o, F.lit("message"))
        name_v = F.element_at(o, F.lit("name"))
        msg = F.when(F.schema_of_variant(msg_v) == "STRING", unicode_trim(F.variant_get(msg_v, "$", "string")))
        name = F.when(F.schema_of_variant(name_v) == "STRING", unicode_trim(F.variant_get(name_v, "$", "string")))
        ok = msg.isNotNull() & (msg != "") & (msg != F.col("message"))
        return F.when(ok, F.when(name.isNotNull() & (name != ""), F.concat(name, F.lit(": "), msg))
                      .otherwise(msg))
    details = F.array_distinct(F.filter(F.transform(objs, detail), lambda d: d.isNotNull()))
    return F.when((F.col("event") == "console.message") & (F.size(details) > 0),
                  F.array_join(details, " · "))


# ---------------------------------------------------------------- P15 subsystem inference
def infer_subsystem(message="message") -> Column:
    """Leading ``[Name]`` -> trimmed, lower, non-alphanumeric runs -> '_'; else 'renderer'."""
    name = F.regexp_extract(_c(message), r"^\[([^\]]+)\]", 1)
    slug = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("renderer"))


# ---------------------------------------------------------------- P17 / P18 text
DEFAULT_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS xxx"
# Fixed presets of the display (full, date + time, time only, US 12-hour), in Spark
# pattern syntax: %Y-%m-%d %H:%M:%S%.3f %:z, %d/%m/%Y %H:%M:%S, %H:%M:%S%.3f,
# %m/%d/%Y %I:%M:%S %p.
TIMESTAMP_PRESETS = {
    "default": "yyyy-MM-dd HH:mm:ss.SSS xxx",
    "date_time": "dd/MM/yyyy HH:mm:ss",
    "time": "HH:mm:ss.SSS",
    "us_12h": "MM/dd/yyyy hh:mm:ss a",
}


def timestamp_text(ts="timestamp", fmt: str = DEFAULT_TIMESTAMP_FORMAT, tz: str = "UTC") -> Column:
    """Render an instant in a zone (``tz`` = 'UTC' or any region id)."""
    local = F.from_utc_timestamp(_c(ts), tz)
    text = F.date_format(local, fmt.replace("xxx", "'__OFF__'")) if "xxx" in fmt else F.date_format(local, fmt)
    if "xxx" in fmt:
        offset_min = ((F.unix_seconds(local) - F.unix_seconds(_c(ts))) / 60).cast("int")
        sign = F.when(offset_min < 0, "-").otherwise("+")
        off = F.concat(sign, F.lpad((F.abs(offset_min) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"),
                       F.lpad((F.abs(offset_min) % 60).cast("string"), 2, "0"))
        text = F.replace(text, F.lit("__OFF__"), off)
    return text


def relative_elapsed_text(ms) -> Column:
    """Signed elapsed text: ``+1.842s``, ``+2m 3.000s``, ``+1h 05m``."""
    ms = _c(ms)
    sign = F.when(ms < 0, "-").otherwise("+")
    a = F.abs(ms)
    return (F.when(a < 60000, F.concat(sign, F.format_string("%.3fs", a / 1000.0)))
            .when(a < 3600000, F.concat(sign, (a / 60000).cast("long").cast("string"), F.lit("m "),
                                        F.format_string("%.3fs", (a % 60000) / 1000.0)))
            .otherwise(F.concat(sign, (a / 3600000).cast("long").cast("string"), F.lit("h "),
                                F.lpad(((a % 3600000) / 60000).cast("long").cast("string"), 2, "0"),
                                F.lit("m"))))


def elapsed_text(ms) -> Column:
    """Unsigned elapsed text: ``n ms``, ``s.s s``, ``Mm SSs``."""
    ms = _c(ms)
    return (F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
            # round half to even first (as the reference's formatter does), then print
            .when(ms < 60000, F.format_string("%.1f s", F.bround(ms / 1000.0, 1)))
            .otherwise(F.concat((ms / 60000).cast("long").cast("string"), F.lit("m "),
                                F.lpad(((ms % 60000) / 1000).cast("long").cast("string"), 2, "0"),
                                F.lit("s"))))


def compact_identifier(col, max_characters: int = 80) -> Column:
    """Cut text to ``max_characters`` with a trailing ellipsis."""
    c = _c(col)
    return F.when(F.char_length(c) <= max_characters, c).otherwise(
        F.concat(F.substring(c, 1, max(max_characters - 1, 0)), F.lit("…")))


def with_derived(df):
    """Materialisable derived columns (P1, P2, P3): correlation, tag, severity."""
    return (df.withColumn("correlation", correlation())
              .withColumn("tag", tag())
              .withColumn("severity", severity()))
