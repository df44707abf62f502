"""Filters (F1-F12): every filter compiles to one boolean ``Column``.

A ``FilterState`` is a plain parameter object; ``filter_column`` turns it into a single
conjunctive predicate that Catalyst pushes next to the scan (cheap predicates first, the
fuzzy search last). Nothing is collected: the filter is data-parallel by construction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.schema import LEVELS, NUMERIC_QUERY_FIELDS, QUERY_FIELDS

F64_EPSILON = 2.220446049250313e-16
OPERATORS = ["=", "!=", ">", ">=", "<", "<="]
ORDERING = {">", ">=", "<", "<="}
_RUST_FLOAT = re.compile(r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$", re.IGNORECASE)
_NUMERIC_TEXT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
_RFC3339 = re.compile(
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")


@dataclass
class FilterState:
    """The whole filter: facet selections, minimum level, correlation, text, predicates."""

    facets: dict = field(default_factory=dict)  # facet -> {"include": [...], "exclude": [...]}
    minimum_level: str | None = None
    correlation: str | None = None
    text: str = ""
    predicates: list = field(default_factory=list)  # (field, operator, raw value)
    now_ms: int | None = None  # reference instant for ``last-<n><unit>`` values

    def selection(self, facet: str) -> tuple[list, list]:
        sel = self.facets.get(facet) or {}
        return list(sel.get("include", [])), list(sel.get("exclude", []))

    def active_facets(self) -> list[str]:
        return [f for f in self.facets if any(self.selection(f))]


# ------------------------------------------------------------------ facet values (A3)
OPTIONAL_FACETS = {"target", "provider", "playback_session_id", "request_id", "session_id"}


def facet_value(facet: str, stored=()) -> Column:
    """The value a row contributes to ``facet`` (NULL when it contributes none); derived
    facets use the stored column when ``stored`` (the frame's columns) has it."""
    if facet in ("tag", "correlation") and facet in stored:
        return F.col(facet)
    if facet == "tag":
        return C.tag()
    if facet == "correlation":
        return C.correlation()
    if facet == "status":
        return C.json_scalar_text(F.col("status"))
    if facet in OPTIONAL_FACETS:
        return F.when(F.col(facet) != "", F.col(facet))
    if facet.startswith("fields."):
        return C.field_scalar(facet[len("fields."):])
    return F.col(facet)


# ------------------------------------------------------------------ F1 facets
PLAIN_FACETS = {"level", "source", "subsystem", "event", "app_session_id"}


def facet_condition(facet: str, include: list, exclude: list, value: Column | None = None) -> Column:
    """Included values OR-ed, excluded removed; a row lacking the facet passes excludes.

    Facets stored as plain columns are written as ``col IN (...)`` / ``col IS NULL OR NOT
    col IN (...)`` (an optional column contributes nothing when empty, so ``''`` is dropped
    from the value lists), which Parquet filter pushdown can use."""
    if value is None and (facet in PLAIN_FACETS or facet in OPTIONAL_FACETS):
        col = F.col(facet)
        inc = [x for x in include if facet in PLAIN_FACETS or x != ""]
        exc = [x for x in exclude if facet in PLAIN_FACETS or x != ""]
        cond = F.lit(True)
        if include:
            cond = cond & (col.isin(inc) if inc else F.lit(False))
        if exc:
            cond = cond & (col.isNull() | ~col.isin(exc))
        return cond
    v = facet_value(facet) if value is None else value
    cond = F.lit(True)
    if include:
        cond = cond & F.coalesce(v.isin(list(include)), F.lit(False))
    if exclude:
        cond = cond & ~F.coalesce(v.isin(list(exclude)), F.lit(False))
    return cond


def facets_column(state: FilterState, ignored_facet: str | None = None, stored=()) -> Column:
    cond = F.lit(True)
    for facet in state.active_facets():
        if facet == ignored_facet:
            continue
        value = F.col(facet) if facet in ("tag", "correlation") and facet in stored else None
        cond = cond & facet_condition(facet, *state.selection(facet), value=value)
    return cond


def where_facets(df: DataFrame, selections: dict) -> DataFrame:
    return df.where(facets_column(FilterState(facets=selections)))


# ------------------------------------------------------------------ F2 / F3
def where_minimum_level(df: DataFrame, minimum: str) -> DataFrame:
    return df.where(C.level_at_least(minimum))


def correlation_value(stored=()) -> Column:
    """The stored correlation where the frame has it, else the coalesced ids."""
    return F.col("correlation") if "correlation" in stored else C.correlation()


def where_correlation(df: DataFrame, correlation_id: str) -> DataFrame:
    return df.where(correlation_value(tuple(df.columns)) == F.lit(correlation_id))


# ------------------------------------------------------------------ F4-F6 predicates
@dataclass
class Predicate:
    field: str
    operator: str
    literal: float | str  # float = number literal, str = text literal
    label: str


_QUOTED = re.compile(r"""(["'])(.*)\1""", re.DOTALL)
_RELATIVE = re.compile(r"last-(\d{1,18})([smhd])", re.IGNORECASE)
_UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Instants beyond this many milliseconds from the epoch compare like this one (no event has such a time).
_FAR_MS = 9_200_000_000_000_000


def _relative_ms(value: str) -> int | None:
    """Milliseconds that ``last-<n><unit>`` goes back; None for any other text."""
    found = _RELATIVE.fullmatch(value)
    return int(found[1]) * _UNIT_MS[found[2].lower()] or None if found else None


def _as_instant(value: str) -> float | None:
    """Epoch milliseconds of a whole number or an RFC 3339 time."""
    if re.fullmatch(r"[+-]?[0-9]+", value):
        return max(-_FAR_MS, min(_FAR_MS, float(value)))
    if not _RFC3339.match(value):
        return None
    try:
        return float((datetime.fromisoformat(value.upper()) - _EPOCH) // timedelta(milliseconds=1))
    except ValueError:  # such as a thirteenth month
        return None


def _as_number(value: str) -> float | None:
    return float(value) if _RUST_FLOAT.match(value) else None


#: Kind of literal -> how its text is read (None: not of the kind) and what the kind is called.
LITERAL_KINDS = {
    "instant": (_as_instant, "a time: epoch milliseconds, RFC 3339 or last-<n><s|m|h|d>"),
    "number": (_as_number, "a numeric value"),
    "text": (str, "a text"),
}


def _literal_kind(key: str, op: str) -> str:
    """An instant for the time, a number for numeric fields and for every ordering, else text."""
    if key == "timestamp":
        return "instant"
    return "number" if key in NUMERIC_QUERY_FIELDS or op in ORDERING else "text"


def _bare(value: str) -> str | None:
    """The text inside a pair of quotes, or the text as it is; None if a quote stands alone."""
    value = value.strip()
    if found := _QUOTED.fullmatch(value):
        return re.sub(r"""\\(["'])""", r"\1", found[2])
    return None if value[:1] in ("'", '"') or value[-1:] in ("'", '"') else value


def build_predicate(name: str, op: str, raw: str, now_ms: int | None) -> tuple[Predicate | None, str | None]:
    """One checked (field, operator, value): the predicate, or what is wrong with it."""
    nested = name.startswith("fields.") and name != "fields."
    key = name if nested else name.lower()
    value = _bare(raw)
    problems = {
        f"Unknown field {name!r}": not nested and key not in QUERY_FIELDS,
        f"No such comparison: {op!r}": op not in OPERATORS,
        f"The value of {name} has one quote only": value is None,
        f"The value of {name} is empty": value == "",
    }
    for problem, present in problems.items():
        if present:
            return None, problem
    label = f"{name} {op} {value}"
    if key == "timestamp" and (back := _relative_ms(value)):  # whatever operator was written
        now = now_ms if now_ms is not None else (datetime.now(timezone.utc) - _EPOCH) // timedelta(milliseconds=1)
        return Predicate(key, ">=", max(-_FAR_MS, float(now - back)), label), None
    read, wanted = LITERAL_KINDS[_literal_kind(key, op)]
    literal = read(value)
    return (None, f"{name} expects {wanted}") if literal is None else (Predicate(key, op, literal, label), None)


def validate_predicates(predicates, now_ms: int | None = None) -> tuple[list[Predicate], list[str]]:
    """parse a list of (field, op, value); any error makes the filter match nothing."""
    checked = [build_predicate(name, op, str(raw), now_ms) for name, op, raw in predicates]
    return [p for p, _ in checked if p is not None], [e for _, e in checked if e is not None]


def _query_value(name: str, stored=()) -> tuple[Column, Column]:
    """(kind, value) of a queryable field: kind 'number' / 'text' / NULL (missing)."""
    if name == "schema_version":
        return F.lit("number"), F.col("schema_version").cast("double")
    if name == "timestamp":
        return F.lit("number"), F.unix_millis("timestamp").cast("double")
    if name == "duration_ms":
        return F.when(F.col("duration_ms").isNotNull(), "number"), F.col("duration_ms")
    if name == "tag":
        return F.lit("text"), F.col("tag") if "tag" in stored else C.tag()
    if name == "correlation":
        return F.lit("text"), correlation_value(stored)
    if name == "status" or name.startswith("fields."):
        if name == "status":
            kind = C.json_kind(F.col("status"))
            text = C.json_scalar_text(F.col("status"))
        else:
            kind = C.field_kind(name[len("fields."):])
            text = C.field_scalar(name[len("fields."):])
        k = F.when(kind == "number", "number").when(kind.isin("string", "boolean"), "text")
        return k, text
    return F.when(F.col(name).isNotNull(), "text"), F.col(name)


def _compare_number(op: str, left: Column, right: Column) -> Column:
    nan = F.isnan(left) | F.isnan(right)
    diff = F.abs(left - right)
    cmp = {"=": diff < F64_EPSILON, "!=": diff >= F64_EPSILON, ">": left > right,
           ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return ~nan & cmp


def _time_column(op: str, millis: float, stored) -> Column:
    """The event time's whole milliseconds against a literal, as bounds on the stored instant.

    Where the events carry their partition day the bounds are also put on it, a day wider, so
    that they hold whichever zone the day was taken in.
    """
    start, end = (F.timestamp_millis(F.lit(int(millis) + i)) for i in (0, 1))
    at = F.col("timestamp")
    lower, upper = {">=": (start, None), ">": (end, None), "<": (None, start), "<=": (None, end),
                    "=": (start, end), "!=": (None, None)}[op]
    if op == "!=":
        return (at < start) | (at >= end)
    cond = F.lit(True)
    try:
        day = (_EPOCH + timedelta(milliseconds=millis)).date()
        first, last = day - timedelta(days=1), day + timedelta(days=1)
    except OverflowError:  # beyond the calendar: no bound on the day
        first = last = None
    if lower is not None:
        cond = cond & (at >= lower)
        if first and "event_date" in stored:
            cond = cond & (F.col("event_date") >= F.lit(first))
    if upper is not None:
        cond = cond & (at < upper)
        if last and "event_date" in stored:
            cond = cond & (F.col("event_date") <= F.lit(last))
    return cond


def _number_column(op: str, value: Column, literal: float) -> Column:
    """A stored numeric column against a number; the plain bounds reach the scan."""
    exact = _compare_number(op, value, F.lit(literal))
    return exact & value.between(literal - 1e-15, literal + 1e-15) if op == "=" else exact


def predicate_column(p: Predicate, stored=()) -> Column:
    """F4 as a condition; true where the predicate holds, false or null elsewhere.

    Comparisons of stored columns are plain, so that they reach the scan (time, duration,
    level, texts without letters); ``stored`` names the frame's columns.
    """
    if p.field == "timestamp":
        return _time_column(p.operator, p.literal, stored)
    if p.field in NUMERIC_QUERY_FIELDS:
        return _number_column(p.operator, F.col(p.field).cast("double"), p.literal)
    if isinstance(p.literal, str) and p.operator in ("=", "!=") and p.field in PLAIN_TEXT_FIELDS:
        text = p.literal.translate(_ASCII_LOWER)
        if p.field == "level" or text == text.translate(_ASCII_UPPER):  # levels are in lower case
            return F.col(p.field) == text if p.operator == "=" else F.col(p.field) != text
    kind, value = _query_value(p.field, stored)
    if isinstance(p.literal, float):
        right = F.lit(p.literal)
        parsed = F.when(value.rlike(_NUMERIC_TEXT), value.try_cast("double"))
        left = F.when(kind == "number", value.cast("double")).when(kind == "text", parsed)
        return F.coalesce(_compare_number(p.operator, left, right), F.lit(False))
    # text literal
    lit_num = float(p.literal) if _RUST_FLOAT.match(p.literal) else None
    text_cmp = {"=": C.ascii_lower(value) == F.lit(p.literal.translate(_ASCII_LOWER)),
                "!=": C.ascii_lower(value) != F.lit(p.literal.translate(_ASCII_LOWER))}.get(p.operator, F.lit(False))
    if lit_num is None:
        num_cmp = F.lit(False)
    else:
        num_cmp = _compare_number(p.operator, value.cast("double"), F.lit(lit_num))
    return F.coalesce(F.when(kind == "text", text_cmp).when(kind == "number", num_cmp), F.lit(False))


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ASCII_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Text fields that are columns of the event itself.
PLAIN_TEXT_FIELDS = set(QUERY_FIELDS) - set(NUMERIC_QUERY_FIELDS) - {"timestamp", "tag", "correlation", "status"}


def predicates_column(predicates, now_ms: int | None = None, stored=()) -> Column:
    ok, errors = validate_predicates(predicates, now_ms)
    if errors:
        return F.lit(False)
    cond = F.lit(True)
    for p in ok:
        cond = cond & predicate_column(p, stored)
    return cond


def where_predicates(df: DataFrame, predicates, now_ms: int | None = None) -> DataFrame:
    return df.where(predicates_column(predicates, now_ms, tuple(df.columns)))


def where_time(df: DataFrame, op: str, value: str, now_ms: int | None = None) -> DataFrame:
    """timestamp against epoch ms, RFC 3339 or ``last-<n><s|m|h|d>`` (then >= now - n)."""
    return where_predicates(df, [("timestamp", op, value)], now_ms)


# ------------------------------------------------------------------ F7 / F8 search
def search_terms(text: str) -> list[str]:
    """Split on non-alphanumerics, ASCII-lower-case, drop empties."""
    terms, cur = [], []
    for ch in text:
        if ch.isalnum():
            cur.append(ch)
        elif cur:
            terms.append("".join(cur))
            cur = []
    if cur:
        terms.append("".join(cur))
    return [t.translate(_ASCII_LOWER) for t in terms]


def _latin1(col: Column) -> Column:
    # Re-decode UTF-8 bytes one byte per char so edit distances count bytes.
    return F.decode(F.encode(col, "UTF-8"), "ISO-8859-1")


def _term_check(doc: Column, words: Column, term: str, fuzzy: bool) -> Column:
    exact = F.contains(doc, F.lit(term))
    n = len(term.encode("utf-8"))
    if not fuzzy or n < 4 or n > 64:
        return exact
    k = 2 if n >= 8 else 1
    t = F.lit(term.encode("utf-8").decode("latin-1"))
    near = F.exists(words, lambda w: (F.abs(F.octet_length(w) - n) <= k) & (F.octet_length(w) <= 64)
                    & (F.levenshtein(_latin1(w), t, k) >= 0))
    return exact | near


def term_column(document: Column, term: str, fuzzy: bool = True) -> Column:
    """Term hits if a substring of the document, else (fuzzy) a word within 1 or 2 edits."""
    return search_terms_column(document, [term], fuzzy)


def search_terms_column(document: Column, terms: list[str], fuzzy: bool = True) -> Column:
    """AND over terms: each is an exact substring test, else (fuzzy) an edit-distance test
    over the document's words. Plain column expressions, so the exact tests stay in
    generated code and the word scan runs only for rows the substring test missed."""
    if not terms:
        return F.lit(True)
    words = F.split(document, C.NON_WORD_RUN)
    cond = None
    for term in terms:
        c = _term_check(document, words, term, fuzzy)
        cond = c if cond is None else cond & c
    return cond


def search_column(text: str, fuzzy: bool = True, document: Column | None = None) -> Column:
    terms = search_terms(text)
    if not terms:
        return F.lit(True)
    doc = C.search_document() if document is None else document
    return search_terms_column(doc, terms, fuzzy)


def _stored_document(df: DataFrame) -> Column | None:
    return F.col("search_document") if "search_document" in df.columns else None


def search(df: DataFrame, text: str, fuzzy: bool = True) -> DataFrame:
    """AND over terms against the event's search document (the stored column when
    the events come from the event store)."""
    return df.where(search_column(text, fuzzy, _stored_document(df)))


def search_since(df: DataFrame, text: str, after_event_id: int, fuzzy: bool = True) -> DataFrame:
    """search only rows ingested after a position (cheap id predicate first)."""
    return df.where((F.col("event_id") > F.lit(after_event_id)) & search_column(text, fuzzy, _stored_document(df)))


# ------------------------------------------------------------------ F9 / F10
def filter_column(state: FilterState, ignored_facet: str | None = None, stored=()) -> Column:
    """F1 AND F2 AND F3 AND F4 AND F7/F8 as one predicate (search last: most expensive)."""
    cond = facets_column(state, ignored_facet, stored)
    if state.minimum_level:
        cond = cond & C.level_at_least(state.minimum_level)
    if state.correlation is not None:
        cond = cond & (correlation_value(stored) == F.lit(state.correlation))
    if state.predicates:
        cond = cond & predicates_column(state.predicates, state.now_ms, stored)
    if state.text.strip():
        cond = cond & search_column(state.text, document=F.col("search_document")
                                    if "search_document" in stored else None)
    return cond


def apply_filter(df: DataFrame, state: FilterState) -> DataFrame:
    return df.where(filter_column(state, stored=tuple(df.columns)))


def view_session(session_id: str) -> FilterState:
    """a fresh filter holding only ``app_session_id = id``."""
    return FilterState(facets={"app_session_id": {"include": [session_id]}})


# ------------------------------------------------------------------ J5 large value sets
def filter_by_values(df: DataFrame, facet: str, values: DataFrame, exclude: bool = False) -> DataFrame:
    """Include / exclude by a DataFrame of values (column ``value``) too big for a literal list.

    A semi / anti join on the facet value; rows lacking the facet never match an include and
    always survive an exclude (the null key matches nothing). Join strategy is left to AQE.
    """
    keyed = df.withColumn("__facet_value", facet_value(facet, tuple(df.columns)))
    vals = values.select(F.col("value").alias("__facet_value")).distinct()
    out = keyed.join(vals, "__facet_value", "left_anti" if exclude else "left_semi")
    return out.drop("__facet_value")
