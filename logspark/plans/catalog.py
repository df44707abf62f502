"""Named query plans: each is ``(spark, sf_dir) -> DataFrame`` over the driver tables.

``QUERIES`` and ``ORACLE`` are filled by the ``register`` decorator; ``ORACLE`` holds the
DuckDB SQL that computes the same answer independently (absent where no SQL exists).
Timestamps leave as epoch milliseconds so both engines print them identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators import facets as FA
from logspark.operators import filters as FI
from logspark.plans import oracle as O
from logspark.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


EV = O.with_ctes(O.EV_BASE)
DOC = O.with_ctes(O.DOC_BASE)
CONV = O.with_ctes(O.CONV_BASE)

# ---------------------------------------------------------------- A2 + F1 + F2 (flagship)
FLAGSHIP_STATE = FI.FilterState(
    facets={"source": {"include": ["src0", "src1"]}, "provider": {"exclude": ["local"]}},
    minimum_level="debug")

_FACET_SQL_VALUES = {
    "level": "level", "source": "source", "tag": "tag", "subsystem": "subsystem",
    "event": "event", "correlation": "corr", "app_session_id": "app_session_id",
    "target": "nullif(target, '')", "provider": "nullif(provider, '')",
    "playback_session_id": "nullif(playback_session_id, '')",
    "request_id": "nullif(request_id, '')", "session_id": "nullif(session_id, '')",
    "status": O.STATUS_SCALAR_SQL,
}


def _facet_union_sql(source_cond: str, provider_cond: str, base_where: str) -> str:
    parts = []
    for facet, expr in _FACET_SQL_VALUES.items():
        conds = [base_where]
        if facet != "source":
            conds.append(source_cond)
        if facet != "provider":
            conds.append(provider_cond)
        parts.append(f"SELECT '{facet}' AS facet, {expr} AS value FROM base WHERE {' AND '.join(conds)}")
    conds = " AND ".join([base_where, source_cond, provider_cond])
    parts.append(
        "SELECT 'fields.' || j.key AS facet, CASE WHEN j.type = 'VARCHAR' THEN json_extract_string(j.value, '$') "
        "ELSE CAST(j.value AS VARCHAR) END AS value FROM base, json_each(base.fields) j "
        f"WHERE j.type IN ('VARCHAR','BIGINT','UBIGINT','DOUBLE','BOOLEAN') AND {conds}")
    return "\nUNION ALL\n".join(parts)


@register("facet_counts_all", EV + f""",
base AS (SELECT *, {O.tag_sql()} AS tag, {O.CORR_SQL} AS corr, {O.LEVELS_SQL} AS sev FROM ev),
p AS ({_facet_union_sql("source IN ('src0','src1')", "coalesce(nullif(provider,'') NOT IN ('local'), true)", "sev >= 1")})
SELECT facet, value, count(*) AS count FROM p WHERE value IS NOT NULL GROUP BY facet, value
""")
def q_facet_counts_all(spark, sf_dir):
    """A2: counts of every facet under the flagship filter, own selection ignored."""
    return FA.facet_counts_all(T.load_events(spark, sf_dir), FLAGSHIP_STATE)


@register("facet_counts_level", EV + """
SELECT level AS value, count(*) AS count FROM ev WHERE source <> 'src2' GROUP BY level
""")
def q_facet_counts_level(spark, sf_dir):
    """A1: one facet's counts; its own include list is ignored, other facets apply."""
    state = FI.FilterState(facets={"level": {"include": ["warn", "error"]},
                                   "source": {"exclude": ["src2"]}})
    # the level selection is the facet's own and is ignored for the level counts
    return FA.facet_counts(T.load_events(spark, sf_dir), "level", state)


@register("facet_values", EV + f""",
base AS (SELECT *, {O.tag_sql()} AS tag, {O.CORR_SQL} AS corr FROM ev)
{" UNION ALL ".join(f"SELECT event_id, '{f}' AS facet, {e} AS value FROM base WHERE {e} IS NOT NULL"
                    for f, e in _FACET_SQL_VALUES.items())}
UNION ALL
SELECT event_id, 'fields.' || j.key AS facet, CASE WHEN j.type = 'VARCHAR' THEN json_extract_string(j.value, '$')
  ELSE CAST(j.value AS VARCHAR) END AS value
FROM base, json_each(base.fields) j WHERE j.type IN ('VARCHAR','BIGINT','UBIGINT','DOUBLE','BOOLEAN')
""")
def q_facet_values(spark, sf_dir):
    """A3: every (event, facet, value) an event is indexed under."""
    return FA.facet_values(T.load_events(spark, sf_dir))


# ---------------------------------------------------------------- P1 P2 P3 P7
@register("derived_columns", EV + f"""
SELECT event_id, {O.CORR_SQL} AS correlation, {O.tag_sql()} AS tag, {O.LEVELS_SQL} AS severity,
       {O.STATUS_TEXT_SQL} AS status_text FROM ev
""")
def q_derived_columns(spark, sf_dir):
    """P1 correlation, P2 tag, P3 severity, P7 status text for every event."""
    ev = T.load_events(spark, sf_dir)
    return ev.select("event_id", C.correlation().alias("correlation"), C.tag().alias("tag"),
                     C.severity().alias("severity"), C.status_text().alias("status_text"))


@register("document_tags", DOC + f"""
SELECT event_id, {O.tag_sql()} AS tag FROM ev
""")
def q_document_tags(spark, sf_dir):
    """P2 over whole document texts (brackets anywhere in free text)."""
    return T.load_documents(spark, sf_dir).select("event_id", C.tag().alias("tag"))


# ---------------------------------------------------------------- F4 / F6 / F9
PREDICATES = [("duration_ms", ">=", "100"), ("fields.paid", "=", "FALSE"), ("status", "!=", "completed")]


@register("typed_predicates", EV + """
SELECT event_id FROM ev
WHERE duration_ms >= 100
  AND json_extract_string(fields, '$.paid') = 'false'
  AND json_type(status) IN ('VARCHAR','BIGINT','UBIGINT','DOUBLE','BOOLEAN')
  AND CASE WHEN json_type(status) = 'VARCHAR' THEN lower(json_extract_string(status, '$')) <> 'completed'
           ELSE false END
""")
def q_typed_predicates(spark, sf_dir):
    """typed comparisons; missing / nested values fail every operator, even !=."""
    return FI.where_predicates(T.load_events(spark, sf_dir), PREDICATES).select("event_id")


@register("numeric_text_predicates", EV + """
SELECT event_id FROM ev
WHERE CAST(json_extract_string(fields, '$.k') AS DOUBLE) < 20
  AND CASE WHEN json_type(status) IN ('BIGINT','UBIGINT','DOUBLE') THEN abs(CAST(status AS DOUBLE) - 200) < 2.220446049250313e-16
           ELSE false END
""")
def q_numeric_text_predicates(spark, sf_dir):
    """ordering on a numeric field value; text literal against a numeric status."""
    preds = [("fields.k", "<", "20"), ("status", "=", "200")]
    return FI.where_predicates(T.load_events(spark, sf_dir), preds).select("event_id")


NOW_MS = 1704326400000  # 2024-01-04T00:00:00Z, the fixed "now" of relative predicates


@register("time_window", EV + """
SELECT event_id FROM ev
WHERE (epoch_us("timestamp") // 1000) >= 1704326400000 - 2 * 86400000
  AND (epoch_us("timestamp") // 1000) < 1704283200000
""")
def q_time_window(spark, sf_dir):
    """``last-2d`` against a fixed now, and an RFC 3339 upper bound."""
    preds = [("timestamp", "=", "last-2d"), ("timestamp", "<", "2024-01-03T12:00:00Z")]
    return FI.where_predicates(T.load_events(spark, sf_dir), preds, now_ms=NOW_MS).select("event_id")


@register("invalid_filter", EV + """
SELECT event_id FROM ev WHERE false
""")
def q_invalid_filter(spark, sf_dir):
    """one invalid predicate (ordering needs a number) makes the filter match nothing."""
    preds = [("level", ">=", "warn"), ("duration_ms", ">", "1")]
    return FI.where_predicates(T.load_events(spark, sf_dir), preds).select("event_id")


@register("filter_events", EV + f""",
base AS (SELECT *, {O.LEVELS_SQL} AS sev, {O.tag_sql()} AS tag FROM ev)
SELECT event_id FROM base
WHERE sev >= 3 AND tag IN ('Purchase', 'Error') AND source <> 'src1'
  AND duration_ms > 50
""")
def q_filter_events(spark, sf_dir):
    """facets AND minimum level AND predicates as one pushed-down predicate."""
    state = FI.FilterState(facets={"tag": {"include": ["Purchase", "Error"]},
                                   "source": {"exclude": ["src1"]}},
                           minimum_level="warn", predicates=[("duration_ms", ">", "50")])
    return FI.apply_filter(T.load_events(spark, sf_dir), state).select("event_id")


@register("correlation_filter", EV + f"""
SELECT event_id FROM ev WHERE {O.CORR_SQL} = ''
""")
def q_correlation_filter(spark, sf_dir):
    """exact correlation match; an empty session id is a present correlation."""
    return FI.apply_filter(T.load_events(spark, sf_dir), FI.FilterState(correlation="")).select("event_id")


# ---------------------------------------------------------------- F7 / F8 search
def _doc_sql(base: str) -> str:
    return f"""{base},
fe AS (SELECT event_id, string_agg(j.key || ' ' || j.value, ' ' ORDER BY j.key) AS kv
       FROM ev, json_each(ev.fields) j GROUP BY event_id),
docs AS (SELECT ev.*, translate(concat_ws(' ', '', message, event, subsystem, source, {O.CORR_SQL},
                    target, provider, error_kind, status, fe.kv), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS doc
         FROM ev LEFT JOIN fe USING (event_id))
"""


def _term_sql(term: str, fuzzy: bool = True) -> str:
    exact = f"contains(doc, '{term}')"
    n = len(term.encode())
    if not fuzzy or n < 4 or n > 64:
        return exact
    k = 2 if n >= 8 else 1
    return (f"({exact} OR len(list_filter(regexp_split_to_array(doc, '[^\\pL\\pN]+'), "
            f"lambda w: strlen(w) > 0 AND strlen(w) <= 64 AND abs(strlen(w) - {n}) <= {k} "
            f"AND levenshtein(w, '{term}') <= {k})) > 0)")


@register("search_events", _doc_sql("WITH " + O.EV_BASE.strip()) + f"""
SELECT event_id FROM docs WHERE {_term_sql('purchase')} AND {_term_sql('req')} AND {_term_sql('u1')}
""")
def q_search_events(spark, sf_dir):
    """every term must occur in the event's lower-cased search document."""
    return FI.search(T.load_events(spark, sf_dir), "Purchase REQ-, u1").select("event_id")


_FUZZY_TEXT = "Orantoin, thanedbel nichts!"


@register("fuzzy_search_documents", _doc_sql("WITH " + O.DOC_BASE.strip()) + f"""
SELECT event_id FROM docs WHERE {" AND ".join(_term_sql(t) for t in FI.search_terms(_FUZZY_TEXT))}
""")
def q_fuzzy_search_documents(spark, sf_dir):
    """F8: typo-tolerant search over whole document texts (1 edit, 2 from 8 bytes)."""
    return FI.search(T.load_documents(spark, sf_dir), _FUZZY_TEXT).select("event_id")


@register("search_since", _doc_sql("WITH " + O.DOC_BASE.strip()) + f"""
SELECT event_id FROM docs WHERE event_id > 50 AND {_term_sql('einkeit')}
""")
def q_search_since(spark, sf_dir):
    """search restricted to rows ingested after a position."""
    return FI.search_since(T.load_documents(spark, sf_dir), "einkeit", 50).select("event_id")


# ---------------------------------------------------------------- sessions A5-A7 J1 J2 O4 O5 A9
from logspark.operators import navigation as NV  # noqa: E402
from logspark.operators import repeats as RP  # noqa: E402
from logspark.operators import sessions as SE  # noqa: E402

RUN_A, RUN_B = "1-2024-01-01", "2-2024-01-01"
_SESS_BASE = f""",
b AS (SELECT *, {O.CORR_SQL} AS corr, {O.STATUS_TEXT_SQL} AS st FROM ev)"""
_LAST_STATUS_SQL = "arg_max(st, CAST(epoch_us(\"timestamp\") AS HUGEINT) * 10000000000000 + event_id) FILTER (WHERE st <> '-')"


def _ms(col: str):
    return F.unix_millis(col)


@register("session_summaries", EV + _SESS_BASE + f"""
SELECT app_session_id, (epoch_us(min("timestamp")) // 1000) AS first_ms, (epoch_us(max("timestamp")) // 1000) AS last_ms,
  greatest((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 1000, 0) AS elapsed_ms,
  count(*) AS event_count, count(*) FILTER (WHERE level = 'warn') AS warning_count,
  count(*) FILTER (WHERE level IN ('error', 'fatal')) AS error_count,
  coalesce(string_agg(DISTINCT nullif(provider, ''), ',' ORDER BY nullif(provider, '')), '') AS providers,
  count(DISTINCT CASE WHEN corr <> app_session_id AND corr <> '' THEN corr END) AS correlation_count,
  {_LAST_STATUS_SQL} AS status
FROM b GROUP BY app_session_id
""")
def q_session_summaries(spark, sf_dir):
    """A5 + A7 + O4: run summaries, newest run first."""
    s = SE.order_sessions(SE.session_summaries(T.load_events(spark, sf_dir)))
    return s.select("app_session_id", _ms("first_timestamp").alias("first_ms"),
                    _ms("last_timestamp").alias("last_ms"), "elapsed_ms", "event_count", "warning_count",
                    "error_count", F.array_join("providers", ",").alias("providers"), "correlation_count",
                    "status")


_EVENT_SUMMARY_SQL = f"""
SELECT app_session_id, event, count(*) AS count,
  count(*) FILTER (WHERE level = 'warn') AS warning_count,
  count(*) FILTER (WHERE level IN ('error', 'fatal')) AS error_count,
  round(coalesce(sum(duration_ms), 0.0), 6) AS duration_total_ms, count(duration_ms) AS duration_count,
  max(duration_ms) AS max_duration_ms,
  round(CASE WHEN count(duration_ms) > 0 THEN sum(duration_ms) / count(duration_ms) END, 6) AS average_duration_ms,
  {_LAST_STATUS_SQL} AS status
FROM b"""


@register("session_event_summaries", EV + _SESS_BASE + _EVENT_SUMMARY_SQL + " GROUP BY app_session_id, event")
def q_session_event_summaries(spark, sf_dir):
    """Per (run, event) counts, durations and last status."""
    # sums of doubles are rounded to 6 decimals so engines with other summation orders agree
    return SE.session_event_summaries(T.load_events(spark, sf_dir)).select(
        "app_session_id", "event", "count", "warning_count", "error_count",
        F.round("duration_total_ms", 6).alias("duration_total_ms"), "duration_count", "max_duration_ms",
        F.round("average_duration_ms", 6).alias("average_duration_ms"), "status")


def _compare_sql(base: str, run_a: str, run_b: str) -> str:
    RUN_A, RUN_B = run_a, run_b
    return base + _SESS_BASE + f""",
s AS ({_EVENT_SUMMARY_SQL} WHERE app_session_id IN ('{RUN_A}', '{RUN_B}') GROUP BY app_session_id, event),
a AS (SELECT * FROM s WHERE app_session_id = '{RUN_A}'),
bb AS (SELECT * FROM s WHERE app_session_id = '{RUN_B}'),
j AS (
  SELECT coalesce(a.event, bb.event) AS event,
    coalesce(a.count, 0) AS count_a, coalesce(bb.count, 0) AS count_b,
    coalesce(a.warning_count, 0) AS warnings_a, coalesce(bb.warning_count, 0) AS warnings_b,
    coalesce(a.error_count, 0) AS errors_a, coalesce(bb.error_count, 0) AS errors_b,
    a.average_duration_ms AS average_duration_a, bb.average_duration_ms AS average_duration_b,
    a.max_duration_ms AS max_duration_a, bb.max_duration_ms AS max_duration_b,
    a.status AS status_a, bb.status AS status_b
  FROM a FULL OUTER JOIN bb ON a.event = bb.event)
SELECT *, (count_a <> count_b OR warnings_a <> warnings_b OR errors_a <> errors_b
   OR status_a IS DISTINCT FROM status_b
   OR CASE WHEN average_duration_a IS NOT NULL AND average_duration_b IS NOT NULL
           THEN abs(average_duration_a - average_duration_b) >= 1.0
           ELSE (average_duration_a IS NULL) <> (average_duration_b IS NULL) END
   OR CASE WHEN max_duration_a IS NOT NULL AND max_duration_b IS NOT NULL
           THEN abs(max_duration_a - max_duration_b) >= 1.0
           ELSE (max_duration_a IS NULL) <> (max_duration_b IS NULL) END) AS differs
FROM j
"""


@register("compare_sessions", _compare_sql(EV, RUN_A, RUN_B))
def q_compare_sessions(spark, sf_dir):
    """J2 + O5: two runs matched on event name, differing rows first."""
    return _rounded_compare(SE.compare_sessions(T.load_events(spark, sf_dir), RUN_A, RUN_B))


@register("compare_conversations", _compare_sql(CONV, "conv-0", "conv-1"))
def q_compare_conversations(spark, sf_dir):
    """J2 over two conversation runs (turn roles as event names)."""
    return _rounded_compare(SE.compare_sessions(T.load_conversations(spark, sf_dir), "conv-0", "conv-1"))


def _rounded_compare(cmp):
    """Comparison rows with averaged durations rounded to 6 decimals (engine-independent)."""
    return (cmp.drop("missing_side", "error_delta", "count_delta")
               .withColumns({"average_duration_a": F.round("average_duration_a", 6),
                             "average_duration_b": F.round("average_duration_b", 6)}))


@register("run_comparison_totals", EV + _SESS_BASE + f""",
s AS (SELECT app_session_id, count(*) AS n, count(*) FILTER (WHERE level IN ('error','fatal')) AS e,
        greatest((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 1000, 0) AS el
      FROM b WHERE app_session_id IN ('{RUN_A}', '{RUN_B}') GROUP BY app_session_id),
es AS (SELECT app_session_id, event, count(*) AS c, count(*) FILTER (WHERE level = 'warn') AS w,
        count(*) FILTER (WHERE level IN ('error','fatal')) AS e,
        CASE WHEN count(duration_ms) > 0 THEN sum(duration_ms) / count(duration_ms) END AS av,
        max(duration_ms) AS mx, {_LAST_STATUS_SQL} AS status
       FROM b WHERE app_session_id IN ('{RUN_A}', '{RUN_B}') GROUP BY app_session_id, event),
a AS (SELECT * FROM es WHERE app_session_id = '{RUN_A}'),
bb AS (SELECT * FROM es WHERE app_session_id = '{RUN_B}'),
d AS (SELECT count(*) FILTER (WHERE coalesce(a.c,0) <> coalesce(bb.c,0) OR coalesce(a.w,0) <> coalesce(bb.w,0)
        OR coalesce(a.e,0) <> coalesce(bb.e,0) OR a.status IS DISTINCT FROM bb.status
        OR CASE WHEN a.av IS NOT NULL AND bb.av IS NOT NULL THEN abs(a.av - bb.av) >= 1.0 ELSE (a.av IS NULL) <> (bb.av IS NULL) END
        OR CASE WHEN a.mx IS NOT NULL AND bb.mx IS NOT NULL THEN abs(a.mx - bb.mx) >= 1.0 ELSE (a.mx IS NULL) <> (bb.mx IS NULL) END)
        AS differing_events
      FROM a FULL OUTER JOIN bb ON a.event = bb.event)
SELECT max(CASE WHEN app_session_id = '{RUN_A}' THEN n END) AS events_a,
       max(CASE WHEN app_session_id = '{RUN_B}' THEN n END) AS events_b,
       max(CASE WHEN app_session_id = '{RUN_A}' THEN e END) AS errors_a,
       max(CASE WHEN app_session_id = '{RUN_B}' THEN e END) AS errors_b,
       max(CASE WHEN app_session_id = '{RUN_A}' THEN el END) AS elapsed_ms_a,
       max(CASE WHEN app_session_id = '{RUN_B}' THEN el END) AS elapsed_ms_b,
       (SELECT differing_events FROM d) AS differing_events
FROM s
""")
def q_run_comparison_totals(spark, sf_dir):
    """Totals of two runs and the number of differing event types."""
    return SE.run_comparison_totals(T.load_events(spark, sf_dir), RUN_A, RUN_B)


_REL_TEXT_SQL = """CASE WHEN abs(r) < 60000 THEN (CASE WHEN r < 0 THEN '-' ELSE '+' END) || printf('%.3fs', abs(r) / 1000.0)
  WHEN abs(r) < 3600000 THEN (CASE WHEN r < 0 THEN '-' ELSE '+' END) || CAST(abs(r) // 60000 AS VARCHAR) || 'm '
       || printf('%.3fs', (abs(r) % 60000) / 1000.0)
  ELSE (CASE WHEN r < 0 THEN '-' ELSE '+' END) || CAST(abs(r) // 3600000 AS VARCHAR) || 'h '
       || lpad(CAST((abs(r) % 3600000) // 60000 AS VARCHAR), 2, '0') || 'm' END"""


@register("relative_time", EV + f""",
st AS (SELECT *, (epoch_us("timestamp") - epoch_us(min("timestamp") OVER (PARTITION BY app_session_id))) // 1000 AS r
       FROM ev)
SELECT event_id, r AS relative_ms, {_REL_TEXT_SQL} AS relative_text FROM st WHERE level IN ('warn', 'error')
""")
def q_relative_time(spark, sf_dir):
    """Offsets from the run start (start taken from all rows, view filtered)."""
    ev = T.load_events(spark, sf_dir)
    view = FI.apply_filter(ev, FI.FilterState(minimum_level="warn"))
    return SE.with_relative_time(view, ev).select("event_id", "relative_ms", "relative_text")


# ---------------------------------------------------------------- repeats P9 P10 A8 W1
_RK_SQL = f"""source, subsystem, event, coalesce(error_kind, '') AS rk_error_kind, {O.shape_sql('message')} AS rk_message,
  {O.shape_sql("coalesce(CASE WHEN json_type(fields, '$.stack') = 'VARCHAR' THEN json_extract_string(fields, '$.stack') END, "
               "CASE WHEN json_type(fields, '$.stack_trace') = 'VARCHAR' THEN json_extract_string(fields, '$.stack_trace') END, "
               "CASE WHEN json_type(fields, '$.error_stack') = 'VARCHAR' THEN json_extract_string(fields, '$.error_stack') END, '')")} AS rk_stack"""
_RK_COLS = "source, subsystem, event, rk_error_kind, rk_message, rk_stack"


def _repeat_groups_sql(base: str) -> str:
    return base + f""",
k AS (SELECT event_id, "timestamp", {_RK_SQL} FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY {_RK_COLS} ORDER BY event_id DESC) AS rn FROM k)
SELECT {_RK_COLS}, count(*) AS repeat_count, min(event_id) AS first_event_id,
  max(event_id) AS latest_event_id, max(CASE WHEN rn = 2 THEN event_id END) AS previous_event_id
FROM r GROUP BY {_RK_COLS}
"""


@register("repeat_groups", _repeat_groups_sql(EV.rstrip()))
def q_repeat_groups(spark, sf_dir):
    """A8 (P9 shapes, P10 keys): global repeat groups with first / previous / latest ids."""
    return RP.repeat_groups(T.load_events(spark, sf_dir)).select(
        *C.REPEAT_KEY_COLUMNS, "repeat_count", "first_event_id", "latest_event_id", "previous_event_id")


@register("repeat_groups_documents", _repeat_groups_sql(DOC.rstrip()))
def q_repeat_groups_documents(spark, sf_dir):
    """A8 over whole document texts: exact and near copies collapse by shape."""
    return RP.repeat_groups(T.load_documents(spark, sf_dir)).select(
        *C.REPEAT_KEY_COLUMNS, "repeat_count", "first_event_id", "latest_event_id", "previous_event_id")


_TS_TEXT_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S.%g') || ' +00:00'"


@register("repeat_representatives", EV + f""",
k AS (SELECT event_id, "timestamp", {_RK_SQL} FROM ev WHERE level IN ('warn', 'error', 'fatal')),
r AS (SELECT *, row_number() OVER (PARTITION BY {_RK_COLS} ORDER BY event_id DESC) AS rn,
        count(*) OVER (PARTITION BY {_RK_COLS}) AS n,
        first_value("timestamp") OVER (PARTITION BY {_RK_COLS} ORDER BY event_id) AS first_ts,
        lead("timestamp") OVER (PARTITION BY {_RK_COLS} ORDER BY event_id DESC) AS prev_ts FROM k)
SELECT event_id, n AS repeat_count,
  CASE WHEN n > 1 THEN 'Repeated ' || CAST(n AS VARCHAR) || ' times · first ' || {_TS_TEXT_SQL.format(c='first_ts')}
       || ' · last ' || coalesce({_TS_TEXT_SQL.format(c='prev_ts')}, 'unknown') END AS repeat_summary
FROM r WHERE rn = 1
""")
def q_repeat_representatives(spark, sf_dir):
    """Newest row per repeat key of a filtered view, with its summary text."""
    view = FI.apply_filter(T.load_events(spark, sf_dir), FI.FilterState(minimum_level="warn"))
    return RP.repeat_representatives(view).select("event_id", "repeat_count", "repeat_summary")


# ---------------------------------------------------------------- navigation W2 O1 O3 O6
@register("next_error", EV + """,
x AS (SELECT *, CASE WHEN level IN ('error', 'fatal') THEN event_id END AS e FROM ev)
SELECT event_id,
  coalesce(min(e) OVER (PARTITION BY app_session_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
           min(e) OVER (PARTITION BY app_session_id)) AS next_error_id,
  coalesce(max(e) OVER (PARTITION BY app_session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           max(e) OVER (PARTITION BY app_session_id)) AS previous_error_id
FROM x
""")
def q_next_error(spark, sf_dir):
    """Nearest next / previous error per row within its run, wrapping round the ends."""
    # block size only sets how rows are cut for the window; results do not depend on it
    return NV.error_neighbours(T.load_events(spark, sf_dir), block_size=256).select(
        "event_id", "next_error_id", "previous_error_id")


@register("keep_latest", EV + """
SELECT event_id, level FROM ev ORDER BY event_id DESC LIMIT 500
""")
def q_keep_latest(spark, sf_dir):
    """O1 + O3: the newest 500 rows by ingestion (a bounded latest-N view)."""
    return NV.keep_latest(T.load_events(spark, sf_dir), 500).select("event_id", "level")


@register("retention_report", EV + """
SELECT least(count(*), 500) AS retained, greatest(count(*) - 500, 0) AS discarded FROM ev
""")
def q_retention_report(spark, sf_dir):
    """O1: rows kept and discarded by a latest-500 window."""
    return NV.retention_report(T.load_events(spark, sf_dir), 500)


@register("latest_visible", EV + """
SELECT max(event_id) AS latest_event_id FROM ev WHERE level = 'error' AND source = 'src2'
""")
def q_latest_visible(spark, sf_dir):
    """Newest row passing a filter."""
    state = FI.FilterState(facets={"level": {"include": ["error"]}, "source": {"include": ["src2"]}})
    return NV.latest_visible(T.load_events(spark, sf_dir), FI.filter_column(state))


# ---------------------------------------------------------------- export / pins K1 P19 J3 W3 K2
from logspark.operators import pins as PN  # noqa: E402
from logspark.sources import export as EX  # noqa: E402


@register("export_events", EV + f"""
SELECT event_id, {O.export_line_sql()} AS line FROM ev WHERE level IN ('warn', 'error')
""")
def q_export_events(spark, sf_dir):
    """K1: normalised JSONL lines of a filtered view (declared key order, epoch-ms time)."""
    view = FI.apply_filter(T.load_events(spark, sf_dir), FI.FilterState(minimum_level="warn"))
    return EX.with_export_line(view).select("event_id", "line")


@register("export_documents", DOC + f"""
SELECT event_id, {O.export_line_sql()} AS line FROM ev
""")
def q_export_documents(spark, sf_dir):
    """K1 over whole document texts (escaping of quotes, new lines and non-ASCII text)."""
    return EX.with_export_line(T.load_documents(spark, sf_dir)).select("event_id", "line")


@register("event_fingerprint", EV + f"""
SELECT event_id, {O.fingerprint_sql()} AS fingerprint FROM ev
""")
def q_event_fingerprint(spark, sf_dir):
    """Content key of every event."""
    return T.load_events(spark, sf_dir).select("event_id", EX.event_fingerprint().alias("fingerprint"))


_PINS_SQL = DOC.rstrip() + f""",
snap AS (SELECT ev.* REPLACE (CASE WHEN l.toxic = 1 THEN 'warn' ELSE ev.level END AS level), l.quality, l.toxic
         FROM ev JOIN labels l ON l.doc_id = ev.event_id),
pins AS (SELECT {O.fingerprint_sql('snap')} AS pin_key, {O.export_line_sql('snap')} AS event_json, "timestamp" AS event_time,
           'quality=' || CAST(quality AS VARCHAR) || ' toxic=' || CAST(toxic AS VARCHAR) AS note FROM snap),
keyed AS (SELECT {O.fingerprint_sql('ev')} AS pin_key, event_id, "timestamp" FROM ev),
hits AS (SELECT pin_key, min(event_id) AS matched_event_id FROM keyed GROUP BY pin_key),
located AS (SELECT p.*, p.event_time AS pin_ts, h.matched_event_id FROM pins p LEFT JOIN hits h ON h.pin_key = p.pin_key)
"""


@register("locate_pins", _PINS_SQL + """
SELECT pin_key, note, matched_event_id, matched_event_id IS NOT NULL AS retained FROM located
""")
def q_locate_pins(spark, sf_dir):
    """Pinned snapshots found again among all events; lost pins flagged."""
    pins = T.pins_from_labels(T.table(spark, sf_dir, "labels"), T.table(spark, sf_dir, "documents"))
    return PN.locate_pins(pins, T.load_documents(spark, sf_dir)).select(
        "pin_key", "note", "matched_event_id", "retained")


@register("pin_strip", _PINS_SQL + f""",
o AS (SELECT *, row_number() OVER w AS position,
        (epoch_us(pin_ts) - epoch_us(lag(pin_ts) OVER w)) // 1000 AS delta_ms,
        (epoch_us(max(pin_ts) OVER ()) - epoch_us(min(pin_ts) OVER ())) // 1000 AS span_ms,
        coalesce(lead(pin_key) OVER w, first_value(pin_key) OVER w2) AS next_pin,
        coalesce(lag(pin_key) OVER w, last_value(pin_key) OVER w2) AS previous_pin
      FROM located WINDOW w AS (ORDER BY pin_ts, pin_key, note),
                          w2 AS (ORDER BY pin_ts, pin_key, note ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT pin_key, position, delta_ms, span_ms, next_pin, previous_pin FROM o
""")
def q_pin_strip(spark, sf_dir):
    """All pins, retained or not, by the time of their snapshot with deltas, span and wrapped neighbours."""
    pins = T.pins_from_labels(T.table(spark, sf_dir, "labels"), T.table(spark, sf_dir, "documents"))
    located = PN.locate_pins(pins, T.load_documents(spark, sf_dir))
    return PN.pin_strip(located).select("pin_key", "position", "delta_ms", "span_ms", "next_pin", "previous_pin")


@register("lost_pins", _PINS_SQL + """
SELECT pin_key, note FROM located WHERE matched_event_id IS NULL
""")
def q_lost_pins(spark, sf_dir):
    """Pins whose event is no longer retained (anti join)."""
    pins = T.pins_from_labels(T.table(spark, sf_dir, "labels"), T.table(spark, sf_dir, "documents"))
    return PN.lost_pins(pins, T.load_documents(spark, sf_dir)).select("pin_key", "note")


# ---------------------------------------------------------------- ingest S2 S3 S4 S5 O2
from logspark.sources import jsonl as JL  # noqa: E402

LINES = EV.rstrip() + "," + O.LINES_CTE


def _lines(spark, sf_dir):
    return T.numbered_event_lines(T.table(spark, sf_dir, "events"))


@register("validate_events", LINES + """
SELECT file_name, line_number, row_number() OVER (ORDER BY file_name, line_number) - 1 AS event_id,
  CASE WHEN json_type(jv, '$.timestamp') = 'VARCHAR'
       THEN epoch_us(CAST(json_extract_string(jv, '$.timestamp') AS TIMESTAMPTZ)) // 1000
       ELSE CAST(json_extract(jv, '$.timestamp') AS BIGINT) END AS timestamp_ms,
  json_extract_string(jv, '$.level') AS level, json_extract_string(jv, '$.source') AS source,
  json_extract_string(jv, '$.app_session_id') AS app_session_id,
  json_extract_string(jv, '$.request_id') AS request_id,
  CAST(json_extract(jv, '$.duration_ms') AS DOUBLE) AS duration_ms
FROM parsed WHERE reason IS NULL
""")
def q_validate_events(spark, sf_dir):
    """S2 + O2: strict decode of JSONL lines into events numbered in (file, line) order."""
    ev = JL.validate_events(_lines(spark, sf_dir))
    return ev.select("file_name", "line_number", "event_id", F.unix_millis("timestamp").alias("timestamp_ms"),
                     "level", "source", "app_session_id", "request_id", "duration_ms")


@register("rejected_records", LINES + """
SELECT file_name, line_number, reason FROM parsed WHERE reason IS NOT NULL
""")
def q_rejected_records(spark, sf_dir):
    """S3: every invalid line with its file, line number and reason."""
    return JL.rejected_records(_lines(spark, sf_dir))


@register("ingest_report", LINES + """
SELECT file_name, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes, count(*) FILTER (WHERE reason IS NULL) AS valid,
  count(*) FILTER (WHERE reason IS NOT NULL) AS invalid,
  arg_max(reason, line_number) FILTER (WHERE reason IS NOT NULL) AS last_error
FROM parsed GROUP BY file_name
""")
def q_ingest_report(spark, sf_dir):
    """Bytes, valid / invalid counts and last error per source file."""
    return JL.ingest_report(_lines(spark, sf_dir))


EXPECTED_SOURCES = ["src0.jsonl", "src1.jsonl", "src2.jsonl", "src3.jsonl"]


@register("source_health", LINES + f""",
rep AS (SELECT file_name, count(*) FILTER (WHERE reason IS NULL) AS valid,
          count(*) FILTER (WHERE reason IS NOT NULL) AS invalid,
          arg_max(reason, line_number) FILTER (WHERE reason IS NOT NULL) AS last_error
        FROM parsed GROUP BY file_name),
exp AS (SELECT unnest({EXPECTED_SOURCES!r}) AS file_name)
SELECT coalesce(exp.file_name, rep.file_name) AS file_name,
  CASE WHEN rep.file_name IS NULL THEN 'missing' WHEN rep.invalid > 0 THEN 'parse errors' ELSE 'healthy' END AS state,
  CASE WHEN rep.file_name IS NULL THEN true WHEN rep.invalid > 0 THEN true ELSE false END AS problem,
  coalesce(rep.valid, 0) AS valid, coalesce(rep.invalid, 0) AS invalid, rep.last_error
FROM exp FULL OUTER JOIN rep ON exp.file_name = rep.file_name
""")
def q_source_health(spark, sf_dir):
    """Expected sources with state (healthy / parse errors / missing)."""
    return JL.source_health(JL.ingest_report(_lines(spark, sf_dir)), EXPECTED_SOURCES)


# ---------------------------------------------------------------- text P11 P12 P13 P15 P17 P20
from logspark.functions import redact as RD  # noqa: E402
from logspark.functions import tones as TN  # noqa: E402
from logspark.operators import quality as QL  # noqa: E402
from logspark.operators import saved as SV  # noqa: E402


def _tone_sql_pattern() -> str:
    import re as _re
    alts = "|".join("[ _\\-/.]+".join(_re.escape(w) for w in p.split(" ")) for p, _ in TN.PHRASES)
    return f"(?:^|[^\\pL\\pN])((?i:{alts}))(?:[^\\pL\\pN]|$)"


_TONE_TABLE_SQL = "tones(phrase, tone) AS (VALUES " + ", ".join(f"('{p}', '{t}')" for p, t in TN.PHRASES) + ")"


def _tone_hits_sql(base: str, keys: str) -> str:
    return base.rstrip() + f""",
{_TONE_TABLE_SQL},
h0 AS (SELECT {keys}, regexp_extract_all(regexp_replace(message, '([^\\pL\\pN])', '\\1\\1', 'g'),
          '{_tone_sql_pattern()}', 1) AS l FROM ev),
h AS (SELECT {keys}, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS hit FROM h0),
hp AS (SELECT h.*, regexp_replace(translate(hit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[ _\\-/.]+', ' ', 'g') AS phrase FROM h)
"""


@register("message_tones", _tone_hits_sql(EV, "event_id") + """
SELECT event_id, position, phrase, tone FROM hp JOIN tones USING (phrase)
""")
def q_message_tones(spark, sf_dir):
    """Every outcome phrase hit with its class (leftmost, non-overlapping, by priority)."""
    return TN.message_tones(T.load_events(spark, sf_dir)).select("event_id", "position", "phrase", "tone")


@register("message_tone_counts", _tone_hits_sql(DOC, "source") + """
SELECT source, tone, count(*) AS hits FROM hp JOIN tones USING (phrase) GROUP BY source, tone
""")
def q_message_tone_counts(spark, sf_dir):
    """Tone totals per source over whole document texts."""
    return TN.tone_counts(T.load_documents(spark, sf_dir), ["source"])


@register("conversation_tone_counts", _tone_hits_sql(CONV, "app_session_id, event") + """
SELECT app_session_id, event, tone, count(*) AS hits FROM hp JOIN tones USING (phrase)
GROUP BY app_session_id, event, tone
""")
def q_conversation_tone_counts(spark, sf_dir):
    """P13 per run and turn role over conversation texts."""
    return TN.tone_counts(T.load_conversations(spark, sf_dir), ["app_session_id", "event"])


_CONSOLE_SQL = EV.rstrip() + """,
con AS (
  SELECT event_id, 'click by user ' || split_part(app_session_id, '-', 1) AS message,
    '{"arguments": [{"name": "TypeError", "message": " value ' || printf('%.2f', duration_ms) || ' "}, {"message": "'
      || 'click by user ' || split_part(app_session_id, '-', 1) || '"}, {"name": "TypeError", "message": " value '
      || printf('%.2f', duration_ms) || ' "}, "plain text"]}' AS fields
  FROM ev WHERE event = 'user.click'),
args AS (SELECT event_id, message, CAST(json_extract(fields, '$.arguments') AS JSON[]) AS a FROM con),
d AS (SELECT event_id, list_transform(list_filter(a, lambda x: json_type(x) = 'OBJECT'
          AND json_type(x, '$.message') = 'VARCHAR' AND trim(json_extract_string(x, '$.message')) <> ''
          AND trim(json_extract_string(x, '$.message')) <> message),
        lambda x: CASE WHEN json_type(x, '$.name') = 'VARCHAR' AND trim(json_extract_string(x, '$.name')) <> ''
                       THEN trim(json_extract_string(x, '$.name')) || ': ' || trim(json_extract_string(x, '$.message'))
                       ELSE trim(json_extract_string(x, '$.message')) END) AS l FROM args)
"""


@register("console_detail", _CONSOLE_SQL + """
SELECT event_id, CASE WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' · ') END AS detail
FROM ev LEFT JOIN d USING (event_id)
""")
def q_console_detail(spark, sf_dir):
    """Distinct ``name: message`` details of console Error-like arguments, in order."""
    return T.console_frame(T.table(spark, sf_dir, "events")).select("event_id", C.console_detail().alias("detail"))


@register("infer_subsystem", EV + """
SELECT event_id, coalesce(nullif(regexp_replace(lower(trim(regexp_extract(message, '^\\[([^\\]]+)\\]', 1))),
  '[^a-z0-9]+', '_', 'g'), ''), 'renderer') AS inferred FROM ev
""")
def q_infer_subsystem(spark, sf_dir):
    """Subsystem from a leading ``[Name]`` (else ``renderer``)."""
    return T.load_events(spark, sf_dir).select("event_id", C.infer_subsystem().alias("inferred"))


@register("timestamp_text", EV + """
SELECT event_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%g') || ' +00:00' AS default_text,
  strftime("timestamp", '%H:%M:%S.%g') AS time_text, strftime("timestamp", '%d/%m/%Y %H:%M:%S') AS date_time_text,
  strftime("timestamp", '%m/%d/%Y %I:%M:%S %p') AS us_text FROM ev
""")
def q_timestamp_text(spark, sf_dir):
    """The display presets (full, time only, date + time, US 12-hour) in UTC."""
    ev = T.load_events(spark, sf_dir)
    return ev.select("event_id", C.timestamp_text("timestamp").alias("default_text"),
                     C.timestamp_text("timestamp", C.TIMESTAMP_PRESETS["time"]).alias("time_text"),
                     C.timestamp_text("timestamp", C.TIMESTAMP_PRESETS["date_time"]).alias("date_time_text"),
                     C.timestamp_text("timestamp", C.TIMESTAMP_PRESETS["us_12h"]).alias("us_text"))


@register("field_paths", EV + """
SELECT event_id, 'fields.' || j.key AS path,
  CASE WHEN length(v) <= 80 THEN v ELSE substr(v, 1, 79) || '…' END AS value
FROM (SELECT event_id, j.key, CASE WHEN j.type = 'VARCHAR' THEN json_extract_string(j.value, '$')
        ELSE CAST(j.value AS VARCHAR) END AS v, j FROM ev, json_each(ev.fields) j) x
""")
def q_field_paths(spark, sf_dir):
    """P20: one row per event and field path, value text cut to 80 characters."""
    return QL.field_paths(T.load_events(spark, sf_dir))


# ---------------------------------------------------------------- P4 P5 P6 P14 P16
_CLIENT_SQL = """
WITH ck AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
cr AS (SELECT event_id, ts AS "timestamp", event_type, k, user_id, value,
  CASE event_type WHEN 'error' THEN ' Critical ' WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'Information'
                  WHEN 'click' THEN 'log' ELSE 'Verbose' END AS raw_level,
  'app::' || event_type AS target, 'record ' || event_type AS name,
  'client-' || CAST(user_id % 2 AS VARCHAR) AS source, CAST(user_id AS VARCHAR) || '-run' AS app_session_id
  FROM ck)
"""
_LEVEL_SQL = ("CASE lower(trim(raw_level)) WHEN 'trace' THEN 'trace' WHEN 'verbose' THEN 'trace' WHEN 'debug' THEN 'debug' "
              "WHEN 'log' THEN 'info' WHEN 'info' THEN 'info' WHEN 'information' THEN 'info' WHEN 'warn' THEN 'warn' "
              "WHEN 'warning' THEN 'warn' WHEN 'error' THEN 'error' WHEN 'fatal' THEN 'fatal' WHEN 'critical' THEN 'fatal' "
              "ELSE 'info' END")


@register("redact_client_records", _CLIENT_SQL + """
SELECT event_id, '{"duration_ms":"' || printf('%.2f', value) || '",'
  || CASE WHEN event_type = 'purchase' THEN '"request_id":"req-' || CAST(k AS VARCHAR) || '",' ELSE '' END
  || CASE WHEN event_type = 'error' THEN '"event":"user.failure","error_kind":"io",' ELSE '' END
  || '"apiToken":"[REDACTED]","nested":{"cookie":"[REDACTED]","depth":{"secret":"[REDACTED]","ok":true}},"k":'
  || CAST(k AS VARCHAR) || ',"message":"value ' || printf('%.2f', value) || '"}' AS properties
FROM cr
""")
def q_redact_client_records(spark, sf_dir):
    """Sensitive keys redacted at every depth of producer property bags."""
    recs = T.client_records(T.table(spark, sf_dir, "events"))
    return recs.select("event_id", RD.redact_sensitive("properties").alias("properties"))


@register("promote_fields", _CLIENT_SQL + f"""
SELECT event_id, {_LEVEL_SQL} AS level, target AS subsystem,
  CASE WHEN event_type = 'error' THEN 'user.failure' ELSE name END AS event,
  'value ' || printf('%.2f', value) AS message,
  CASE WHEN event_type = 'purchase' THEN 'req-' || CAST(k AS VARCHAR) END AS request_id,
  CASE WHEN event_type = 'error' THEN 'io' END AS error_kind,
  CAST(printf('%.2f', value) AS DOUBLE) AS duration_ms,
  '{{"apiToken":"tok-' || CAST(k AS VARCHAR) || '","k":' || CAST(k AS VARCHAR) || ',"nested":{{"cookie":"c'
    || CAST(user_id AS VARCHAR) || '","depth":{{"ok":true,"secret":1}}}}}}' AS fields
FROM cr
""")
def q_promote_fields(spark, sf_dir):
    """P16 + P4: producer records lifted into event v1 (levels normalised, unknown -> info)."""
    recs = T.client_records(T.table(spark, sf_dir, "events"))
    recs = recs.withColumn("level", JL.normalize_level("raw_level", unknown="info"))
    return JL.promote_fields(recs).select("event_id", "level", "subsystem", "event", "message", "request_id",
                                          "error_kind", "duration_ms", "fields")


@register("normalize_values", EV + """
SELECT event_id,
  CASE WHEN _k < 50 THEN CAST(epoch_us("timestamp") // 1000 AS BIGINT)
       ELSE epoch_us(date_trunc('millisecond', "timestamp")) // 1000 END AS ts_ms,
  CASE WHEN _k % 2 = 0 THEN CAST(_k AS VARCHAR) ELSE app_session_id END AS identifier,
  CASE event_type WHEN 'error' THEN 'fatal' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'info'
                  WHEN 'click' THEN 'info' END AS level
FROM ev JOIN (SELECT event_id, event_type FROM events) USING (event_id)
""")
def q_normalize_values(spark, sf_dir):
    """P4 + P5 + P6: producer level names, epoch-ms / RFC 3339 texts, string-or-number ids."""
    raw = T.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ms_text = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").cast("string")
    rfc = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))
    ts_text = F.when(k < 50, ms_text).otherwise(rfc)
    sid = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))
    id_json = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), sid, F.lit('"')))
    et = F.col("event_type")
    raw_level = (F.when(et == "error", " CRITICAL").when(et == "purchase", "Warning")
                 .when(et == "view", "information").when(et == "click", "log").otherwise("nonsense"))
    return raw.select("event_id", F.unix_millis(JL.normalize_timestamp(ts_text)).alias("ts_ms"),
                      JL.normalize_identifier(id_json).alias("identifier"),
                      JL.normalize_level(raw_level).alias("level"))


# ---------------------------------------------------------------- A4 A10 A11 W5 F12 F13
@register("discover_field_facets", EV + """
SELECT DISTINCT 'fields.' || j.key AS facet FROM ev, json_each(ev.fields) j
WHERE j.type IN ('VARCHAR','BIGINT','UBIGINT','DOUBLE','BOOLEAN') ORDER BY facet LIMIT 20
""")
def q_discover_field_facets(spark, sf_dir):
    """A4: the first 20 ``fields.*`` facets in name order."""
    return FA.discover_field_facets(T.load_events(spark, sf_dir), 20)


@register("logging_loss_report", EV + """
SELECT source, app_session_id, event, count(*) AS reports,
  CAST(coalesce(sum(TRY_CAST(json_extract_string(fields, '$.count') AS BIGINT)), 0) AS BIGINT) AS lost
FROM ev WHERE event IN ('logger.events_dropped', 'logger.events_rejected') GROUP BY source, app_session_id, event
""")
def q_logging_loss_report(spark, sf_dir):
    """A10: producer-reported lost events per source and run."""
    return QL.logging_loss_report(T.load_events(spark, sf_dir))


@register("view_counts", EV + f""",
k AS (SELECT level, {_RK_SQL} FROM ev)
SELECT count(*) AS loaded, count(*) FILTER (WHERE level IN ('warn', 'error', 'fatal')) AS shown,
  count(DISTINCT ({_RK_COLS})) FILTER (WHERE level IN ('warn', 'error', 'fatal')) AS repeat_groups FROM k
""")
def q_view_counts(spark, sf_dir):
    """Loaded, shown and collapsed-group counts of a filtered view."""
    return QL.view_counts(T.load_events(spark, sf_dir), C.level_at_least("warn"))


_COUNTS_SQL = EV.rstrip() + f""",
base AS (SELECT *, {O.tag_sql()} AS tag, {O.CORR_SQL} AS corr, {O.LEVELS_SQL} AS sev FROM ev),
p AS ({_facet_union_sql("true", "true", "true")}),
c AS (SELECT facet, value, count(*) AS count FROM p WHERE value IS NOT NULL GROUP BY facet, value)
"""


@register("top_facet_values", _COUNTS_SQL + """
SELECT facet, value, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS rank FROM c) WHERE rank <= 3
""")
def q_top_facet_values(spark, sf_dir):
    """The 3 most frequent values per facet (a top-n report)."""
    return FA.top_facet_values(FA.facet_counts_all(T.load_events(spark, sf_dir), ordered=False), n=3)


@register("facet_value_search", _COUNTS_SQL + """
SELECT facet, value, count FROM c WHERE contains(lower(value), 'req-1')
""")
def q_facet_value_search(spark, sf_dir):
    """facet values containing a text (case-insensitive)."""
    return FA.facet_value_search(FA.facet_counts_all(T.load_events(spark, sf_dir), ordered=False), "REQ-1")


SAVED = {
    "errors": FI.FilterState(minimum_level="error"),
    "src0 purchases": FI.FilterState(facets={"source": {"include": ["src0"]}, "event": {"include": ["user.purchase"]}}),
    "slow views": FI.FilterState(facets={"tag": {"include": ["Ui Shell"]}}, predicates=[("duration_ms", ">", "300")]),
    "broken": FI.FilterState(predicates=[("level", ">", "warn")]),
}


@register("saved_filters", EV + f""",
b AS (SELECT *, {O.tag_sql()} AS tag FROM ev)
SELECT 'errors' AS name, count(*) FILTER (WHERE level IN ('error','fatal')) AS hits,
  min(event_id) FILTER (WHERE level IN ('error','fatal')) AS first_event_id,
  max(event_id) FILTER (WHERE level IN ('error','fatal')) AS last_event_id, NULL AS errors FROM b
UNION ALL
SELECT 'src0 purchases', count(*) FILTER (WHERE source = 'src0' AND event = 'user.purchase'),
  min(event_id) FILTER (WHERE source = 'src0' AND event = 'user.purchase'),
  max(event_id) FILTER (WHERE source = 'src0' AND event = 'user.purchase'), NULL FROM b
UNION ALL
SELECT 'slow views', count(*) FILTER (WHERE tag = 'Ui Shell' AND duration_ms > 300),
  min(event_id) FILTER (WHERE tag = 'Ui Shell' AND duration_ms > 300),
  max(event_id) FILTER (WHERE tag = 'Ui Shell' AND duration_ms > 300), NULL FROM b
UNION ALL
SELECT 'broken', 0, NULL, NULL, 'level expects a numeric value'
""")
def q_saved_filters(spark, sf_dir):
    """F13 + F5: a table of named filters evaluated in one scan; invalid ones match nothing."""
    return SV.evaluate_saved_filters(T.load_events(spark, sf_dir), SAVED).select(
        "name", "hits", "first_event_id", "last_event_id", "errors")


# ---------------------------------------------------------------- J4 J5 U1 U2 F10 K2
@register("correlation_trail", EV + f""",
b AS (SELECT *, {O.CORR_SQL} AS corr FROM ev)
SELECT event_id, corr AS correlation FROM b WHERE corr IN (SELECT corr FROM b WHERE event_id = 2)
""")
def q_correlation_trail(spark, sf_dir):
    """Every event sharing the correlation of event 2, in ingestion order."""
    return SV.correlation_trail(T.load_events(spark, sf_dir), 2).select("event_id", "correlation")


@register("filter_by_values", EV + """
SELECT event_id FROM ev
WHERE nullif(request_id, '') IN (SELECT request_id FROM ev WHERE duration_ms > 300 AND request_id IS NOT NULL)
""")
def q_filter_by_values(spark, sf_dir):
    """Include a facet's values given as a DataFrame (semi join) instead of a literal list."""
    ev = T.load_events(spark, sf_dir)
    values = ev.where((F.col("duration_ms") > 300) & F.col("request_id").isNotNull()).select(
        F.col("request_id").alias("value"))
    return FI.filter_by_values(ev, "request_id", values).select("event_id")


@register("exclude_by_values", EV + """
SELECT event_id FROM ev
WHERE app_session_id NOT IN (SELECT app_session_id FROM ev WHERE level = 'error')
""")
def q_exclude_by_values(spark, sf_dir):
    """Exclude every run that had an error (anti join on a value DataFrame)."""
    ev = T.load_events(spark, sf_dir)
    values = ev.where(F.col("level") == "error").select(F.col("app_session_id").alias("value"))
    return FI.filter_by_values(ev, "app_session_id", values, exclude=True).select("event_id")


@register("merge_sources", O.with_ctes(O.EV_BASE) + """,
d AS (SELECT source FROM documents), c AS (SELECT 'chat' AS source FROM conversations)
SELECT source, count(*) AS events, count(*) AS ids FROM (SELECT source FROM ev UNION ALL SELECT source FROM d
  UNION ALL SELECT source FROM c) GROUP BY source
""")
def q_merge_sources(spark, sf_dir):
    """Three sources merged into one event set (no de-duplication): events and distinct ids per source."""
    merged = SV.merge_events(T.load_events(spark, sf_dir), T.load_documents(spark, sf_dir),
                             T.load_conversations(spark, sf_dir))
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))


@register("combine_row_sets", EV + """
SELECT 'or' AS op, event_id FROM (SELECT event_id FROM ev WHERE level = 'error' UNION SELECT event_id FROM ev WHERE source = 'src0')
UNION ALL
SELECT 'and', event_id FROM (SELECT event_id FROM ev WHERE level = 'error' INTERSECT SELECT event_id FROM ev WHERE source = 'src0')
UNION ALL
SELECT 'and_not', event_id FROM (SELECT event_id FROM ev WHERE level = 'error' EXCEPT SELECT event_id FROM ev WHERE source = 'src0')
""")
def q_combine_row_sets(spark, sf_dir):
    """OR / AND / AND-NOT of two filtered row sets."""
    ev = T.load_events(spark, sf_dir)
    a, b = ev.where(F.col("level") == "error"), ev.where(F.col("source") == "src0")
    return SV.merge_sources(*[SV.combine_row_sets(a, b, op).select(F.lit(op).alias("op"), "event_id")
                              for op in ["or", "and", "and_not"]])


@register("view_session", EV + f"""
SELECT event_id FROM ev WHERE app_session_id = '{RUN_A}'
""")
def q_view_session(spark, sf_dir):
    """a fresh filter holding only one run."""
    return FI.apply_filter(T.load_events(spark, sf_dir), FI.view_session(RUN_A)).select("event_id")


_BUNDLE_FILTER = '{"facets":{},"minimum_level":null,"correlation":null,"text":""}'


@register("investigation_bundle", _PINS_SQL + f""",
o AS (SELECT row_number() OVER (ORDER BY pin_ts NULLS FIRST, pin_key, note) AS line_no, count(*) OVER () AS n,
        '{{"note":' || to_json(note) || ',"event":' || event_json || '}}' AS body FROM located)
SELECT 0 AS line_no, '{{"format":"logspark-investigation-v1","created_at":1704326400000,"sources":["documents"],"filter":'
  || '{_BUNDLE_FILTER}' || ',"pins":[' AS text
UNION ALL SELECT line_no, body || CASE WHEN line_no < n THEN ',' ELSE '' END FROM o
UNION ALL SELECT count(*) + 1, ']}}' FROM located
""")
def q_investigation_bundle(spark, sf_dir):
    """K2: pinned snapshots with notes, sources and filter as one JSON document."""
    pins = T.pins_from_labels(T.table(spark, sf_dir, "labels"), T.table(spark, sf_dir, "documents"))
    docs = T.load_documents(spark, sf_dir)
    located = PN.locate_pins(pins, docs)
    return EX.investigation_bundle(located, docs, ["documents"], _BUNDLE_FILTER, 1704326400000)


# ---------------------------------------------------------------- streaming S6 K3 T2-T6
from logspark.session import scratch_path  # noqa: E402
from logspark.streaming import segments as SG  # noqa: E402
from logspark.streaming import streams as ST  # noqa: E402


def _landing_events(spark, sf_dir, files: int | None = None) -> str:
    """Stand-in landing folder: the event rows as several closed Parquet files; without a number one a task."""
    path = scratch_path(spark, "landing-events")
    events = T.load_spread_events(spark, sf_dir)
    (events.repartition(files, "event_id") if files else events).write.parquet(path)
    return path


def _await(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


@register("stream_session_summaries", ORACLE["session_summaries"])
def q_stream_session_summaries(spark, sf_dir):
    """T3 + S6: running run summaries over micro-batches equal the batch summaries."""
    land = _landing_events(spark, sf_dir)
    out, pairs = scratch_path(spark, "stream-sessions"), scratch_path(spark, "stream-pairs")
    # the two streaming aggregates are independent: run them side by side
    keys, pair_keys = ["app_session_id"], ["app_session_id", "correlation"]
    running = [SG.keep_current(ST.stream_session_summaries(ST.stream_events(spark, land)), out, scratch_path(spark, "ckpt"), keys),
               SG.keep_current(ST.stream_session_correlations(ST.stream_events(spark, land)), pairs, scratch_path(spark, "ckpt"), pair_keys)]
    for q in running:
        _await(q)
    s = ST.session_summary_table(SG.current_values(spark, out, keys), SG.current_values(spark, pairs, pair_keys))
    return s.select("app_session_id", _ms("first_timestamp").alias("first_ms"), _ms("last_timestamp").alias("last_ms"),
                    SE._elapsed_ms(F.col("first_timestamp"), F.col("last_timestamp")).alias("elapsed_ms"),
                    "event_count", "warning_count", "error_count",
                    F.array_join("providers", ",").alias("providers"), "correlation_count", "status")


@register("stream_facet_counts", ORACLE["facet_counts_all"])
def q_stream_facet_counts(spark, sf_dir):
    """T4: facet counts kept current by a streaming aggregation."""
    events = ST.stream_events(spark, _landing_events(spark, sf_dir))
    out = scratch_path(spark, "stream-facets")
    _await(SG.keep_current(ST.stream_facet_counts(events, FLAGSHIP_STATE), out, scratch_path(spark, "ckpt"), ["facet", "value"]))
    return SG.current_values(spark, out, ["facet", "value"])


@register("stream_filter", ORACLE["filter_events"])
def q_stream_filter(spark, sf_dir):
    """T2 + K3: the active filter on new rows, delivered to a checkpointed Parquet sink."""
    state = FI.FilterState(facets={"tag": {"include": ["Purchase", "Error"]}, "source": {"exclude": ["src1"]}},
                           minimum_level="warn", predicates=[("duration_ms", ">", "50")])
    events = ST.stream_events(spark, _landing_events(spark, sf_dir))
    out = scratch_path(spark, "stream-filter")
    _await(ST.stream_to_sink(ST.stream_filter(events, state), out, scratch_path(spark, "ckpt")))
    return spark.read.parquet(out).select("event_id")


@register("stream_repeat_groups", ORACLE["repeat_groups"])
def q_stream_repeat_groups(spark, sf_dir):
    """T5: repeat groups of a stream; each of four batches writes its own groups, merged on reading."""
    events = ST.stream_events(spark, _landing_events(spark, sf_dir, files=4), max_files_per_trigger=1)
    table = scratch_path(spark, "stream-repeats")
    _await(SG.keep_repeat_groups(events, table, scratch_path(spark, "ckpt"), fanout=3))
    return SG.repeat_groups_now(spark, table).select(*C.REPEAT_KEY_COLUMNS, "repeat_count", "first_event_id",
                                                "latest_event_id", "previous_event_id")


@register("stream_keep_latest", ORACLE["keep_latest"])
def q_stream_keep_latest(spark, sf_dir):
    """The bounded latest-500 window maintained across micro-batches as a log of segments."""
    events = ST.stream_events(spark, _landing_events(spark, sf_dir, files=4), max_files_per_trigger=1)
    table = scratch_path(spark, "stream-latest")
    _await(SG.keep_newest(events, 500, table, scratch_path(spark, "ckpt")))
    return SG.newest_rows(spark, table, 500).select("event_id", "level")


# ---------------------------------------------------------------- S1 T1 T8 over text files, P18
def _landing_lines(spark, sf_dir) -> str:
    """Stand-in landing folder: one closed text file of JSONL lines per source, in event
    order, under ``source_file=<name>`` sub-folders."""
    path = scratch_path(spark, "landing-lines")
    T.write_log_files(T.table(spark, sf_dir, "events"), path)
    return path


def _part_files(spark, path: str) -> list[str]:
    jvm = spark._jvm
    glob = jvm.org.apache.hadoop.fs.Path(path + "/source_file=*/part-*")
    fs = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(st.getPath().toString() for st in fs.globStatus(glob))


def _source_of(path_col):
    return F.regexp_extract(path_col, "source_file=([^/]+)", 1)


@register("scan_event_logs", LINES + """
SELECT file_name, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes, count(*) FILTER (WHERE reason IS NULL) AS valid,
  count(*) FILTER (WHERE reason IS NOT NULL) AS invalid,
  arg_max(reason, line_number) FILTER (WHERE reason IS NOT NULL) AS last_error
FROM parsed GROUP BY file_name
""")
def q_scan_event_logs(spark, sf_dir):
    """S1 + S4: text files scanned with physical line numbers, then the ingest report."""
    lines = JL.read_event_logs(spark, _part_files(spark, _landing_lines(spark, sf_dir)))
    lines = lines.withColumn("file_name", _source_of(F.col("file_path")))
    return JL.ingest_report(lines)


@register("stream_validate", ORACLE["rejected_records"])
def q_stream_validate(spark, sf_dir):
    """T1 + S6: micro-batch validation of landing files; the side-reported rejects."""
    land = _landing_lines(spark, sf_dir)
    ev, rej, health = (scratch_path(spark, n) for n in ("stream-valid", "stream-rejects", "stream-health"))
    _await(ST.stream_validate(ST.stream_event_logs(spark, land), ev, rej, health, scratch_path(spark, "ckpt")))
    return spark.read.parquet(rej).select(_source_of(F.col("file_path")).alias("file_name"), "line_number", "reason")


@register("stream_health", LINES + """
SELECT file_name, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason IS NOT NULL) AS invalid
FROM parsed GROUP BY file_name
""")
def q_stream_health(spark, sf_dir):
    """Valid / invalid counters per source accumulated over micro-batches."""
    land = _landing_lines(spark, sf_dir)
    ev, rej, health = (scratch_path(spark, n) for n in ("stream-valid", "stream-rejects", "stream-health"))
    _await(ST.stream_validate(ST.stream_event_logs(spark, land), ev, rej, health, scratch_path(spark, "ckpt")))
    h = spark.read.parquet(health).withColumn("file_name", _source_of(F.col("file_path")))
    return h.groupBy("file_name").agg(F.sum("valid").alias("valid"), F.sum("invalid").alias("invalid"))


def _validated_stream(spark, sf_dir):
    """The valid events of the landing lines as a stream of their own."""
    ev, rej, health = (scratch_path(spark, n) for n in ("stream-valid", "stream-rejects", "stream-health"))
    lines = ST.stream_event_logs(spark, _landing_lines(spark, sf_dir))
    _await(ST.stream_validate(lines, ev, rej, health, scratch_path(spark, "ckpt")))
    return ST.stream_events(spark, ev)


@register("stream_chain_summaries", LINES + """
SELECT json_extract_string(jv, '$.app_session_id') AS app_session_id, count(*) AS event_count,
  count(*) FILTER (WHERE json_extract_string(jv, '$.level') = 'warn') AS warning_count,
  count(*) FILTER (WHERE json_extract_string(jv, '$.level') IN ('error', 'fatal')) AS error_count
FROM parsed WHERE reason IS NULL GROUP BY ALL
""")
def q_stream_chain_summaries(spark, sf_dir):
    """S6 -> T1 -> T3: landing lines validated by one stream, whose events another one summarises."""
    out = scratch_path(spark, "stream-sessions")
    summaries = ST.stream_session_summaries(_validated_stream(spark, sf_dir))
    _await(ST.run_aggregate_to_table(summaries, out, scratch_path(spark, "ckpt")))
    return ST.current_rows(spark, out, ["app_session_id"]).select(
        "app_session_id", "event_count", "warning_count", "error_count")


@register("stream_chain_latest", LINES + """
SELECT event_id FROM (SELECT row_number() OVER () - 1 AS event_id FROM parsed WHERE reason IS NULL)
ORDER BY event_id DESC LIMIT 500
""")
def q_stream_chain_latest(spark, sf_dir):
    """S6 -> T1 -> T6: the newest 500 of the validated stream by the ids that validation gave."""
    table = scratch_path(spark, "stream-latest")
    _await(ST.stream_keep_latest(_validated_stream(spark, sf_dir), 500, table, scratch_path(spark, "ckpt")))
    return ST.latest_table(spark, table).select("event_id")


def _late_counts(spark, sf_dir, delay):
    """Hourly counts of a stream to which every seventh event comes late, after all others."""
    events, land = T.load_events(spark, sf_dir), scratch_path(spark, "landing-late")
    out, ckpt = scratch_path(spark, "stream-windows"), scratch_path(spark, "ckpt")
    for late in (False, True):
        events.where((F.col("event_id") % 7 == 0) == late).write.mode("append").parquet(land)
        stream = ST.with_event_watermark(ST.stream_events(spark, land), delay)
        _await(ST.run_aggregate_to_table(ST.stream_window_counts(stream), out, ckpt))
    return ST.current_rows(spark, out, ["window_start", "source"]).select(
        _ms("window_start").alias("start_ms"), "source", "events")


_HOURLY = """
h AS (SELECT epoch_us(date_trunc('hour', "timestamp")) // 1000 AS start_ms, source, event_id % 7 = 0 AS late, "timestamp" FROM ev)
"""


@register("stream_late_kept", EV + "," + _HOURLY + """
SELECT start_ms, source, count(*) AS events FROM h GROUP BY ALL
""")
def q_stream_late_kept(spark, sf_dir):
    """Without a delay every late event is counted."""
    return _late_counts(spark, sf_dir, None)


@register("stream_late_dropped", EV + "," + _HOURLY + """
SELECT start_ms, source, count(*) AS events FROM h
WHERE NOT late OR start_ms + 3600000 > (SELECT max(epoch_us("timestamp") // 1000) FROM h WHERE NOT late) - 86400000
GROUP BY ALL
""")
def q_stream_late_dropped(spark, sf_dir):
    """With a delay of a day, late events of hours that ended longer ago are dropped."""
    return _late_counts(spark, sf_dir, "1 day")


@register("elapsed_text", EV + """
SELECT app_session_id, e AS elapsed_ms,
  CASE WHEN e < 1000 THEN CAST(e AS VARCHAR) || ' ms' WHEN e < 60000 THEN printf('%.1f s', e / 1000.0)
       ELSE CAST(e // 60000 AS VARCHAR) || 'm ' || lpad(CAST((e % 60000) // 1000 AS VARCHAR), 2, '0') || 's' END
    AS elapsed_text
FROM (SELECT app_session_id, greatest((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 1000, 0) AS e
      FROM ev GROUP BY app_session_id)
""")
def q_elapsed_text(spark, sf_dir):
    """Unsigned run durations as text (``n ms``, ``s.s s``, ``Mm SSs``)."""
    s = SE.session_summaries(T.load_events(spark, sf_dir))
    return s.select("app_session_id", "elapsed_ms", C.elapsed_text(F.col("elapsed_ms")).alias("elapsed_text"))


# ---------------------------------------------------------------- event store (S2 output layout)
from logspark.sources import store as SS  # noqa: E402


@register("event_store_search", _doc_sql("WITH " + O.EV_BASE.strip()) + f"""
SELECT event_id FROM docs WHERE source = 'src0' AND level IN ('warn', 'error', 'fatal') AND {_term_sql('refused')}
""")
def q_event_store_search(spark, sf_dir):
    """Events written once to the partitioned store (derived columns materialised), then a
    facet + level + search filter read back with partition pruning and pushed filters."""
    path = scratch_path(spark, "event-store")
    SS.write_event_store(T.load_spread_events(spark, sf_dir), path)
    state = FI.FilterState(facets={"source": {"include": ["src0"]}}, minimum_level="warn", text="refused")
    return FI.apply_filter(SS.read_event_store(spark, path), state).select("event_id")


def _stored_events(spark, sf_dir):
    """All events written to a new event store and read back."""
    path = scratch_path(spark, "event-store")
    SS.write_event_store(T.load_spread_events(spark, sf_dir), path)
    return SS.read_event_store(spark, path)


@register("event_store_correlation", EV + f"""
SELECT event_id FROM ev WHERE {O.CORR_SQL} = 'req-1'
""")
def q_event_store_correlation(spark, sf_dir):
    """F3 over the event store: the stored correlation, compared in the scan."""
    return FI.where_correlation(_stored_events(spark, sf_dir), "req-1").select("event_id")


@register("event_store_predicates", EV + """
SELECT event_id FROM ev WHERE duration_ms > 100 AND level <> 'info' AND json_extract_string(fields, '$.paid') = 'false'
""")
def q_event_store_predicates(spark, sf_dir):
    """F4 over the event store: duration and level compared in the scan, the JSON field after it."""
    preds = [("duration_ms", ">", "100"), ("level", "!=", "INFO"), ("fields.paid", "=", "FALSE")]
    return FI.where_predicates(_stored_events(spark, sf_dir), preds).select("event_id")


@register("event_store_time_window", ORACLE["time_window"])
def q_event_store_time_window(spark, sf_dir):
    """F6 over the event store: bounds on the time and on the partition day."""
    preds = [("timestamp", "=", "last-2d"), ("timestamp", "<", "2024-01-03T12:00:00Z")]
    return FI.where_predicates(_stored_events(spark, sf_dir), preds, now_ms=NOW_MS).select("event_id")


@register("order_latest", EV + """
SELECT event_id, row_number() OVER (ORDER BY event_id) AS position FROM ev WHERE level IN ('error', 'fatal')
""")
def q_order_latest(spark, sf_dir):
    """O3: an error view with the newest rows at the bottom, numbered in display order."""
    view = FI.apply_filter(T.load_events(spark, sf_dir), FI.FilterState(minimum_level="error"))
    ordered = NV.order_latest(view, "bottom").select("event_id")
    return JL.with_row_numbers(ordered, ["event_id"], name="position", start=1)


@register("stream_watermarked_filter", ORACLE["filter_events"])
def q_stream_watermarked_filter(spark, sf_dir):
    """T7 + T2: a stream with an event-time watermark; a stateless filter keeps every row,
    late or not (the watermark only bounds state of time-keyed operators)."""
    state = FI.FilterState(facets={"tag": {"include": ["Purchase", "Error"]}, "source": {"exclude": ["src1"]}},
                           minimum_level="warn", predicates=[("duration_ms", ">", "50")])
    events = ST.with_event_watermark(ST.stream_events(spark, _landing_events(spark, sf_dir)), "1 day")
    out = scratch_path(spark, "stream-watermark")
    _await(ST.stream_to_sink(ST.stream_filter(events, state), out, scratch_path(spark, "ckpt")))
    return spark.read.parquet(out).select("event_id")


# ---------------------------------------------------------------- S6 T8 growing files, S5 T8 source states
from logspark.streaming import follow as FO  # noqa: E402


def _followed(spark, sf_dir):
    """Files that grow, are truncated and replaced between three batches: (events, rejects, reports) folders."""
    events, land = T.table(spark, sf_dir, "events"), scratch_path(spark, "growing")
    out = [scratch_path(spark, n) for n in ("follow-events", "follow-rejects", "follow-reports")]
    ckpt = scratch_path(spark, "ckpt")
    names = ("src0.jsonl", T.TRUNCATED, T.REPLACED, "src3.jsonl")  # no one writes the last
    for phase in range(3):
        T.grow_log_files(events, land, phase)
        # small splits, so that several tasks read each file
        lines = FO.follow_event_logs(spark, [f"{land}/{n}" for n in names], split_bytes=1 << 18)
        _await(FO.stream_follow(lines, *out, ckpt))
    return out


_GENERATIONS = f"""
ph AS (SELECT *, event_id % 10 AS d, CASE WHEN file_name = '{T.REPLACED}' THEN CASE WHEN d < 2 THEN 0 WHEN d < 3 THEN 1 ELSE 2 END
         ELSE CASE WHEN d < 4 THEN 0 WHEN d < 8 THEN 1 ELSE 2 END END AS phase FROM parsed),
g AS (SELECT *, CASE WHEN file_name IN ('{T.TRUNCATED}', '{T.REPLACED}') AND phase = 2 THEN 1 ELSE 0 END AS generation FROM ph),
n AS (SELECT file_name, phase, generation, reason, row_number() OVER (PARTITION BY file_name, generation ORDER BY phase, event_id) AS line FROM g)
"""


@register("follow_growing_files", LINES + "," + _GENERATIONS + """
SELECT file_name, generation, line AS line_number, reason FROM n
""")
def q_follow_growing_files(spark, sf_dir):
    """S6 + T1: records of files that grow, are truncated and replaced, each under its generation and line."""
    events, rejects, _ = _followed(spark, sf_dir)
    cols = ["file_name", "generation", "line_number"]
    valid = spark.read.parquet(events).select(*cols, F.lit(None).cast("string").alias("reason"))
    return valid.unionByName(spark.read.parquet(rejects).select(*cols, "reason"))


def _track(spark, reports, out: str, ckpt: str) -> None:
    """The states that a streaming state machine keeps of a stream of reports, after those that are there now."""
    with FO.rocksdb_state(spark):
        query = ST.run_aggregate_to_table(FO.stream_source_states(reports), out, ckpt)
    _await(query)


@register("follow_source_states", LINES + "," + _GENERATIONS + f""",
c AS (SELECT file_name, count(*) FILTER (reason IS NOT NULL) AS parse_errors, count(*) FILTER (reason IS NULL) AS records,
        max(generation) AS rotations,
        arg_max('line ' || line || ': ' || reason, line) FILTER (reason IS NOT NULL AND generation = last) AS said
      FROM (SELECT *, max(generation) OVER (PARTITION BY file_name) AS last FROM n) GROUP BY file_name)
SELECT file_name, CASE WHEN rotations > 0 THEN 'rotated' ELSE 'tailing' END AS state, parse_errors, rotations::BIGINT AS rotations, records,
  coalesce(said, CASE WHEN rotations > 0 THEN '{FO.REPLACED}' END) AS detail FROM c
UNION ALL SELECT 'src3.jsonl', 'missing', 0, 0, 0, 'missing'
""")
def q_follow_source_states(spark, sf_dir):
    """States of followed files, kept by a state machine over the reports of the following query."""
    _, _, path = _followed(spark, sf_dir)
    reports = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = scratch_path(spark, "source-states")
    _track(spark, reports, out, scratch_path(spark, "ckpt"))
    return ST.current_rows(spark, out, ["file_path"]).select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), *FO.STATE_COLUMNS)


@register("source_states", f"""
WITH k AS (SELECT event_id, event_type AS t, 'src' || CAST(user_id % 3 AS VARCHAR) || '.jsonl' AS file_path,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
f AS (SELECT file_path, max(event_id) AS failed FROM k WHERE t = 'error' AND k < 30 GROUP BY file_path),
s AS (SELECT k.*, t = 'error' AND k < 30 AS e, t = 'signup' AND k < 30 AS c, t = 'purchase' AND k < 30 AS p
      FROM k LEFT JOIN f USING (file_path) WHERE failed IS NULL OR event_id >= failed)
SELECT file_path,
  coalesce(arg_max(CASE WHEN e THEN CASE WHEN k < 10 THEN 'missing' ELSE 'error' END WHEN p THEN 'rotated' ELSE 'tailing' END, event_id)
           FILTER (e OR c OR p), 'tailing') AS state,
  coalesce(sum(k % 3 + 1) FILTER (t = 'click'), 0)::BIGINT AS parse_errors, count(*) FILTER (p) AS rotations,
  coalesce(sum(k) FILTER (t = 'view'), 0)::BIGINT AS records,
  arg_max(CASE WHEN e THEN CASE WHEN k < 10 THEN 'missing' ELSE 'refused ' || k END WHEN c THEN '{FO.RECOVERED}' WHEN p THEN '{FO.REPLACED}'
               ELSE 'line ' || event_id || ': reason ' || k % 7 END, event_id) FILTER (e OR c OR p OR t = 'click') AS detail
FROM s GROUP BY file_path
""")
def q_source_states(spark, sf_dir):
    """States of sources with errors, recoveries and rotations after all their reports."""
    return FO.source_states(T.source_reports(T.table(spark, sf_dir, "events")), ["batch_id", "seq"])


@register("stream_source_states", ORACLE["source_states"])
def q_stream_source_states(spark, sf_dir):
    """The same states kept across micro-batches in a streaming state store."""
    reports = T.source_reports(T.spread_events(spark, sf_dir))
    land, out, ckpt = (scratch_path(spark, n) for n in ("landing-reports", "source-states", "ckpt"))
    for part in range(3):  # earlier reports come in earlier batches
        reports.where(F.least(F.floor(F.col("batch_id") / 4), F.lit(2)) == part).write.mode("append").parquet(land)
        _track(spark, spark.readStream.schema(reports.schema).parquet(land), out, ckpt)
    return ST.current_rows(spark, out, ["file_path"])


# ---------------------------------------------------------------- K1 P6 P7 P19 number text
_NUMBERS_SQL = """
WITH k AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT *, CASE event_id % 4 WHEN 0 THEN k || '.0' WHEN 1 THEN k || 'e2' WHEN 2 THEN '1234567890123456789' || k ELSE k || '.50' END AS written,
        CASE event_id % 4 WHEN 0 THEN k || '.0' WHEN 1 THEN (k * 100) || '.0' WHEN 2 THEN '1234567890123456789' || k ELSE k || '.5' END AS printed FROM k),
l AS (SELECT event_id AS line_number, k, printed,
        '{"schema_version":1,"timestamp":' || (epoch_us(ts) // 1000) || ',"level":"info","source":"numbers","subsystem":"s","event":"e","message":"m"'
        || ',"app_session_id":"' || printed || '","request_id":"' || written || '","status":' || printed
        || ',"fields":{"a":"' || written || '","n":[1,2],"z":' || printed || '}}' AS line FROM n)
"""


@register("number_texts", _NUMBERS_SQL + """
SELECT line_number, line, substr(sha256(line), 1, 16) AS fingerprint, printed AS status_text, printed AS z FROM l WHERE k <> 7
""")
def q_number_texts(spark, sf_dir):
    """K1 + P6 + P7 + P19: numbers in many spellings decoded, exported and fingerprinted without loss."""
    rows = JL.parse_event_lines(T.number_lines(T.spread_events(spark, sf_dir))).where("reason is null")
    return rows.select("line_number", EX.export_line().alias("line"), EX.event_fingerprint().alias("fingerprint"),
                       C.status_text().alias("status_text"), C.field_scalar("z").alias("z"))


@register("repeated_keys", _NUMBERS_SQL + """
SELECT line_number, CASE WHEN k = 7 THEN 'repeated field event' END AS reason FROM l
""")
def q_repeated_keys(spark, sf_dir):
    """S2 + S3: an undeclared key may repeat, a declared one may not."""
    return JL.parse_event_lines(T.number_lines(T.spread_events(spark, sf_dir))).select("line_number", "reason")


@register("next_error_whole_view", EV + """,
x AS (SELECT *, CASE WHEN level IN ('error', 'fatal') THEN event_id END AS e FROM ev)
SELECT event_id,
  coalesce(min(e) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(e) OVER ()) AS next_error_id,
  coalesce(max(e) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(e) OVER ()) AS previous_error_id
FROM x
""")
def q_next_error_whole_view(spark, sf_dir):
    """W2 over the whole view as one sequence, its blocks scanned in ranges."""
    return NV.error_neighbours(T.load_events(spark, sf_dir), partition_cols=(), block_size=256).select(
        "event_id", "next_error_id", "previous_error_id")


# ---------------------------------------------------------------- T6 pause, F8 by an index, F13 as a table
_PARTS = 5  # batches; a row's batch is its place among as many equal ranges of ids


@register("stream_pause_and_resume", EV + f""",
p AS (SELECT *, least(event_id * {_PARTS} // (SELECT max(event_id) + 1 FROM ev), {_PARTS - 1}) AS part FROM ev),
first AS (SELECT event_id FROM p WHERE part = 0 ORDER BY event_id DESC LIMIT 500)
SELECT 'paused' AS view, count(*) AS rows, min(event_id) AS first_event_id, max(event_id) AS last_event_id
FROM p WHERE part BETWEEN 1 AND 3 OR event_id IN (SELECT event_id FROM first)
UNION ALL
SELECT 'resumed', count(*), min(event_id), max(event_id) FROM (SELECT event_id FROM ev ORDER BY event_id DESC LIMIT 500)
""")
def q_stream_pause_and_resume(spark, sf_dir):
    """O1 + T6: a latest-500 window that is paused for three batches, which keeps all that came, and then resumed."""
    events, land, table, ckpt = T.load_events(spark, sf_dir), *(scratch_path(spark, n) for n in ("landing-parts", "stream-latest", "ckpt"))
    last = events.agg(F.max("event_id")).first()[0]
    views = []
    for part in range(_PARTS):
        place = F.least(F.floor(F.col("event_id") * _PARTS / F.lit(last + 1)), F.lit(_PARTS - 1))
        rows = events.where(place == part)
        if part == 0:  # what is older than the window when the pause begins is gone already
            rows = NV.keep_latest(rows, 500)
        rows.coalesce(1).write.mode("append").parquet(land)
        _await(SG.keep_newest(ST.stream_events(spark, land), 500, table, ckpt, paused=0 < part < _PARTS - 1))
        if part >= _PARTS - 2:
            rows = SG.newest_rows(spark, table, 500 if part == _PARTS - 1 else None)
            view = rows.agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"))
            views.append(view.select(F.lit("resumed" if part == _PARTS - 1 else "paused").alias("view"), "*"))
    return views[0].unionByName(views[1])


from logspark.operators import filter_table as FT  # noqa: E402
from logspark.operators import terms as TM  # noqa: E402

_INDEXED_TEXT = "Thanedbel, tion"  # the first with two letters in the wrong order


@register("indexed_search_documents", _doc_sql("WITH " + O.DOC_BASE.strip()) + f"""
SELECT event_id, source FROM docs WHERE {" AND ".join(_term_sql(t) for t in FI.search_terms(_INDEXED_TEXT))}
""")
def q_indexed_search_documents(spark, sf_dir):
    """F7 + F8 over whole document texts by the term index; the store's texts aren't read."""
    store, index = scratch_path(spark, "event-store"), scratch_path(spark, "term-index")
    SS.write_event_store(T.load_documents(spark, sf_dir), store)
    events = SS.read_event_store(spark, store)
    TM.write_term_index(events, index)
    return TM.search_indexed(events, index, _INDEXED_TEXT).select("event_id", "source")


def _many_filters(spark):
    """2000 saved filters: one a user and level, with a range, an exclusion or a correlation in turn."""
    out = {}
    for i in range(2000):
        state = FI.FilterState(facets={"fields.user": {"include": [f"u{i % 1000}", f"u{i % 1000 + 1}"]}})
        if i % 4 == 0:
            state.predicates = [("duration_ms", ">=", str(i % 90)), ("duration_ms", "<", str(i % 90 + 60))]
        elif i % 4 == 1:
            state.facets["source"] = {"exclude": [f"src{i % 3}"]}
        elif i % 4 == 2:
            state.minimum_level = "warn"
        else:
            state.facets = {"event": {"exclude": ["user.click"]}}
            state.correlation = f"req-{i % 100}"
        out[f"f{i:04d}"] = state
    out["broken"] = FI.FilterState(predicates=[("duration_ms", ">", "much")])
    return FT.filter_table(spark, out)


@register("saved_filter_table", EV + f""",
b AS (SELECT *, CAST(substr(json_extract_string(fields, '$.user'), 2) AS BIGINT) AS u, {O.CORR_SQL} AS corr, {O.LEVELS_SQL} AS sev FROM ev),
f AS (SELECT i, 'f' || lpad(CAST(i AS VARCHAR), 4, '0') AS name FROM range(2000) r(i)),
h AS (
  SELECT name, event_id FROM f JOIN b ON u IN (i % 1000, i % 1000 + 1) AND i % 4 < 3
   AND CASE i % 4 WHEN 0 THEN duration_ms >= i % 90 AND duration_ms < i % 90 + 60 WHEN 1 THEN source <> 'src' || (i % 3) ELSE sev >= 3 END
  UNION ALL SELECT name, event_id FROM f JOIN b ON corr = 'req-' || (i % 100) AND i % 4 = 3 AND event <> 'user.click')
SELECT f.name, count(h.event_id) AS hits, min(h.event_id) AS first_event_id, max(h.event_id) AS last_event_id, NULL::VARCHAR AS errors
FROM f LEFT JOIN h ON f.name = h.name GROUP BY f.name
UNION ALL SELECT 'broken', 0, NULL, NULL, 'duration_ms expects a numeric value'
""")
def q_saved_filter_table(spark, sf_dir):
    """F13 + F5: a table of 2001 saved filters evaluated together by predicate counting."""
    return FT.evaluate(T.load_spread_events(spark, sf_dir), _many_filters(spark))


# ---------------------------------------------------------------- P12 P13 over every phrase
_TONE_N = len(TN.PHRASES)
_TONE_BASE = f"""
WITH ph AS (SELECT [{", ".join(f"'{p}'" for p, _ in TN.PHRASES)}] AS l),
pk AS (SELECT event_id, 'src' || CAST(user_id % 3 AS VARCHAR) AS source, l[event_id % {_TONE_N} + 1] AS a, l[(event_id * 7 + 3) % {_TONE_N} + 1] AS b FROM events, ph),
ev AS (SELECT event_id, source, 'step ' || event_id || ' ' || CASE event_id % 5 WHEN 0 THEN upper(a) WHEN 1 THEN replace(a, ' ', '_') WHEN 2 THEN 'x' || a ELSE a END
         || ': ' || replace(b, ' ', ' - ') || '!' AS message FROM pk)"""


@register("message_tones_all_phrases", _tone_hits_sql(_TONE_BASE, "event_id") + """
SELECT event_id, position, phrase, tone FROM hp JOIN tones USING (phrase)
""")
def q_message_tones_all_phrases(spark, sf_dir):
    """Every outcome phrase, negated ones among them, in several spellings."""
    return TN.message_tones(T.tone_frame(T.table(spark, sf_dir, "events"))).select("event_id", "position", "phrase", "tone")


@register("tone_counts_all_phrases", _tone_hits_sql(_TONE_BASE, "source") + """
SELECT source, tone, count(*) AS hits FROM hp JOIN tones USING (phrase) GROUP BY source, tone
""")
def q_tone_counts_all_phrases(spark, sf_dir):
    """Totals of all four tones per source."""
    return TN.tone_counts(T.tone_frame(T.table(spark, sf_dir, "events")), ["source"])
