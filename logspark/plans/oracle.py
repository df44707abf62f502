"""DuckDB SQL building blocks for the correctness oracle.

The oracle rebuilds the same stand-in rows as ``sources/tables.py`` (input only) and then
computes each operator's answer with plain SQL, independently of the Spark code path.
"""

from __future__ import annotations

# Stand-in event frame from the ``events`` table (same rows as tables.events_frame).
EV_BASE = """
ev_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (
  SELECT
    event_id,
    1 AS schema_version,
    ts AS "timestamp",
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug'
                    WHEN 'click' THEN 'trace' ELSE 'info' END AS level,
    'src' || CAST(user_id % 3 AS VARCHAR) AS source,
    CASE event_type WHEN 'error' THEN 'backend.core_fault' WHEN 'purchase' THEN 'billing.remote'
                    WHEN 'view' THEN 'ui_shell.local' WHEN 'signup' THEN 'auth' ELSE 'ui_shell' END AS subsystem,
    CASE WHEN event_type = 'signup' AND k < 5 THEN 'logger.events_dropped' ELSE 'user.' || event_type END AS event,
    '[' || upper(event_type[1]) || lower(event_type[2:]) || '][Local] value ' || printf('%.2f', value)
        || ' for user ' || CAST(user_id AS VARCHAR) AS message,
    CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS app_session_id,
    CASE WHEN event_type = 'view' THEN 'pb-' || CAST(user_id AS VARCHAR) END AS playback_session_id,
    CASE WHEN event_type = 'purchase' THEN 'req-' || CAST(k AS VARCHAR) END AS request_id,
    CASE WHEN event_type = 'signup' THEN '' END AS session_id,
    CASE WHEN event_type = 'click' THEN 'ui' END AS target,
    CASE event_type WHEN 'purchase' THEN 'remote' WHEN 'view' THEN 'local' WHEN 'error' THEN '' END AS provider,
    CASE WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 'timeout' ELSE 'refused' END END AS error_kind,
    CASE WHEN event_type <> 'signup' THEN value END AS duration_ms,
    CASE event_type WHEN 'purchase' THEN '"completed"' WHEN 'error' THEN '"failed"' WHEN 'view' THEN '200'
                    WHEN 'click' THEN '{"code": 1}' END AS status,
    '{' || CASE WHEN event_type = 'signup' AND k < 5 THEN '"count": ' || CAST(k + 1 AS VARCHAR) || ', ' ELSE '' END
        || '"k": ' || CAST(k AS VARCHAR) || ', "paid": '
        || CASE WHEN event_type = 'purchase' THEN 'true' ELSE 'false' END
        || CASE WHEN event_type = 'error' THEN ', "stack": "at handler line ' || CAST(k AS VARCHAR) || '"' ELSE '' END
        || ', "user": "u' || CAST(user_id AS VARCHAR) || '"}' AS fields,
    k AS _k
  FROM ev_k
)"""

DOC_BASE = """
ev AS (
  SELECT
    doc_id AS event_id, 1 AS schema_version,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS "timestamp",
    'info' AS level, source, 'docs.' || lang AS subsystem, 'document.' || lang AS event,
    text AS message, source AS app_session_id,
    CAST(NULL AS VARCHAR) AS playback_session_id, CAST(NULL AS VARCHAR) AS request_id,
    CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS target,
    CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS error_kind,
    CAST(n_chars AS DOUBLE) AS duration_ms, CAST(NULL AS VARCHAR) AS status,
    '{"lang": "' || lang || '"}' AS fields
  FROM documents
)"""

CONV_BASE = """
ev AS (
  SELECT
    conv_id * 1000000 + turn AS event_id, 1 AS schema_version,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS "timestamp",
    CASE role WHEN 'user' THEN 'info' WHEN 'assistant' THEN 'debug' ELSE 'warn' END AS level,
    'chat' AS source, 'chat.' || role AS subsystem, 'turn.' || role AS event,
    text AS message, 'conv-' || CAST(conv_id AS VARCHAR) AS app_session_id,
    CAST(NULL AS VARCHAR) AS playback_session_id, CAST(NULL AS VARCHAR) AS request_id,
    CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS target,
    CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS error_kind,
    CAST(length(text) AS DOUBLE) AS duration_ms, CAST(NULL AS VARCHAR) AS status,
    '{}' AS fields
  FROM conversations
)"""

CTX = "['backend', 'frontend', 'local', 'remote', 'renderer', 'settings', 'sidecar']"
LEVELS_SQL = "CASE level WHEN 'trace' THEN 0 WHEN 'debug' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3 WHEN 'error' THEN 4 WHEN 'fatal' THEN 5 END"
CORR_SQL = "coalesce(playback_session_id, request_id, session_id, app_session_id)"
STATUS_SCALAR_SQL = ("CASE WHEN json_type(status) IN ('VARCHAR','BIGINT','UBIGINT','DOUBLE','BOOLEAN') "
                     "THEN json_extract_string(status, '$') END")
STATUS_TEXT_SQL = f"coalesce({STATUS_SCALAR_SQL}, '-')"


def tag_sql(message: str = "message", subsystem: str = "subsystem") -> str:
    segs = f"string_split({message}, '[')[2:]"
    stop = f"list_position(list_transform({segs}, lambda s: instr(s, ']') = 0), true)"
    taken = f"(CASE WHEN {stop} IS NULL THEN {segs} ELSE {segs}[1:{stop} - 1] END)"
    vals = (f"list_filter(list_transform({taken}, lambda s: regexp_replace(split_part(s, ']', 1), '^\\s+|\\s+$', '', 'g')), "
            f"lambda v: v <> '' AND length(v) <= 64)")
    from_msg = f"coalesce(list_filter({vals}, lambda v: NOT list_contains({CTX}, lower(v)))[1], {vals}[1])"
    parts = f"string_split({subsystem}, '.')"
    part = (f"coalesce(list_filter({parts}, lambda p: p <> '' AND NOT list_contains({CTX}, lower(p)))[1], "
            f"list_filter({parts}, lambda p: p <> '')[1], 'Other')")
    words = (f"array_to_string(list_transform(list_filter(string_split({part}, '_'), lambda w: w <> ''), "
             f"lambda w: upper(w[1]) || w[2:]), ' ')")
    return f"coalesce({from_msg}, {words})"


def shape_sql(col: str) -> str:
    return (f"lower(regexp_replace(regexp_replace(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'), "
            f"'[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))")


def with_ctes(base: str, *more: str) -> str:
    parts = [base.strip()] + [m.strip() for m in more]
    return "WITH " + ",\n".join(parts) + "\n"


def export_line_sql(t: str = "") -> str:
    """The normalised export line of an event row (columns of alias ``t``)."""
    p = f"{t}." if t else ""
    def js(c):
        return f"to_json({p}{c})"
    def opt(c):
        return f"coalesce(',\"{c}\":' || {js(c)}, '')"
    return ("'{\"schema_version\":' || CAST(" + p + "schema_version AS VARCHAR) || ',\"timestamp\":' || "
            f"CAST(epoch_us({p}\"timestamp\") // 1000 AS VARCHAR) || ',\"level\":' || {js('level')} || "
            f"',\"source\":' || {js('source')} || ',\"subsystem\":' || {js('subsystem')} || {opt('target')} || "
            f"',\"event\":' || {js('event')} || ',\"message\":' || {js('message')} || "
            f"',\"app_session_id\":' || {js('app_session_id')} || {opt('playback_session_id')} || "
            f"{opt('request_id')} || {opt('session_id')} || {opt('provider')} || "
            f"coalesce(',\"duration_ms\":' || CAST({p}duration_ms AS VARCHAR), '') || {opt('error_kind')} || "
            f"coalesce(',\"status\":' || CAST(json({p}status) AS VARCHAR), '') || "
            f"CASE WHEN CAST(json({p}fields) AS VARCHAR) <> '{{}}' THEN ',\"fields\":' || CAST(json({p}fields) AS VARCHAR) ELSE '' END || '}}'")


def fingerprint_sql(t: str = "") -> str:
    return f"substr(sha256({export_line_sql(t)}), 1, 16)"


# Stand-in JSONL lines (same text as tables.event_lines) with per-file line numbers.
LINES_CTE = """
lines0 AS (
  SELECT source || '.jsonl' AS file_name, event_id,
    '{"schema_version": ' || CASE WHEN _k = 2 THEN '2' ELSE '1' END
    || ', "timestamp": ' || CASE WHEN _k >= 10 AND _k < 30 THEN '"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || 'Z"'
                               ELSE CAST(epoch_us("timestamp") // 1000 AS VARCHAR) END
    || CASE WHEN _k = 1 THEN '' ELSE ', "level": ' || to_json(level) END
    || ', "source": ' || CASE WHEN _k = 4 THEN '""' ELSE to_json(source) END
    || ', "subsystem": ' || to_json(subsystem)
    || coalesce(', "target": ' || to_json(target), '')
    || ', "event": ' || to_json(event) || ', "message": ' || to_json(message)
    || ', "app_session_id": ' || to_json(app_session_id)
    || coalesce(', "playback_session_id": ' || to_json(playback_session_id), '')
    || coalesce(', "request_id": ' || CASE WHEN _k = 3 THEN 'true' ELSE to_json(request_id) END, '')
    || coalesce(', "session_id": ' || to_json(session_id), '')
    || coalesce(', "provider": ' || to_json(provider), '')
    || coalesce(', "duration_ms": ' || CASE WHEN _k = 5 THEN '-1.5' ELSE CAST(duration_ms AS VARCHAR) END, '')
    || coalesce(', "error_kind": ' || to_json(error_kind), '')
    || coalesce(', "status": ' || status, '')
    || ', "fields": ' || fields || ', "correlation_id": "x"}' AS body, _k
  FROM ev),
lines AS (
  SELECT file_name, event_id,
    row_number() OVER (PARTITION BY file_name ORDER BY event_id) AS line_number,
    CASE WHEN _k = 0 THEN substr(body, 1, 40) WHEN _k = 6 THEN body || ' trailing' ELSE body END AS value
  FROM lines0),
jt AS (
  SELECT *, json_valid(value) AS ok,
    json_type(jv) AS t_obj,
    json_type(jv, '$.schema_version') AS t_ver,
    json_type(jv, '$.timestamp') AS t_ts,
    json_type(jv, '$.level') AS t_level,
    json_type(jv, '$.source') AS t_source,
    json_type(jv, '$.subsystem') AS t_sub,
    json_type(jv, '$.target') AS t_target,
    json_type(jv, '$.event') AS t_event,
    json_type(jv, '$.message') AS t_msg,
    json_type(jv, '$.app_session_id') AS t_app,
    json_type(jv, '$.playback_session_id') AS t_pb,
    json_type(jv, '$.request_id') AS t_req,
    json_type(jv, '$.session_id') AS t_sess,
    json_type(jv, '$.provider') AS t_prov,
    json_type(jv, '$.duration_ms') AS t_dur,
    json_type(jv, '$.error_kind') AS t_ek,
    json_type(jv, '$.fields') AS t_fields
  FROM (SELECT *, CASE WHEN json_valid(value) THEN value END AS jv FROM lines) l),
parsed AS (
  SELECT *,
    CASE
      WHEN NOT ok THEN 'invalid JSON'
      WHEN t_obj <> 'OBJECT' THEN 'not a JSON object'
      WHEN t_ver IS NULL THEN 'missing field schema_version'
      WHEN t_ver NOT IN ('BIGINT', 'UBIGINT') OR CAST(json_extract(jv, '$.schema_version') AS VARCHAR) <> '1' THEN 'unsupported schema_version'
      WHEN t_ts IS NULL THEN 'missing field timestamp'
      WHEN NOT ((t_ts IN ('BIGINT', 'UBIGINT')) OR (t_ts = 'VARCHAR' AND regexp_matches(json_extract_string(jv, '$.timestamp'),
            '^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$')))
        THEN 'timestamp: neither epoch milliseconds nor RFC 3339'
      WHEN t_level IS NULL THEN 'missing field level'
      WHEN t_level <> 'VARCHAR' OR json_extract_string(jv, '$.level') NOT IN ('trace','debug','info','warn','error','fatal') THEN 'level: unknown level'
      WHEN t_source IS NULL THEN 'missing field source'
      WHEN t_source <> 'VARCHAR' OR json_extract_string(jv, '$.source') = '' THEN 'source: must be text and not empty'
      WHEN t_sub IS NULL THEN 'missing field subsystem'
      WHEN t_sub <> 'VARCHAR' OR json_extract_string(jv, '$.subsystem') = '' THEN 'subsystem: must be text and not empty'
      WHEN t_target IS NOT NULL AND t_target NOT IN ('NULL', 'VARCHAR') THEN 'target: expected a string'
      WHEN t_event IS NULL THEN 'missing field event'
      WHEN t_event <> 'VARCHAR' OR json_extract_string(jv, '$.event') = '' THEN 'event: must be text and not empty'
      WHEN t_msg IS NULL THEN 'missing field message'
      WHEN t_msg <> 'VARCHAR' THEN 'message: expected a string'
      WHEN t_app IS NULL THEN 'missing field app_session_id'
      WHEN t_app NOT IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') OR json_extract_string(jv, '$.app_session_id') = ''
        THEN 'app_session_id: must be a number or text and not empty'
      WHEN t_pb IS NOT NULL AND t_pb NOT IN ('NULL', 'VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'playback_session_id: must be text, a number or null'
      WHEN t_req IS NOT NULL AND t_req NOT IN ('NULL', 'VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'request_id: must be text, a number or null'
      WHEN t_sess IS NOT NULL AND t_sess NOT IN ('NULL', 'VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'session_id: must be text, a number or null'
      WHEN t_prov IS NOT NULL AND t_prov NOT IN ('NULL', 'VARCHAR') THEN 'provider: expected a string'
      WHEN t_dur IS NOT NULL AND t_dur <> 'NULL' AND (t_dur NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE')
           OR CAST(json_extract(jv, '$.duration_ms') AS DOUBLE) < 0) THEN 'duration_ms: must be a number from zero up'
      WHEN t_ek IS NOT NULL AND t_ek NOT IN ('NULL', 'VARCHAR') THEN 'error_kind: expected a string'
      WHEN t_fields IS NOT NULL AND t_fields <> 'OBJECT' THEN 'fields: expected an object'
    END AS reason
  FROM jt)"""
