"""Message tones (P12, P13): outcome phrases found in message text.

All leftmost, non-overlapping phrases are found by one JVM regular expression: an ordered
alternation (list order is priority, so "not found" wins over "found"), word-bounded on
both sides, ASCII case-insensitive, words of a phrase joined by runs of blank ``_ - / .``.
Each hit maps back to its class through a broadcast join with the fixed phrase table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrase list and its tone classes, in priority order (longer / negated
# phrases first so "not found" is not read as "found").
NEGATIVE = [
    "not found", "not configured", "not initialized", "not connected", "not ready", "not authorized",
    "not supported", "not implemented", "no results", "no response", "no data", "no connection",
    "no match", "not available", "access denied", "permission denied", "connection refused",
    "connection failed", "network error", "request failed", "operation failed", "validation failed",
    "authentication failed", "authentication required", "service unavailable", "out of memory",
    "out of space", "timed out", "could not", "unable to", "failed", "failure", "error", "fatal",
    "exception", "panic", "crashed", "aborted", "cancelled", "canceled", "denied", "forbidden",
    "unauthorized", "rejected", "invalid", "missing", "unavailable", "disconnected", "offline",
    "corrupted", "mismatch", "blocked", "exceeded", "expired", "timeout", "unsupported",
    "unreachable", "overloaded", "malformed", "duplicate",
]
WARNING = [
    "warning", "warn", "retrying", "retry", "delayed", "pending", "partial", "skipped", "deprecated",
    "rate limited", "throttled", "in progress", "waiting", "paused", "degraded", "limited",
    "fallback", "ignored", "unchanged", "slow",
]
POSITIVE = [
    "successfully", "successful", "succeeded", "completed", "complete", "connected", "available",
    "validated", "verified", "detected", "resolved", "recovered", "accepted", "authorized",
    "enabled", "ready", "healthy", "initialized", "configured", "registered", "synchronized",
    "synced", "imported", "exported", "uploaded", "downloaded", "installed", "cleared", "removed",
    "released", "found", "success", "passed", "done", "created", "saved", "loaded", "started",
]
ACTIVITY = [
    "triggered", "trigger", "attempting", "initiated", "scheduled", "dispatching", "dispatched",
    "enqueued", "processing", "running", "queued", "received", "sending", "fetching", "searching",
    "scanning", "updating", "reloading", "listening", "watching", "discovering", "connecting",
]
# End of fixed values.

PHRASES = ([(p, "negative") for p in NEGATIVE] + [(p, "warning") for p in WARNING]
           + [(p, "positive") for p in POSITIVE] + [(p, "activity") for p in ACTIVITY])
SEPARATOR = r"[ _\-/.]+"
_WORD = r"\p{IsAlphabetic}\p{N}"


def phrase_pattern() -> str:
    """One ordered alternation; ``(?i)`` in Java folds ASCII case only."""
    alts = "|".join(SEPARATOR.join(re.escape(w) for w in p.split(" ")) for p, _ in PHRASES)
    return rf"(?<![{_WORD}])(?i:{alts})(?![{_WORD}])"


def canonical_phrase(hit: Column) -> Column:
    """Matched text -> its phrase key: ASCII lower case, separator runs -> one blank."""
    low = F.translate(hit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(low, SEPARATOR, " ")


def phrase_table(spark) -> DataFrame:
    """The fixed phrase list as a small DataFrame (priority = list position)."""
    return spark.createDataFrame([(p, tone, i) for i, (p, tone) in enumerate(PHRASES)],
                                 "phrase string, tone string, priority int")


def message_tones(df: DataFrame, text_col: str = "message", keys: list[str] | None = None) -> DataFrame:
    """One row per phrase hit: (keys..., position, phrase, tone)."""
    keys = keys or ["event_id"]
    hits = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(phrase_pattern()), 0))
                     .alias("position", "hit"))
    hits = hits.withColumn("phrase", canonical_phrase(F.col("hit")))
    # the phrase table has a fixed size (140 rows), so broadcasting it is bounded
    return hits.join(F.broadcast(phrase_table(df.sparkSession)), "phrase").select(
        *keys, "position", "hit", "phrase", "tone")


def tone_counts(df: DataFrame, group_cols: list[str], text_col: str = "message") -> DataFrame:
    """Phrase-hit totals per class and grouping (partial aggregation before shuffle)."""
    return (message_tones(df, text_col, keys=group_cols)
            .groupBy(*group_cols, "tone").agg(F.count(F.lit(1)).alias("hits")))
