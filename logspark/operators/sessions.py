"""Run (session) summaries and A/B comparison.

All summaries are hash aggregates whose functions (min, max, count, count_if, sum,
max_by, collect_set of a small domain) combine partially on the map side, so a run
holding a third of all rows still ships one partial row per map task. Distinct
correlations are counted through Spark's two-phase distinct plan (grouped by run AND
correlation first), never gathered as a set in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C

SESSION = "app_session_id"


def _last_status() -> Column:
    """Status text of the latest event with a scalar status (ties -> later ingested)."""
    st = C.status_text()
    return F.max_by(st, F.when(st != "-", F.struct(F.col("timestamp"), F.col("event_id"))))


def _elapsed_ms(first: Column, last: Column) -> Column:
    # whole milliseconds of the exact difference, never negative
    return F.greatest(F.floor((F.unix_micros(last) - F.unix_micros(first)) / 1000).cast("long"), F.lit(0))


def session_summaries(df: DataFrame) -> DataFrame:
    """A5: per run first/last time, elapsed, counts, providers, correlations, final status."""
    corr = C.correlation()
    return (df.groupBy(SESSION).agg(
                F.min("timestamp").alias("first_timestamp"),
                F.max("timestamp").alias("last_timestamp"),
                F.count(F.lit(1)).alias("event_count"),
                F.count_if(F.col("level") == "warn").alias("warning_count"),
                F.count_if(C.is_error()).alias("error_count"),
                F.array_sort(F.collect_set(F.when(F.col("provider") != "", F.col("provider")))).alias("providers"),
                F.count_distinct(F.when((corr != F.col(SESSION)) & (corr != ""), corr)).alias("correlation_count"),
                _last_status().alias("status"))
              .withColumn("elapsed_ms", _elapsed_ms(F.col("first_timestamp"), F.col("last_timestamp"))))


def session_event_summaries(df: DataFrame) -> DataFrame:
    """Per (run, event name) counts, duration total / count / mean / max, last status."""
    return (df.groupBy(SESSION, "event").agg(
                F.count(F.lit(1)).alias("count"),
                F.count_if(F.col("level") == "warn").alias("warning_count"),
                F.count_if(C.is_error()).alias("error_count"),
                F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_total_ms"),
                F.count("duration_ms").alias("duration_count"),
                F.max("duration_ms").alias("max_duration_ms"),
                _last_status().alias("status"))
              .withColumn("average_duration_ms",
                          F.when(F.col("duration_count") > 0,
                                 F.col("duration_total_ms") / F.col("duration_count"))))


def order_sessions(summaries: DataFrame) -> DataFrame:
    """Newest run first, ties by id."""
    return summaries.orderBy(F.col("last_timestamp").desc(), F.col(SESSION))


def _duration_changed(a: Column, b: Column) -> Column:
    return (F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) >= 1.0)
            .otherwise(a.isNull() != b.isNull()))


def compare_sessions(df: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """J2 + O5: full outer match of two runs on event name, differing rows first."""
    both = session_event_summaries(df.where(F.col(SESSION).isin(run_a, run_b)))

    def side(run: str, suffix: str) -> DataFrame:
        return both.where(F.col(SESSION) == run).select(
            "event",
            F.col("count").alias(f"count_{suffix}"),
            F.col("warning_count").alias(f"warnings_{suffix}"),
            F.col("error_count").alias(f"errors_{suffix}"),
            F.col("average_duration_ms").alias(f"average_duration_{suffix}"),
            F.col("max_duration_ms").alias(f"max_duration_{suffix}"),
            F.col("status").alias(f"status_{suffix}"))

    j = side(run_a, "a").join(side(run_b, "b"), "event", "full_outer")
    for c in ["count", "warnings", "errors"]:
        j = j.withColumn(f"{c}_a", F.coalesce(F.col(f"{c}_a"), F.lit(0))) \
             .withColumn(f"{c}_b", F.coalesce(F.col(f"{c}_b"), F.lit(0)))
    differs = ((F.col("count_a") != F.col("count_b")) | (F.col("warnings_a") != F.col("warnings_b"))
               | (F.col("errors_a") != F.col("errors_b"))
               | ~F.col("status_a").eqNullSafe(F.col("status_b"))
               | _duration_changed(F.col("average_duration_a"), F.col("average_duration_b"))
               | _duration_changed(F.col("max_duration_a"), F.col("max_duration_b")))
    j = (j.withColumn("differs", differs)
          .withColumn("missing_side", (F.col("count_a") == 0) | (F.col("count_b") == 0))
          .withColumn("error_delta", F.abs(F.col("errors_a") - F.col("errors_b")))
          .withColumn("count_delta", F.abs(F.col("count_a") - F.col("count_b"))))
    return j.orderBy(F.col("differs").desc(), F.col("missing_side").desc(), F.col("error_delta").desc(),
                     F.col("count_delta").desc(), F.col("event"))


def run_comparison_totals(df: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Events, errors and elapsed of both runs plus the number of differing event types."""
    s = session_summaries(df.where(F.col(SESSION).isin(run_a, run_b)))
    diff = compare_sessions(df, run_a, run_b).agg(F.count_if("differs").alias("differing_events"))
    pick = lambda run, col: F.max(F.when(F.col(SESSION) == run, F.col(col)))
    totals = s.agg(pick(run_a, "event_count").alias("events_a"), pick(run_b, "event_count").alias("events_b"),
                   pick(run_a, "error_count").alias("errors_a"), pick(run_b, "error_count").alias("errors_b"),
                   pick(run_a, "elapsed_ms").alias("elapsed_ms_a"), pick(run_b, "elapsed_ms").alias("elapsed_ms_b"))
    # both sides are one-row aggregates; an equi-join on a constant key combines them
    return totals.withColumn("_one", F.lit(1)).join(diff.withColumn("_one", F.lit(1)), "_one").drop("_one")


def session_starts(all_events: DataFrame) -> DataFrame:
    return all_events.groupBy(SESSION).agg(F.min("timestamp").alias("run_start"))


def with_relative_time(view: DataFrame, all_events: DataFrame | None = None) -> DataFrame:
    """Each event with its run's first timestamp and the signed offset from it.

    The run start comes from *all* loaded rows (not only the filtered view). It is a
    per-run aggregate joined back on the run id: the join strategy is chosen at run time
    by adaptive execution (broadcast when the measured start table is small, otherwise a
    shuffle join whose hot runs are split by skew-join handling).
    """
    starts = session_starts(all_events if all_events is not None else view)
    out = view.join(starts, SESSION, "left")
    rel = F.floor((F.unix_micros("timestamp") - F.unix_micros("run_start")) / 1000).cast("long")
    return (out.withColumn("relative_ms", rel)
               .withColumn("relative_text", C.relative_elapsed_text(F.col("relative_ms"))))


with_run_elapsed = with_relative_time
