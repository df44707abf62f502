"""Logging health views (A10, A11) and field listings (P20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C

LOSS_EVENTS = ["logger.events_dropped", "logger.events_rejected"]


def logging_loss_report(df: DataFrame) -> DataFrame:
    """A10: events the producers report as dropped / rejected, per source and run."""
    count = C.field_scalar("count").try_cast("long")
    return (df.where(F.col("event").isin(*LOSS_EVENTS))
              .groupBy("source", "app_session_id", "event")
              .agg(F.count(F.lit(1)).alias("reports"), F.coalesce(F.sum(count), F.lit(0)).alias("lost")))


def view_counts(df: DataFrame, condition, invalid_records: DataFrame | None = None) -> DataFrame:
    """Loaded rows, rows shown by the filter, repeat groups among them, invalid lines."""
    keyed = C.with_repeat_key(df).withColumn("_shown", condition)
    key = F.struct(*[F.col(c) for c in C.REPEAT_KEY_COLUMNS])
    out = keyed.agg(F.count(F.lit(1)).alias("loaded"), F.count_if("_shown").alias("shown"),
                    F.count_distinct(F.when(F.col("_shown"), key)).alias("repeat_groups"))
    if invalid_records is not None:
        inv = invalid_records.agg(F.count(F.lit(1)).alias("invalid"))
        out = out.withColumn("_one", F.lit(1)).join(inv.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out


def field_paths(df: DataFrame, max_characters: int = 80) -> DataFrame:
    """P20: one row per (event, ``fields.<name>``, value text cut to ``max_characters``)."""
    entries = F.explode(C.field_entries("fields")).alias("e")
    return (df.select("event_id", entries)
              .select("event_id", F.concat(F.lit("fields."), F.col("e.key")).alias("path"),
                      C.compact_identifier(F.coalesce(F.col("e.text"), F.col("e.json")),
                                           max_characters).alias("value")))
