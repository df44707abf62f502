"""Repeat collapsing (A8, W1): group events by their repeat key, keep the newest.

The group statistics (count, first) are a partial-aggregating hash aggregate. The newest
and second-newest rows come from ``row_number() <= 2`` over the key, which Spark plans as
a per-partition partial top-2 *before* the shuffle, so a key holding a third of all rows
ships at most two rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions import columns as C

KEY = C.REPEAT_KEY_COLUMNS


def _top_two(keyed: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(F.col("event_id").desc())
    return keyed.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 2)


def _stats(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("repeat_count"),
                                   F.min("event_id").alias("first_event_id"),
                                   F.min_by("timestamp", "event_id").alias("first_timestamp"))


def repeat_groups(view: DataFrame) -> DataFrame:
    """One row per repeat key: count, first, previous (2nd newest) and latest event ids."""
    keyed = C.with_repeat_key(view)
    stats = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("repeat_count"),
                                    F.min("event_id").alias("first_event_id"),
                                    F.max("event_id").alias("latest_event_id"))
    previous = (_top_two(keyed.select(*KEY, "event_id")).where(F.col("_rank") == 2)
                .select(*KEY, F.col("event_id").alias("previous_event_id")))
    return stats.join(previous, KEY, "left")


def repeat_representatives(view: DataFrame, timestamp_format: str = C.DEFAULT_TIMESTAMP_FORMAT) -> DataFrame:
    """The newest row of each repeat key carries the group and its summary text."""
    keyed = C.with_repeat_key(view)
    top = _top_two(keyed)
    newest = top.where(F.col("_rank") == 1).drop("_rank")
    previous = top.where(F.col("_rank") == 2).select(
        *KEY, F.col("event_id").alias("previous_event_id"), F.col("timestamp").alias("previous_timestamp"))
    out = newest.join(_stats(keyed), KEY).join(previous, KEY, "left")
    first_text = C.timestamp_text("first_timestamp", timestamp_format)
    last_text = F.coalesce(C.timestamp_text("previous_timestamp", timestamp_format), F.lit("unknown"))
    summary = F.when(F.col("repeat_count") > 1, F.concat(
        F.lit("Repeated "), F.col("repeat_count").cast("string"), F.lit(" times · first "), first_text,
        F.lit(" · last "), last_text))
    return out.withColumn("repeat_summary", summary)
