"""Saved filters (F13, F5) and correlation trails (J4); row-set algebra.

``evaluate_saved_filters`` applies any number of named filters to all events in ONE scan
per chunk of filters: each filter becomes three aggregate columns (hits, first and last
matching event id) of a single global aggregate, so no event is paired with every filter
and nothing but the tiny per-filter result reaches the driver. Filters are parameters (a
list of ``FilterState``), processed in chunks so any number of them can be evaluated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.filters import FilterState, correlation_value, filter_column, validate_predicates
from logspark.sources.jsonl import with_row_numbers

CHUNK = 64


def evaluate_saved_filters(df: DataFrame, filters: dict[str, FilterState]) -> DataFrame:
    """per named filter: hits, first / last matching event id, validation errors."""
    spark = df.sparkSession
    names = sorted(filters)
    parts = []
    for start in range(0, len(names), CHUNK):
        chunk = names[start:start + CHUNK]
        aggs = []
        for i, name in enumerate(chunk):
            cond = filter_column(filters[name], stored=tuple(df.columns))
            aggs += [F.count_if(cond).alias(f"h{i}"),
                     F.min(F.when(cond, F.col("event_id"))).alias(f"f{i}"),
                     F.max(F.when(cond, F.col("event_id"))).alias(f"l{i}")]
        row = df.agg(*aggs)
        stacked = row.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), F.col(f"h{i}").alias("hits"),
                     F.col(f"f{i}").alias("first_event_id"), F.col(f"l{i}").alias("last_event_id"))
            for i, n in enumerate(chunk)])).alias("r")).select("r.*")
        parts.append(stacked)
    result = reduce(DataFrame.unionByName, parts)
    errors = spark.createDataFrame(
        [(n, "; ".join(validate_predicates(filters[n].predicates, filters[n].now_ms)[1]) or None) for n in names],
        "name string, errors string")
    return result.join(errors, "name")


def correlation_trail(df: DataFrame, event_id: int) -> DataFrame:
    """All events sharing the correlation of one chosen event, in ingestion order.

    A semi join against the (one-row) correlation of the chosen event."""
    withc = df.withColumn("correlation", correlation_value(tuple(df.columns)))
    chosen = withc.where(F.col("event_id") == F.lit(event_id)).select("correlation").distinct()
    return withc.join(F.broadcast(chosen), "correlation", "left_semi").orderBy("event_id")


def correlation_trails(df: DataFrame, chosen_ids: DataFrame) -> DataFrame:
    """J4 for many chosen events at once: (chosen_event_id, event_id) pairs of each trail."""
    withc = df.withColumn("correlation", correlation_value(tuple(df.columns)))
    picks = withc.join(chosen_ids.select(F.col("event_id").alias("chosen_event_id")),
                       F.col("event_id") == F.col("chosen_event_id")).select("chosen_event_id", "correlation")
    return picks.join(withc.select("correlation", "event_id"), "correlation").select("chosen_event_id", "event_id")


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Many sources as one event set; no event de-duplication."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_events(*frames: DataFrame) -> DataFrame:
    """Many sources as one event set with ingestion ids of its own: source by source, then
    by the ids that the rows had."""
    marked = merge_sources(*(f.withColumn("_part", F.lit(i)) for i, f in enumerate(frames)))
    numbered = with_row_numbers(marked.withColumnRenamed("event_id", "_own"), ["_own"], name="event_id", within=["_part"])
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (numbered.join(F.broadcast(starts), "_part").withColumn("event_id", F.col("event_id") + F.col("_start"))
            .select(*frames[0].columns))


def combine_row_sets(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """OR / AND / AND-NOT of two row-id sets (column ``event_id``)."""
    a, b = a.select("event_id").distinct(), b.select("event_id").distinct()
    if op == "or":
        return a.union(b).distinct()
    if op == "and":
        return a.intersect(b)
    if op == "and_not":
        return a.exceptAll(b)
    raise ValueError(op)
