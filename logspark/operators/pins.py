"""Pins (J3, W3): take pins of events, find pinned events again, lay pins out on a strip.

A pin carries the content key, the note and the snapshot of its event (``event_json`` and
``event_time``), so the strip and the investigation document show it whether or not the event
is still loaded. ``locate_pins`` is an equi-join of the pin table to *all* retained events on
the content fingerprint (the stored one where the events come from the event store); the first
match in ingestion order wins (``min`` per pin, partially aggregated). Pins that match nothing
are kept and flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.sources.export import event_fingerprint, export_line


def take_pins(events: DataFrame, note: Column) -> DataFrame:
    """(pin_key, note, event_json, event_time) of every event given."""
    return events.select(_key(events), note.alias("note"), export_line().alias("event_json"),
                         F.col("timestamp").alias("event_time"))


def _key(events: DataFrame) -> Column:
    return (F.col("fingerprint") if "fingerprint" in events.columns else event_fingerprint()).alias("pin_key")


def locate_pins(pins: DataFrame, events: DataFrame) -> DataFrame:
    """Pins with matched_event_id (NULL = no longer retained), retained and pin_timestamp.

    The time is the snapshot's; a bare pin (key and note only) takes that of the event found.
    """
    keyed = events.select(_key(events), "event_id", "timestamp")
    # only fingerprints that some pin names survive the semi join before the aggregate
    hits = (keyed.join(pins.select("pin_key").distinct(), "pin_key", "left_semi")
                 .groupBy("pin_key").agg(F.min("event_id").alias("matched_event_id"),
                                         F.min_by("timestamp", "event_id").alias("_found")))
    own = F.col("event_time") if "event_time" in pins.columns else F.lit(None).cast("timestamp")
    return (pins.join(hits, "pin_key", "left").withColumn("pin_timestamp", F.coalesce(own, F.col("_found")))
                .withColumn("retained", F.col("matched_event_id").isNotNull()).drop("_found"))


def lost_pins(pins: DataFrame, events: DataFrame) -> DataFrame:
    """Pins whose event is no longer in the loaded rows."""
    return pins.join(events.select(_key(events)), "pin_key", "left_anti")


def pin_strip(located: DataFrame) -> DataFrame:
    """All pins by time (bare pins without an event first) with delta to the pin before,
    total span and wrapped next / previous pin keys.

    Positions come from the distributed dense numbering (O2); neighbours are equi-joins on
    ``position +- 1`` and the wrap-around ends come from a one-row aggregate, so no step
    needs the whole pin list in one task."""
    from logspark.sources.jsonl import with_row_numbers

    numbered = with_row_numbers(located, ["pin_timestamp", "pin_key", "note"], name="position", start=1)
    prev = numbered.select((F.col("position") + 1).alias("position"),
                           F.col("pin_timestamp").alias("_prev_ts"), F.col("pin_key").alias("previous_pin"))
    nxt = numbered.select((F.col("position") - 1).alias("position"), F.col("pin_key").alias("next_pin"))
    ends = numbered.agg(F.min("pin_timestamp").alias("_t0"), F.max("pin_timestamp").alias("_t1"),
                        F.min_by("pin_key", "position").alias("_first"),
                        F.max_by("pin_key", "position").alias("_last")).withColumn("_one", F.lit(1))
    out = (numbered.join(prev, "position", "left").join(nxt, "position", "left")
                   .withColumn("_one", F.lit(1)).join(ends, "_one"))
    delta = F.floor((F.unix_micros("pin_timestamp") - F.unix_micros("_prev_ts")) / 1000).cast("long")
    span = F.floor((F.unix_micros("_t1") - F.unix_micros("_t0")) / 1000).cast("long")
    return (out.withColumns({
                "delta_ms": delta,
                "span_ms": span,
                "next_pin": F.coalesce(F.col("next_pin"), F.col("_first")),
                "previous_pin": F.coalesce(F.col("previous_pin"), F.col("_last"))})
               .withColumn("delta_text", F.when(F.col("delta_ms").isNotNull(),
                                                C.relative_elapsed_text(F.col("delta_ms"))))
               .drop("_prev_ts", "_t0", "_t1", "_first", "_last", "_one"))
