"""Event store: validated events written once as partitioned Parquet with the derived
columns materialised (correlation, tag, severity, search document, fingerprint), read back with
partition pruning and Parquet filter pushdown.

Layout: ``event_date=<day>/source=<name>/part-*.parquet``. Rows are range-partitioned on
(day, source, event_id) before the write, so a source holding a third of all rows is
written by many tasks into many files instead of one task, and each file is sorted by
(level, event_id) so level filters can skip row groups. Correlations and fingerprints lie all
over a row group's range of values, so Bloom filters let a look-up skip the groups without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.schema import EVENT_COLUMNS
from logspark.sources.export import event_fingerprint

#: Columns looked up by one value (F3, J3, J4): their row groups carry Bloom filters.
POINT_LOOKUPS = ["correlation", "fingerprint"]
DERIVED = ["correlation", "tag", "severity", "search_document", "fingerprint"]


def enrich(events: DataFrame) -> DataFrame:
    """Add the derived columns once (P1, P2, P3, P8, P19) and the partition day."""
    return events.withColumns({
        "correlation": C.correlation(), "tag": C.tag(), "severity": C.severity(),
        "search_document": C.search_document(), "fingerprint": event_fingerprint(), "event_date": F.to_date("timestamp")})


def write_event_store(events: DataFrame, path: str, mode: str = "append") -> None:
    # rows are dealt out and sorted as they came, so that the sample of the ranges derives nothing
    placed = (events.select(*EVENT_COLUMNS).withColumn("event_date", F.to_date("timestamp"))
                    .repartitionByRange("event_date", "source", "event_id")
                    .sortWithinPartitions("event_date", "source", "level", "event_id"))
    writer = enrich(placed).write.mode(mode).partitionBy("event_date", "source")
    for column in POINT_LOOKUPS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def read_event_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
