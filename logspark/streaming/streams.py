"""Structured Streaming operators.

Sources are landing folders of *closed* files (a file source never re-reads lines appended
to a file it has seen). Stateless steps (validation, filtering) run per micro-batch;
running summaries and facet counts are streaming aggregations; repeat groups and the
bounded latest-N window are ``foreachBatch`` merges that write one versioned table per
batch id, so a replayed batch rewrites exactly its own version (idempotent).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators import facets as FA
from logspark.operators import filters as FI
from logspark.operators import navigation as NV
from logspark.operators import repeats as RP
from logspark.operators import sessions as SE
from logspark.schema import EVENT_SCHEMA
from logspark.session import scratch_path
from logspark.sources import jsonl as JL


# ------------------------------------------------------------------ S6 / T7 sources
def _limited(reader, max_files_per_trigger: int | None):
    """All files that have arrived go into a micro-batch unless the caller sets a limit."""
    return reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader


def stream_event_logs(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSONL lines of closed files dropped into ``landing_dir`` (file name kept)."""
    return (_limited(spark.readStream.format("text"), max_files_per_trigger).load(landing_dir)
                 .select("value", F.col("_metadata.file_name").alias("file_name"),
                         F.col("_metadata.file_path").alias("file_path"),
                         F.col("_metadata.file_block_start").alias("_blk")))


def stream_events(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Validated events landing as Parquet files of the canonical event frame."""
    return _limited(spark.readStream.schema(EVENT_SCHEMA), max_files_per_trigger).parquet(landing_dir)


def with_event_watermark(df: DataFrame, delay: str | None = None) -> DataFrame:
    """Late data is accepted by default (min / max / tie rules are order-safe); a delay
    bounds the state of time-keyed operators when the caller can accept dropping late rows."""
    return df.withWatermark("timestamp", delay) if delay else df


# ------------------------------------------------------------------ T1 / T8 validation
def stream_validate(lines: DataFrame, events_dir: str, rejects_dir: str, health_dir: str,
                    checkpoint_dir: str, trigger_available_now: bool = True):
    """T1 + T8: validate each micro-batch; valid events, rejects and a per-batch health
    report go to three tables, each written under ``batch_id=<id>`` (replay-safe).

    ``event_id`` goes on from batch to batch: a batch starts at the number of valid events that
    the health reports of the batches before it hold, and numbers its own by file and line.
    A batch's decoded rows are a table in the shared folder while it runs (a cache of them would
    fill the executors' heaps); the three tables are made of it, so that no line is parsed again."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        decoded = JL.parse_event_lines(_number_batch_lines(batch)).drop("value")
        path = scratch_path(spark, "decoded-lines")
        try:
            decoded.write.parquet(path)
            parsed = spark.read.schema(decoded.schema).parquet(path)
            part = f"batch_id={batch_id}"
            start = _valid_before(spark, health_dir, batch_id)
            (JL.with_row_numbers(parsed.where(F.col("reason").isNull()), ["file_path", "line_number"], start=start)
                   .select(*EVENT_SCHEMA.names, "file_name", "line_number")
                   .write.mode("overwrite").parquet(os.path.join(events_dir, part)))
            (parsed.where(F.col("reason").isNotNull()).select("file_path", "file_name", "line_number", "reason")
                   .write.mode("overwrite").parquet(os.path.join(rejects_dir, part)))
            (parsed.groupBy("file_path", "file_name").agg(
                F.count_if(F.col("reason").isNull()).alias("valid"),
                F.count_if(F.col("reason").isNotNull()).alias("invalid"),
                F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("line_number"))).alias("last_error"))
                   .write.mode("overwrite").parquet(os.path.join(health_dir, part)))
        finally:
            _remove(spark, path)

    writer = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if trigger_available_now else writer
    return writer.start()


def _valid_before(spark: SparkSession, health_dir: str, batch_id: int) -> int:
    """Valid events of all batches before this one (each has written its health report)."""
    if batch_id == 0 or not _exists(spark, health_dir):
        return 0
    earlier = spark.read.parquet(health_dir).where(F.col("batch_id") < batch_id)
    return earlier.agg(F.coalesce(F.sum("valid"), F.lit(0))).first()[0]


def _number_batch_lines(batch: DataFrame) -> DataFrame:
    """Physical line numbers inside each file of a micro-batch (files arrive whole)."""
    return JL.number_physical_lines(batch).where(F.col("value").rlike(r"\S"))


# ------------------------------------------------------------------ T2 / K3 filter + sink
def stream_filter(events: DataFrame, state: FI.FilterState) -> DataFrame:
    """The active filter applied to each new row (stateless, append mode)."""
    return events.where(FI.filter_column(state, stored=tuple(events.columns)))


def stream_to_sink(df: DataFrame, path: str, checkpoint_dir: str, fmt: str = "parquet",
                   trigger_available_now: bool = True):
    """K3: continuous, checkpointed delivery of rows (append mode, exactly-once file sink)."""
    writer = (df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint_dir)
                .outputMode("append"))
    writer = writer.trigger(availableNow=True) if trigger_available_now else writer
    return writer.start()


# ------------------------------------------------------------------ T3 / T4 aggregations
def stream_session_summaries(events: DataFrame) -> DataFrame:
    """Running A5 summaries (order-insensitive: min / max / counts / max_by ties by id).

    Distinct correlations are NOT kept as a set in the run's state row: they are a second
    streaming aggregate keyed by (run, correlation) (``stream_session_correlations``), so
    state is spread by key; ``session_summary_table`` joins the two when reading."""
    st = C.status_text()
    return (events.groupBy(SE.SESSION).agg(
                F.min("timestamp").alias("first_timestamp"),
                F.max("timestamp").alias("last_timestamp"),
                F.count(F.lit(1)).alias("event_count"),
                F.count_if(F.col("level") == "warn").alias("warning_count"),
                F.count_if(C.is_error()).alias("error_count"),
                F.collect_set(F.when(F.col("provider") != "", F.col("provider"))).alias("_providers"),
                F.max_by(st, F.when(st != "-", F.struct(F.col("timestamp"), F.col("event_id")))).alias("status"))
              .withColumn("providers", F.array_sort("_providers")).drop("_providers"))


def stream_session_correlations(events: DataFrame) -> DataFrame:
    """Distinct (run, correlation) pairs other than the run id itself and ''."""
    corr = C.correlation()
    return (events.where((corr != F.col(SE.SESSION)) & (corr != ""))
                  .groupBy(SE.SESSION, corr.alias("correlation")).agg(F.count(F.lit(1)).alias("events")))


def session_summary_table(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Current run summaries with their distinct-correlation counts."""
    counts = pairs.groupBy(SE.SESSION).agg(F.count(F.lit(1)).alias("correlation_count"))
    return (summaries.join(counts, SE.SESSION, "left")
                     .withColumn("correlation_count", F.coalesce(F.col("correlation_count"), F.lit(0))))


def stream_facet_counts(events: DataFrame, state: FI.FilterState | None = None) -> DataFrame:
    """T4: A2 facet counts kept current as rows arrive (update / complete mode)."""
    return FA.facet_counts_all(events, state, ordered=False)


def stream_window_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per time window and source. With ``with_event_watermark(events, delay)`` the
    state of windows that ended ``delay`` before the newest event goes, and rows that are later
    than that are dropped; without it every late row counts."""
    return (events.groupBy(F.window("timestamp", width).alias("w"), "source").agg(F.count(F.lit(1)).alias("events"))
                  .select(F.col("w.start").alias("window_start"), "source", "events"))


def run_aggregate_to_table(agg: DataFrame, path: str, checkpoint_dir: str):
    """Materialise a streaming aggregate: each micro-batch appends the keys it changed, with
    their new values, under ``batch_id=<id>`` (update mode, replay-safe). ``current_rows``
    reads the newest values."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))

    return (agg.writeStream.outputMode("update").foreachBatch(per_batch)
               .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key of a table that ``run_aggregate_to_table`` keeps."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_now"))
    return newest.select(*keys, "_now.*")


# ------------------------------------------------------------------ T5 / T6 merges
def _latest_version(spark: SparkSession, table_dir: str, before: int) -> DataFrame | None:
    """The newest completed version below ``before``."""
    for v in reversed([v for v in _versions(spark, table_dir) if v < before]):
        p = os.path.join(table_dir, f"v={v}")
        if _exists(spark, os.path.join(p, "_SUCCESS")):
            return spark.read.parquet(p)
    return None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Versions of a merge table that stay: the newest, the one a replay of its batch reads, and one for slow readers.
KEPT_VERSIONS = 3


def _write_version(df: DataFrame, table_dir: str, batch_id: int) -> None:
    """Write ``v=<batch_id>`` and remove versions older than the last ``KEPT_VERSIONS``."""
    df.write.mode("overwrite").parquet(os.path.join(table_dir, f"v={batch_id}"))
    spark = df.sparkSession
    for version in _versions(spark, table_dir)[:-KEPT_VERSIONS]:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(table_dir, f"v={version}"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _versions(spark: SparkSession, table_dir: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


GROUP_COLUMNS = C.REPEAT_KEY_COLUMNS + ["repeat_count", "first_event_id", "latest_event_id", "previous_event_id"]


def merge_repeat_groups(old: DataFrame | None, batch_groups: DataFrame) -> DataFrame:
    """T5 merge: counts add, first = min, latest = max, previous = second largest of the
    two sides' (latest, previous) ids."""
    if old is None:
        return batch_groups
    both = old.select(*GROUP_COLUMNS).unionByName(batch_groups.select(*GROUP_COLUMNS))
    ids = F.array_sort(F.filter(F.flatten(F.collect_list(F.array("latest_event_id", "previous_event_id"))),
                                lambda x: x.isNotNull()))
    return (both.groupBy(*C.REPEAT_KEY_COLUMNS)
                .agg(F.sum("repeat_count").alias("repeat_count"), F.min("first_event_id").alias("first_event_id"),
                     ids.alias("_ids"))
                .withColumns({"latest_event_id": F.element_at("_ids", -1),
                              "previous_event_id": F.try_element_at("_ids", F.lit(-2))})
                .drop("_ids"))


def stream_repeat_groups(events: DataFrame, table_dir: str, checkpoint_dir: str):
    """T5: running A8 groups; version ``v=<batch_id>`` = previous version merged with the batch.

    Per key the merge carries at most two ids from each side, so its work is bounded by
    the number of groups, not by how often a group repeats."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _latest_version(spark, table_dir, batch_id)
        merged = merge_repeat_groups(old, RP.repeat_groups(batch))
        _write_version(merged, table_dir, batch_id)

    return (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
                  .trigger(availableNow=True).start())


def stream_keep_latest(events: DataFrame, n: int, table_dir: str, checkpoint_dir: str,
                       paused: bool = False):
    """The bounded latest-``n`` window; ``paused`` keeps every row until resumed."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _latest_version(spark, table_dir, batch_id)
        rows = batch if old is None else old.unionByName(batch)
        kept = rows if paused else NV.keep_latest(rows, n)
        _write_version(kept, table_dir, batch_id)

    return (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
                  .trigger(availableNow=True).start())


def latest_table(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """Newest completed version of a versioned merge table."""
    versions = _versions(spark, table_dir)
    return _latest_version(spark, table_dir, versions[-1] + 1) if versions else None
