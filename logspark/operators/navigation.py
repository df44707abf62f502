"""Error navigation, retention and ordering.

``error_neighbours`` finds, for every row of a view, the nearest following and preceding
error row inside its run, wrapping round the ends. It never sorts a whole run in one task:
rows are cut into blocks of consecutive ingestion ids; a window inside each (run, block)
finds in-block neighbours, a per-block table (one row per block, scanned in ranges) carries
the nearest errors of later / earlier blocks and the run's first / last error, and a join on
(run, block) brings them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators import scans as SC

DEFAULT_BLOCK = 1 << 16


def error_neighbours(view: DataFrame, partition_cols=("app_session_id",), block_size: int = DEFAULT_BLOCK,
                     is_match=None) -> DataFrame:
    """``next_error_id`` / ``previous_error_id`` per row (wrapping; NULL if the run has none).

    ``partition_cols=()`` navigates the whole view as one sequence. The table of blocks is
    scanned in ranges (``scans.nearest``), so no window grows with the view in either case.
    """
    parts = list(partition_cols)
    match = C.is_error() if is_match is None else is_match
    v = view.withColumn("_err", F.when(match, F.col("event_id"))) \
            .withColumn("_blk", F.floor(F.col("event_id") / F.lit(block_size)))
    wb = Window.partitionBy(*parts, "_blk").orderBy("event_id")
    v = (v.withColumn("_next_in", F.first("_err", ignorenulls=True).over(
            wb.rowsBetween(1, Window.unboundedFollowing)))
          .withColumn("_prev_in", F.last("_err", ignorenulls=True).over(
            wb.rowsBetween(Window.unboundedPreceding, -1))))
    ids = view.select(*parts, F.when(match, F.col("event_id")).alias("_err"), F.floor(F.col("event_id") / F.lit(block_size)).alias("_blk"))
    blocks = ids.groupBy(*parts, "_blk").agg(F.min("_err").alias("_bfirst"), F.max("_err").alias("_blast"))
    blocks = SC.nearest(blocks, parts, "_blk", "_bfirst", "_blast")
    out = v.join(blocks, [*parts, "_blk"], "left")
    return (out.withColumn("next_error_id", F.coalesce("_next_in", "_next", "_low"))
               .withColumn("previous_error_id", F.coalesce("_prev_in", "_prev", "_high"))
               .drop("_err", "_blk", "_next_in", "_prev_in", "_next", "_prev", "_low", "_high"))


#: Blocks of ids that one counting pass tells apart; bounds what reaches the driver.
CUT_BLOCKS = 4096


def cut_off(df: DataFrame, n: int, bucket_size: int = 1 << 16) -> int | None:
    """Smallest ``event_id`` of the newest ``n`` rows; None where there are no more than ``n``.

    Rows are counted per block of ids (at most ``CUT_BLOCKS``, and at first no narrower than
    ``bucket_size``), then per smaller block inside the one where the newest n rows end, until
    that is a single id. No pass sorts, and each after the first reads one block of ids.
    """
    ids = df.select("event_id")
    low, high, rows = ids.agg(F.min("event_id"), F.max("event_id"), F.count("event_id")).first()
    if rows <= n:
        return None
    narrowest = bucket_size
    while low < high:
        width = max(narrowest, (high - low) // CUT_BLOCKS + 1)
        block = F.expr(f"(bigint({high}) - event_id) div bigint({width})").alias("block")
        sizes = ids.where(F.col("event_id").between(low, high)).groupBy(block).agg(F.count(F.lit(1)).alias("rows")).collect()
        for back, size in sorted(map(tuple, sizes)):
            if size >= n:
                break
            n -= size
        low, high = max(low, high - (back + 1) * width + 1), high - back * width
        narrowest = 1
    return low


def keep_latest(df: DataFrame, n: int = 250_000, bucket_size: int = 1 << 16) -> DataFrame:
    """O1: the newest ``n`` rows by ingestion order (n clamped to >= 1), newest first.

    The ids are an event set's dense numbering, so each occurs once. The cut-off is resolved
    when this is called; the rows are then a plain ``event_id >= cut``, which reaches the scan.
    """
    cut = cut_off(df, max(int(n), 1), bucket_size)
    kept = df if cut is None else df.where(F.col("event_id") >= F.lit(cut))
    return order_latest(kept)


def retention_report(df: DataFrame, n: int = 250_000) -> DataFrame:
    """O1: how many rows a latest-``n`` window keeps and discards."""
    n = max(int(n), 1)
    return df.agg(F.count(F.lit(1)).alias("loaded")).select(
        F.least(F.col("loaded"), F.lit(n)).alias("retained"),
        F.greatest(F.col("loaded") - F.lit(n), F.lit(0)).alias("discarded"))


def order_latest(df: DataFrame, latest_at: str = "top") -> DataFrame:
    """O3: newest first (``top``) or last (``bottom``)."""
    return df.orderBy(F.col("event_id").desc() if latest_at == "top" else F.col("event_id").asc())


def latest_visible(df: DataFrame, condition) -> DataFrame:
    """Newest row id passing ``condition`` (one aggregate, no sort)."""
    return df.where(condition).agg(F.max("event_id").alias("latest_event_id"))
